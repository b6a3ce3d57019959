"""Secret scans over a trigram inverted index, in DataFrame and SQL operations alone.

For each rule a Boolean query over trigrams is derived from its regular expression: text that matches the
expression must hold certain trigrams.  The index holds postings (trigram, text) for the trigrams that some
rule's query needs.  A rule's postings are intersected, each clause of its query counting once, and only the
texts that satisfy every clause are candidates.  Candidates are verified by running the expression over the
whole text.  Rules whose expression has no mandatory trigram scan every text.

A text is named in the index by a pair of hashes of its content, so copies share their postings and a row
needs no id.  Candidates are broadcast to the texts if counted to be few, and then no text is shuffled.  Spans count code points, end exclusive; matches of a rule are leftmost and do not overlap.

Defined results: a null text is an empty one and has no spans; repeated rows get equal results; null ids
pass through; an empty table gives an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content, fields, join_by_key, materialise, packed, without


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``least`` code points are needed in ``group`` (0: the match) for a match to stay."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds come first and in this order.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
BASE_KINDS = ("assign", "access", "hex")

_MOST = 64


def _cross(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    if a is None or b is None or len(a) * len(b) > _MOST:
        return None
    return {x + y for x in a for y in b}


def _clauses(strings: set[str]) -> set[frozenset[str]]:
    """Clauses that text holding one of these strings satisfies: one trigram of each string, by position from either end."""
    if not strings or min(map(len, strings)) < 3:
        return set()
    width = min(map(len, strings)) - 2
    return {frozenset(s[i : i + 3] for s in strings) for i in range(width)} | {frozenset(s[len(s) - 3 - i : len(s) - i] for s in strings) for i in range(width)}


def _walk(tree) -> tuple[set[str] | None, set[frozenset[str]]]:
    """(all lower-cased strings that the expression can match, or None; clauses of its query)."""
    exact: set[str] | None = {""}
    clauses: set[frozenset[str]] = set()
    run: set[str] = {""}
    for op, arg in tree:
        one: set[str] | None = None
        own: set[frozenset[str]] = set()
        if op is C.LITERAL:
            one = {chr(arg).lower()}
        elif op is C.IN and all(x[0] in (C.LITERAL, C.RANGE) for x in arg):
            chars = {chr(c).lower() for kind, v in arg for c in ([v] if kind is C.LITERAL else range(v[0], v[1] + 1) if v[1] - v[0] < 8 else [0, 0xFFFF])}
            wide = any(kind is C.RANGE and v[1] - v[0] >= 8 for kind, v in arg)
            one = None if wide or len(chars) > 8 else chars
        elif op is C.SUBPATTERN:
            one, own = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                one = set().union(*[p[0] for p in parts])
            # A clause of the whole joins one clause of every branch.
            per = [sorted(p[1] | _clauses(p[0] or set()), key=lambda c: (len(c), sorted(c))) for p in parts]
            if all(per):
                own = {frozenset().union(*[p[min(i, len(p) - 1)] for p in per]) for i in range(max(map(len, per)))}
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner, inner_clauses = _walk(body)
            if low > 0:
                own = inner_clauses | _clauses(inner or set())
            if inner is not None and high <= 2:
                options, power = set(), {""}
                for n in range(high + 1):
                    if n >= low:
                        options |= power or set()
                    power = _cross(power, inner) or set()
                one = options
        clauses |= own
        exact = _cross(exact, one)
        joined = _cross(run, one)
        if joined is None:
            clauses |= _clauses(run)
            run = one if one is not None else {""}
        else:
            run = joined
    clauses |= _clauses(run)
    return exact, clauses


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The expression's query in conjunctive form over lower-cased trigrams; empty if none is mandatory.

    Every text with a match holds, once lower-cased, at least one trigram of each clause.
    """
    _, clauses = _walk(P.parse(pattern))
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, _k1, _k2) of the lower-cased texts, for the trigrams of the rules' queries."""
    needed = sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})
    low = F.translate(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = docs.select(*content(), F.coalesce("text", F.lit("")).alias("_text")).withColumn("_low", low)
    found = F.filter(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in needed]), lambda t: t.isNotNull()) if needed else F.array().cast("array<string>")
    return texts.select("_k1", "_k2", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_k1, _k2, kinds): for each text the rules whose clauses its postings satisfy."""
    terms = [(r.kind, n, t) for r in rules for n, clause in enumerate(trigram_query(r.pattern)) for t in sorted(clause)]
    sizes = {r.kind: len(trigram_query(r.pattern)) for r in rules}
    if not terms:
        return index.select("_k1", "_k2", F.array(F.lit("")).alias("kinds")).limit(0)
    query = index.sparkSession.createDataFrame(terms, "kind string, clause int, trigram string")
    met = index.join(F.broadcast(query), "trigram").groupBy("_k1", "_k2", "kind").agg(F.expr("bit_or(shiftleft(1L, clause))").alias("met"))
    complete = reduce(lambda a, k: a | ((F.col("kind") == k) & (F.col("met") == (1 << sizes[k]) - 1)), [k for k in sizes if sizes[k]], F.lit(False))
    return met.filter(complete).groupBy("_k1", "_k2").agg(F.collect_set("kind").alias("kinds"))


_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
_AT_ONCE = 256


def _bound(value: Column, use) -> Column:
    """``use`` of the value as a variable, which is computed once: an array of one element is transformed."""
    return F.transform(F.array(value), use)[0]


def _placed(lengths: Column, rank: int, rule: Rule) -> Column:
    """Spans from (text before, match, checked group) lengths.

    Lengths are summed in parts of ``_AT_ONCE``, each from the start of the text that the parts before it
    leave, so that a text with very many matches takes time in proportion to them.
    """

    def step(state, x):
        begin = state["at"] + x["b"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (begin + x["h"]).alias("end"))
        return F.struct((begin + x["h"]).alias("at"), F.when(x["g"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def parts(all_):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _AT_ONCE).cast("int")), lambda k: F.slice(all_, k * _AT_ONCE + 1, F.lit(_AT_ONCE)))

    def spans(cut):
        sums = F.transform(cut, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["b"] + x["h"]))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        empty = F.array().cast(_SPANS)
        return F.flatten(F.zip_with(cut, F.slice(starts, F.lit(1), F.size(cut)), lambda part, at: F.aggregate(part, F.struct(at.alias("at"), empty.alias("out")), step, lambda s: s["out"])))

    return _bound(lengths, lambda all_: F.when(F.size(all_) > 0, _bound(parts(all_), spans)).otherwise(F.array().cast(_SPANS)))


def _spans(rule: Rule, text: Column) -> Column:
    """array<struct<start, rank, kind, end>> of the rule's matches in the text.

    The text between the matches and the matches themselves alternate, so their lengths give the positions.
    """
    exact = rule.pattern
    if rule.group == 0 and rule.least and (m := re.fullmatch(r"(.*\])\+", exact)) and "(" not in exact:
        # A greedy run of one class is whole or nothing: ask for its least length at once.
        literal = len(re.sub(r"\[.*", "", exact))
        exact = f"{m[1]}{{{rule.least - literal},}}"
    hits = F.regexp_extract_all(text, F.lit(exact), F.lit(0))
    wanted = F.regexp_extract_all(text, F.lit(exact), F.lit(rule.group)) if rule.group else hits
    between = F.split(text, exact)
    lengths = F.zip_with(F.slice(between, F.lit(1), F.greatest(F.size(hits), F.lit(0))), F.zip_with(hits, wanted, lambda h, g: F.struct(F.length(h).alias("h"), F.length(g).alias("g"))), lambda b, x: F.struct(F.length(b).alias("b"), x["h"].alias("h"), x["g"].alias("g")))
    rank = next(i for i, r in enumerate(RULES) if r.kind == rule.kind) if rule in RULES else len(RULES)
    return _placed(lengths, rank, rule)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with ``secrets``: its spans, by start and then by the order of the rules."""
    docs = without(docs, "secrets")
    index = materialise(build_index(docs, rules), "trigram-index")
    found = materialise(candidates(index, rules), "candidate-texts")
    matched = join_by_key(packed(docs, *content()), found, ["_k1", "_k2"], "left", row_bytes=40 + 16 * F.size("kinds"))
    text = F.coalesce(F.col("_row").getField("text"), F.lit(""))
    parts = []
    for rule in rules:
        every = not trigram_query(rule.pattern)
        parts.append(_spans(rule, text) if every else F.when(F.array_contains("kinds", rule.kind), _spans(rule, text)).otherwise(F.array().cast(_SPANS)))
    return matched.select(*fields(docs), F.array_sort(F.concat(*parts)).alias("secrets"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [(F.size("secrets") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return scanned.select(id_col, *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))
