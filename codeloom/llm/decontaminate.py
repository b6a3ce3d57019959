"""Benchmark decontamination with a distributed positional inverted index.

Test items are read in blocks of at most ``BLOCK_WORDS`` words; each block is a bounded query set that is
sent to every task, and the corpus is never gathered.  For one block:

1. The corpus frequency of the block's terms is counted over all documents.
2. Every window of ``WINDOW`` test words gets two anchors, its rarest terms by that count.  The positions of
   the anchor terms in every document are stored: the positional index, one row a document with its lists.
   With ``slop`` a window has as many anchors as leave one near its place in any match in proximity.
3. Lists are intersected from the rarest terms: a position less the anchor's place in its item is the start
   the item would have, and anchors of a window must agree on that start.
4. What remains is verified word by word, and gives exact phrase matches.  With ``slop`` above zero, a window
   also matches in proximity when ``PROXIMITY`` of its words lie within that many places of where they belong.

Texts are named in the index by a pair of hashes of their content.  Copies therefore share one list of
candidates and no group of copies is gathered.  Candidates and matches are broadcast to the documents only if
counted to be few; else the join is shuffled, but for the hot texts (``join_by_key``).

Defined results: a null text has no words; an item of fewer words than a window, but not none, is one window;
items of the same id count once; repeated rows get equal results; an empty corpus or benchmark gives no
match; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, bounded_batches, chunks, content, fields, join_by_key, materialise, packed, pieces, text_bytes, without, word_hashes, words

WINDOW = 13
BLOCK_WORDS = 1_000_000
PROXIMITY = 0.8


class Block(NamedTuple):
    """Test items by their word hashes end to end, with the ids of the items."""

    hashes: np.ndarray
    offsets: np.ndarray
    ids: list


class Anchors(NamedTuple):
    """Terms to index; where each is an anchor; the pairs of anchors that windows need."""

    terms: np.ndarray
    rows: list[tuple[int, int, int, int]]
    pairs: list[tuple[int, int, int]]


def test_blocks(benchmark: DataFrame, item_col: str = "item_id", most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items that have words, in blocks; items stream through the driver, one block at a time."""
    parts, ids, size = [], [], 0
    for row in benchmark.select(item_col, "text").filter("text is not null").toLocalIterator():
        data, offsets = text_bytes(pa.array([row[1]]))
        found = word_hashes(LOWER[data], words(data, offsets, ALNUM))
        if len(found):
            if size and size + len(found) > most:
                yield Block(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), ids)
                parts, ids, size = [], [], 0
            parts.append(found)
            ids.append(row[0])
            size += len(found)
    if parts:
        yield Block(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), ids)


class _Lookup:
    """Finds which of many hashes are among a few sorted ones; most are refused by one table look-up."""

    def __init__(self, terms: np.ndarray):
        self.terms, self.some = terms, np.zeros(1 << 16, bool)
        self.some[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the hashes, places among the terms)."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.some[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        to = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        same = self.terms[to] == hashes[at]
        return at[same], to[same]


def term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each term occurs in all documents; each task sends one row for a term that it met."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        find, total = _Lookup(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in pieces(batches, 0):
            for _, _, part, offs in chunks(*text_bytes(batch.column(0))):
                _, to = find(word_hashes(LOWER[part], words(part, offs, ALNUM)))
                total += np.bincount(to, minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms), np.int64)
    out[found["term"].to_numpy(int)] = found["n"].to_numpy(int)
    return out


def _near_enough(size: int) -> int:
    """How many words of a window of this size must be near their places."""
    return int(np.ceil(PROXIMITY * size))


def choose_anchors(block: Block, terms: np.ndarray, counts: np.ndarray, window: int, slop: int = 0) -> Anchors:
    """The two rarest places of every window; windows in which some term never occurs need none.

    With ``slop``, words that never occur count as missing, and of the others one more than may still be
    missing are anchors, the rarest ones: any match has one of them near its place.
    """
    term = np.searchsorted(terms, block.hashes)
    names: dict[tuple[int, int], int] = {}
    pairs = set()
    for item in range(len(block.ids)):
        of = term[block.offsets[item] : block.offsets[item + 1]]
        n = counts[of]
        for start in range(max(1, len(of) - window + 1)):
            own = n[start : start + window]
            if slop:
                present = np.flatnonzero(own)
                spare = len(present) - _near_enough(len(own))
                for p in present[np.argsort(own[present], kind="stable")[: max(0, spare + 1)]]:
                    names.setdefault((item, int(p) + start), len(names))
            elif own.min() > 0:
                order = np.argsort(own, kind="stable")[:2] + start
                a, b = (names.setdefault((item, int(p)), len(names)) for p in (order[0], order[-1]))
                pairs.add((item, a, b))
    used = np.unique(np.array([term[block.offsets[i] + p] for i, p in names], np.int64))
    rows = [(int(np.searchsorted(used, term[block.offsets[i] + p])), i, p, name) for (i, p), name in names.items()]
    return Anchors(terms[used], rows, sorted(pairs))


def positional_index(docs: DataFrame, terms: np.ndarray, keep: list[str]) -> DataFrame:
    """One row a document: the kept columns as ``_row``, content hashes, n_words, and each term's positions in it."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    source = docs.select(row.alias("_row"), *content(), F.col("text").alias("_text"))
    names = source.columns[:-1]
    schema = source.select(*names, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<term:int,positions:array<int>>>").alias("_lists")).schema

    def run(batches):
        find = _Lookup(shared.value)
        for batch in pieces(batches, len(names)):
            data, offsets = text_bytes(batch.column(len(names)))
            rows, terms_, places, n_words = [], [], [], np.zeros(batch.num_rows, np.int64)
            for first, last, part, offs in chunks(data, offsets):
                w = words(part, offs, ALNUM)
                at, to = find(word_hashes(LOWER[part], w))
                begin = np.cumsum(w.counts) - w.counts
                n_words[first:last] = w.counts
                rows.append(w.row[at] + first)
                terms_.append(to)
                places.append(at - begin[w.row[at]])
            row, term, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, terms_, places))
            order = np.lexsort((place, term, row))
            row, term, place = row[order], term[order], place[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
            heads = np.flatnonzero(new)
            positions = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)), pa.int32()), pa.array(place, pa.int32()))
            struct = pa.StructArray.from_arrays([pa.array(term[heads], pa.int32()), positions], ["term", "positions"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[heads], np.arange(batch.num_rows + 1)), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), lists], [*names, "n_words", "_lists"])

    return materialise(source.mapInArrow(run, schema), "positional-index")


def intersect(index: DataFrame, anchors: Anchors, slop: int = 0) -> DataFrame:
    """(_k1, _k2, places): the items and starts at which the anchors of some window agree.

    With ``slop`` one anchor is enough, and may itself lie that many places from where it belongs.
    """
    spark = index.sparkSession
    at = spark.createDataFrame(anchors.rows or [(-1, 0, 0, 0)], "term int, item int, place int, anchor int")
    need = spark.createDataFrame(anchors.pairs or [(-1, 0, 0)], "item int, a int, b int").groupBy("item").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    lists = index.select("_k1", "_k2", F.explode("_lists").alias("l")).select("_k1", "_k2", "l.term", "l.positions")
    starts = lists.join(F.broadcast(at), "term").select("_k1", "_k2", "item", "anchor", F.explode(F.transform("positions", lambda p: p - F.col("place"))).alias("start"))
    if slop:
        starts = starts.withColumn("start", F.explode(F.array(*[F.col("start") + shift for shift in range(-slop, slop + 1)])))
    met = starts.groupBy("_k1", "_k2", "item", "start").agg(F.collect_set("anchor").alias("met"))
    if not slop:
        met = met.join(F.broadcast(need), "item").filter(F.exists("pairs", lambda p: F.array_contains("met", p["a"]) & F.array_contains("met", p["b"])))
    return met.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("item", "start")).alias("places"))


def _verified(doc: np.ndarray, item: np.ndarray, start: int, window: int, slop: int) -> list[tuple[int, int, str]]:
    """The windows of the item that occur with its first word at ``start``, as (begin, end, kind) in the document."""
    size = min(window, len(item))
    exact = np.zeros(len(item), bool)
    near = np.zeros(len(item), bool)
    for shift in range(-slop, slop + 1):
        lo, hi = max(0, -(start + shift)), min(len(item), len(doc) - start - shift)
        if lo < hi:
            same = doc[start + shift + lo : start + shift + hi] == item[lo:hi]
            near[lo:hi] |= same
            if not shift:
                exact[lo:hi] = same
    out = []
    for kind, good, least in (("phrase", exact, size), ("proximity", near, _near_enough(size))):
        sums = np.concatenate([[0], np.cumsum(good)])
        for at in np.flatnonzero(sums[size:] - sums[:-size] >= least):
            out.append((int(max(0, start + at)), int(min(len(doc), start + at + size)), kind))
        if not slop:
            break
    return out


def verify(docs: DataFrame, candidates: DataFrame, block: Block, window: int, slop: int) -> DataFrame:
    """(_k1, _k2, matches) of the texts with matches; each match has begin, end, item, kind."""
    candidates = materialise(candidates, "candidate-places")
    joined = join_by_key(docs.select(*content(), "text"), candidates, ["_k1", "_k2"], row_bytes=40 + 16 * F.size("places"))
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = joined.select(F.lit(None).cast("array<struct<begin:int,end:int,item:string,kind:string>>").alias("matches")).schema["matches"].dataType
    schema = joined.select("_k1", "_k2").schema.add("matches", kind)
    arrow = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("item", pa.string()), ("kind", pa.string())]))

    def run(batches):
        b = shared.value
        for batch in pieces(batches, 2):
            data, offsets = text_bytes(batch.column("text"))
            places, out = batch.column("places").to_pylist(), []
            for first, _, part, offs in chunks(data, offsets):
                w = words(part, offs, ALNUM)
                rows = np.split(word_hashes(LOWER[part], w), np.cumsum(w.counts)[:-1])
                for doc, own in zip(rows, places[first:], strict=False):
                    found = set()
                    for place in own:
                        i = place["item"]
                        item = b.hashes[b.offsets[i] : b.offsets[i + 1]]
                        name = None if b.ids[i] is None else str(b.ids[i])
                        found.update((x, y, name, k) for x, y, k in _verified(doc, item, place["start"], window, slop))
                    out.append([{"begin": x, "end": y, "item": i, "kind": k} for x, y, i, k in sorted(found, key=repr)])
            yield pa.RecordBatch.from_arrays([batch.column("_k1"), batch.column("_k2"), pa.array(out, arrow)], ["_k1", "_k2", "matches"])

    return joined.select("_k1", "_k2", "text", "places").mapInArrow(run, schema).filter(F.size("matches") > 0).dropDuplicates(["_k1", "_k2"])


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, item_col: str = "item_id", keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The kept columns of every document with ``n_words`` and ``matches``, an array that may be empty."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "matches", "text")]
    index, parts = None, []
    for block in test_blocks(benchmark, item_col, block_words):
        terms = np.unique(block.hashes)
        anchors = choose_anchors(block, terms, term_counts(docs, terms), window, slop)
        stored = positional_index(docs, anchors.terms, keep)
        index = stored if index is None else index
        parts.append(verify(docs, intersect(stored, anchors, slop), block, window, slop))
    if index is None:
        index = positional_index(docs, np.zeros(0, np.uint64), keep)
    columns = [*[F.col("_row").getField(c).alias(c) for c in keep], F.col("n_words")]
    none = F.array().cast("array<struct<begin:int,end:int,item:string,kind:string>>")
    if not parts:
        return index.select(*columns, none.alias("matches"))
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("matches")).alias("matches"))
    found = materialise(found, "text-matches")
    joined = join_by_key(index.drop("_lists"), found, ["_k1", "_k2"], "left", row_bytes=40 + 48 * F.size("matches"))
    return joined.select(*columns, F.coalesce("matches", none).alias("matches"))


def contamination(matched: DataFrame) -> DataFrame:
    """Replaces ``matches`` by counts of words hit and items met by exact phrases, and the verdict."""
    exact = F.filter("matches", lambda m: m["kind"] == "phrase")
    items = F.array_sort(F.array_distinct(F.transform(exact, lambda m: m["item"])))
    hit = F.size(F.array_distinct(F.flatten(F.transform(exact, lambda m: F.sequence(m["begin"], m["end"] - 1))))).cast("long")
    out = without(matched, "n_hit", "n_items", "items_sha256", "contaminated").withColumn("n_hit", hit).withColumn("n_items", F.size(items).cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join(items, ",").cast("binary"), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    bounded_batches(docs.sparkSession)
    marked = docs.select(*[c.alias(n) for c, n in zip(content(), ("_doc1", "_doc2"), strict=True)], "text")
    verdicts = contamination(find_matches(marked, benchmark, window, keep=["_doc1", "_doc2"])).filter("contaminated")
    rows = packed(docs, *content())
    gone = materialise(verdicts.groupBy(F.col("_doc1").alias("_k1"), F.col("_doc2").alias("_k2")).agg(F.count("*").alias("n")), "contaminated-texts")
    return join_by_key(rows, gone.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti", gone, row_bytes=40).select(*fields(docs))
