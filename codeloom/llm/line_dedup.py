"""Line dedup by a deletion-neighbourhood join, in DataFrame operations alone.

A line is its words, the runs between ASCII spaces and tabs.  Two lines are near-duplicates when one word
replaced, added or left out turns one into the other; that is the edit bound.  A line loses to any earlier
line, in the order of document and line number, that equals it or is its near-duplicate.

* Different lines are reduced to a pair of hashes and their first occurrence, so copies cost one row.
* Half keys: one edit leaves the first or the last half of a line as it was, so only lines that share a
  half with another line go on.  No near-duplicate is lost by this.
* Every remaining line emits, as hashed keys, itself and all its variants with one word deleted.  Lines
  with the same variant at the same position differ by one replaced word; a line that equals another's
  variant lacks one word of it.  A key's minimum says which line is earliest; the pairs within a key are
  never written out, so a thousand near copies cost a thousand rows and not a million.
* The winner of each line is verified on the words themselves by an edit distance.

Intermediate tables (shared halves, rivals, lost lines) are broadcast only if their bytes are counted to be
few (``BROADCAST_BYTES``); larger ones, and in any case the tables of all lines, are joined by a shuffle that
leaves out hot keys (``join_by_key``), so a line or half that very many documents share is not gathered in one task.

Every line that is not blank takes part, however short; ``min_words`` can leave out lines of fewer words.  Lines of fewer
than ``near_min_words`` (five) are compared for equality only.

Defined results: a null text stays null and an empty one empty; a document all of whose lines go has an
empty text and remains a row; rows that repeat with the same id and text count as one document and are
treated alike; null ids come last in the order; ties of ids go by the hash of the text; an empty table gives
an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_by_key, materialise, packed, small, without

MIN_WORDS, NEAR_MIN_WORDS = 1, 5
BROADCAST_BYTES = 8 << 20


def _each_line(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns with ``_line``, the number of a line, and ``_words``.

    Splits at one character and an array of one row, which makes the words a column and not an expression
    that is computed for every use, keep this pass over the whole corpus cheap.
    """
    spaced = F.array_join(F.split("text", "\t"), " ")
    each = docs.select(*columns, F.posexplode(F.split(spaced, "\n")).alias("_line", "_text"))
    words = F.array_remove(F.split("_text", " "), "")
    return each.select(*columns, "_line", F.explode(F.array(words)).alias("_words"))


def _half_keys(words: Column) -> list[Column]:
    """Hashes of the first and last halves, for this many words and for one more.

    With N the words of the longer line, either line keeps its first or its last (N - 1) / 2 words.
    """
    n, keys = F.size(words), []
    for more in (0, 1):
        half = F.floor((n + more - 1) / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), n + more, F.slice(words, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("last"), n + more, F.slice(words, n - half + 1, half)))
    return keys


def deletion_keys(lines: DataFrame) -> DataFrame:
    """(_rank, at, size, key) of lines (_rank, _words): a line itself at 0, and its variant without word ``at``.

    A sequence's key is the exclusive-or of the hashes of (word, position), so deleting a word re-hashes
    nothing: the words behind it count with the position before theirs.  Running and total exclusive-ors
    are window aggregates over one line.
    """
    each = lines.select("_rank", F.posexplode("_words").alias("_pos", "_word"))
    each = each.select("_rank", "_pos", F.xxhash64("_word", "_pos").alias("kept"), F.xxhash64("_word", F.col("_pos") - 1).alias("moved"))
    line, before = W.partitionBy("_rank").orderBy("_pos"), W.partitionBy("_rank").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    held = each.select(
        "_rank", "_pos", "moved",
        F.coalesce(F.bit_xor(F.col("kept").bitwiseXOR(F.col("moved"))).over(before), F.lit(0)).alias("prefix"),
        F.bit_xor("kept").over(whole).alias("all_kept"), F.bit_xor("moved").over(whole).alias("all_moved"), F.count("*").over(whole).cast("int").alias("n"),
    )
    variant = F.struct((F.col("_pos") + 1).alias("at"), (F.col("n") - 1).alias("size"), F.col("prefix").bitwiseXOR(F.col("moved")).bitwiseXOR(F.col("all_moved")).alias("key"))
    itself = F.struct(F.lit(0).alias("at"), F.col("n").alias("size"), F.col("all_kept").alias("key"))
    return held.select("_rank", F.explode(F.when(F.col("_pos") == 0, F.array(itself, variant)).otherwise(F.array(variant))).alias("v")).select("_rank", "v.at", "v.size", "v.key")


def _documents(docs: DataFrame, id_col: str) -> DataFrame:
    """(_id, text, _d1, _d2): the last two are hashes that name a document by its id and text."""
    key = [F.col(f"`{id_col}`"), F.col("text")]
    return docs.select(key[0].alias("_id"), "text", F.xxhash64(*key).alias("_d1"), F.xxhash64(F.lit(1), *key).alias("_d2"))


def lines(docs: DataFrame, id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each line that takes part: its place, hashes of its words, and the words."""
    each = _each_line(_documents(docs, id_col), "_id", "_d1", "_d2").filter(F.size("_words") >= min_words)
    place = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_d1"), F.col("_d2"), F.col("_line").alias("line"))
    return each.select(place.alias("_at"), F.xxhash64("_words").alias("_k1"), F.xxhash64(F.lit(1), "_words").alias("_k2"), "_words")


def losers(docs: DataFrame, id_col: str = "doc_id", min_words: int = MIN_WORDS, near_min_words: int = NEAR_MIN_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(_d1, _d2, _line) of all lines that an earlier equal or near-duplicate line beats."""
    if near_min_words < NEAR_MIN_WORDS:
        raise ValueError(f"near_min_words is {NEAR_MIN_WORDS} at least")
    halves = F.array(*_half_keys(F.col("_words")))
    occurrences = lines(docs, id_col, min_words).select("_at", "_k1", "_k2", F.when(F.size("_words") >= near_min_words, halves).alias("_halves"))
    occurrences = materialise(occurrences, "lines")
    first = materialise(occurrences.groupBy("_k1", "_k2").agg(F.min("_at").alias("_first"), F.count("*").alias("n"), F.first("_halves").alias("_halves")), "first-lines")

    # Lines that share a half with a different line, numbered in order of their first occurrence.
    keyed = first.filter("_halves is not null").select("_k1", "_k2", "_first", F.explode("_halves").alias("_half"))
    shared = keyed.groupBy("_half").agg(F.min("_k1").alias("_lo"), F.max("_k1").alias("_hi"), F.count("*").alias("n")).filter("_lo != _hi").select("_half", "n")
    shared = materialise(shared, "shared-halves")
    rivals = join_by_key(keyed, shared.select("_half"), ["_half"], "left_semi", shared, broadcast_bytes, 8).select("_k1", "_k2", "_first").distinct()
    rivals = materialise(rivals.orderBy("_first").withColumn("_rank", F.monotonically_increasing_id()), "rivals")

    # Their words are taken from the first occurrence alone.
    placed = rivals.select("_rank", "_k1", "_k2", F.col("_first._d1").alias("_d1"), F.col("_first._d2").alias("_d2"), F.col("_first.line").alias("_line"))
    source = _documents(docs, id_col).join(small(placed.select("_d1", "_d2").distinct(), broadcast_bytes, 32), ["_d1", "_d2"], "left_semi")
    texts = _each_line(source, "_d1", "_d2").join(small(placed, broadcast_bytes, 72), ["_d1", "_d2", "_line"])
    spelt = materialise(texts.dropDuplicates(["_rank"]).select("_rank", "_k1", "_k2", "_words"), "rival-lines")
    keys = materialise(deletion_keys(spelt), "deletion-keys")

    # For each key that several lines have, and then for each key and position, the earliest line.
    shared = keys.groupBy("size", "key").agg(F.min("_rank").alias("any"), F.max("_rank").alias("last"), F.min(F.when(F.col("at") == 0, F.col("_rank"))).alias("full"), F.count("*").alias("n"))
    shared = materialise(shared.filter("any != last").drop("last"), "shared-keys")
    rest = materialise(join_by_key(keys, shared.drop("n"), ["size", "key"], "inner", shared.select("size", "key", "n"), broadcast_bytes, 32), "shared-variants")
    least = materialise(rest.groupBy("size", "key", "at").agg(F.min("_rank").alias("least"), F.count("*").alias("n")), "earliest-lines")
    winner = F.when(F.col("at") == 0, F.col("any")).otherwise(F.least("least", "full"))
    ranked = join_by_key(rest, least.drop("n"), ["size", "key", "at"], "inner", least.drop("least"), 0)
    beaten = materialise(ranked.withColumn("w", winner).filter("w < _rank").groupBy("_rank").agg(F.min("w").alias("w")), "beaten-lines")
    winners = beaten.groupBy("w").agg(F.count("*").alias("n"))
    words = spelt.join(winners.select(F.col("w").alias("_rank")), "_rank", "left_semi").select(F.col("_rank").alias("w"), F.col("_words").alias("_other"))
    pairs = join_by_key(beaten.join(spelt, "_rank"), words, ["w"], "inner", winners, 0)
    near_lost = pairs.filter(within_one_edit(F.col("_words"), F.col("_other"))).select("_k1", "_k2", F.lit(True).alias("_near"))

    judged = first.select("_k1", "_k2", "_first", "n").join(materialise(near_lost, "near-lines"), ["_k1", "_k2"], "left").filter("_near is not null or n > 1")
    judged = materialise(judged, "judged-lines")
    decided = join_by_key(occurrences.select("_k1", "_k2", "_at"), judged.drop("n"), ["_k1", "_k2"], "inner", judged.select("_k1", "_k2", "n"), 0)
    return decided.filter(F.col("_near").isNotNull() | (F.col("_at") != F.col("_first"))).select("_at._d1", "_at._d2", F.col("_at.line").alias("_line"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether the edit distance of two word arrays is at most one.

    The words that both begin with and those that both end with must leave at most one word of either.
    """
    least = F.least(F.size(a), F.size(b))
    most = F.greatest(F.size(a), F.size(b))
    steps = F.when(least > 0, F.sequence(F.lit(1), F.greatest(least, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def run(x, y):
        wrong = F.filter(steps, lambda i: F.element_at(x, i) != F.element_at(y, i))
        return F.when(F.size(wrong) == 0, least).otherwise(F.element_at(wrong, 1) - 1)

    head = run(a, b)
    tail_wrong = F.filter(steps, lambda i: F.element_at(a, -i) != F.element_at(b, -i))
    tail = F.when(F.size(tail_wrong) == 0, least).otherwise(F.element_at(tail_wrong, 1) - 1)
    return (most - least <= 1) & (F.least(head + tail, least) >= most - 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", min_words: int = MIN_WORDS, near_min_words: int = NEAR_MIN_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with the losing lines taken out of ``text``, and ``lines_removed``."""
    docs = without(docs, "lines_removed")
    gone = losers(docs, id_col, min_words, near_min_words, broadcast_bytes).groupBy("_d1", "_d2").agg(F.collect_set("_line").alias("_gone"))
    gone = materialise(gone, "lost-lines")
    key = [F.col(f"`{id_col}`"), F.col("text")]
    rows = packed(docs, F.xxhash64(*key).alias("_d1"), F.xxhash64(F.lit(1), *key).alias("_d2"))
    marked = join_by_key(rows, gone, ["_d1", "_d2"], "left", most=broadcast_bytes, row_bytes=40 + 4 * F.size("_gone"))
    text = F.col("_row").getField("text")

    def rest(parts):
        kept = F.array_except(F.sequence(F.lit(1), F.size(parts)), F.transform("_gone", lambda i: i + 1))
        return F.array_join(F.transform(kept, lambda i: F.element_at(parts, i)), "\n")

    # The array of one element makes the lines a variable, so that a text is split once.
    rest = F.transform(F.array(F.split(text, "\n")), rest)[0]
    left = F.when(F.col("_gone").isNull(), text).otherwise(rest).alias("text")
    columns = [left if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return marked.select(*columns, F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("lines_removed"))
