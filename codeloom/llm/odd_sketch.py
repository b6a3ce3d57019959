"""Near-duplicates of high similarity, by MinHash bands whose candidates are judged on odd sketches.

A document's set holds its different shingles of five words.  ``SAMPLES`` minima of its hashes stand for it; two sets agree
in a sample with a chance of their Jaccard similarity.

* Bands.  ``BANDS`` runs of ``ROWS`` minima are hashed to keys.  Sets of similarity 0.85 share no key once in a hundred
  million times, those of 0.5 in more than a third of cases.
* Odd sketch.  Every minimum flips one of ``BITS`` bits.  What two sets have in common flips a bit twice or not at all in
  the exclusive or of their sketches, so its ones count what they differ in, most precisely when that is little.  A
  pair under one key goes on only if that count is at most ``LIMIT``, which is derived from the exact
  distribution of the count at the wanted similarity: it loses a link once in a million times.
  A second sketch of ``WHOLE`` bits is flipped by every shingle of the set.  Its ones are never more than the shingles
  that two sets differ in, which their sizes bound at the wanted similarity: it loses nothing, and tells sets of up to
  some two thousand shingles apart almost exactly; larger ones are left to the minima.
* Full sets.  What goes on is confirmed on the whole sets of 64-bit shingle hashes.  They are made anew from the texts
  of candidates alone, as all sets together would be larger than the texts.

Components need not all pairs.  Under every key all members are first compared with one hub, the member nearest to
the majority of their sketches.  After that only *outsiders*, whose component is not the hub's, are compared with
members of other components, at first of large keys with a part of them, which links most; the sketches are compared in the join itself, and of the candidates of
an outsider only the likeliest few are confirmed, more from round to round, until it is linked or none is left.  So
no link between components is lost, and a large group of copies costs a pair a copy.  Crowded keys are salted.

Defined results: equal sets are one text, however many documents have it; a null or wordless text has an empty set, no link
and its own id as component; fewer words than a shingle are one shingle; rows that repeat share a component; a
component is named by its smallest id, null ids passed over unless there is no other; ``kept`` marks the rows of that id; an
empty table gives an empty result; further columns come out as they went in, input columns named like an output are
replaced.  A text's words and shingles are held at once, some 100 bytes a word, so a worker's memory follows its longest text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, chunks, fields, join_by_key, materialise, mix, pieces, text_bytes, without, word_hashes, words
from .components import connected_components, merged
from .simhash import _centres, _shingle_bounds

SHINGLE, PERCENT = 5, 85
#: Bands and the minima of each; bits of the sketch of the minima, and of that of the whole set.
BANDS, ROWS, BITS, WHOLE = 32, 5, 256, 512
SAMPLES = BANDS * ROWS
#: Members of a key that one task compares an outsider with.
SALTED = 4096
#: Of keys with more than CROWD members, outsiders first meet one in so many; then all.
CROWD, PARTS = 32, (16, 1)


def ones_limit(similarity: float, samples: int = SAMPLES, bits: int = BITS, lost: float = 1e-6) -> int:
    """The least count of ones that two sketches at this similarity exceed with a chance of at most ``lost``."""
    # After each flip the number of odd bits is one more or one less; a sample that differs flips twice.
    odd, over = np.zeros(bits + 1), np.zeros(bits + 1)
    odd[0] = 1.0
    up = (bits - np.arange(bits + 1)) / bits
    for differ in range(samples + 1):
        chance = math.exp(math.lgamma(samples + 1) - math.lgamma(differ + 1) - math.lgamma(samples - differ + 1) + differ * math.log(1 - similarity) + (samples - differ) * math.log(similarity))
        over += chance * odd
        for _ in range(2):
            odd = np.concatenate([[0.0], (odd * up)[:-1]]) + np.concatenate([(odd * (1 - up))[1:], [0.0]])
    return int(np.flatnonzero(np.cumsum(over[::-1])[::-1] > lost).max())


LIMIT = ones_limit(PERCENT / 100)
#: Words of the sketch of the minima, and of that of the whole set after them.
_MINIMA, _WHOLE = [f"_s{i}" for i in range(BITS // 64)], [f"_w{i}" for i in range(WHOLE // 64)]
_WORDS = _MINIMA + _WHOLE


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE):
    """Runs of rows: first row, row after the last, the sorted distinct hashes of all their shingles, and the number of each row."""
    odd = np.arange(1, shingle + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for first, last, part, offs in chunks(data, offsets):
        w = words(part, offs, NOT_SPACE)
        h = word_hashes(LOWER[part], w)
        lo, _, row, span = _shingle_bounds(w.counts, shingle)
        values = np.zeros(len(lo), np.uint64)
        for i in range(shingle):
            inside = i < span
            values[inside] = mix(values[inside] * odd[i] + h[lo[inside] + i])
        order = np.lexsort((values, row))
        values, row = values[order], row[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        yield first, last, values[new], np.bincount(row[new], minlength=last - first)


def _names(values: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """16 bytes that name each set, whatever text it came from."""
    both = [mix(np.add.reduceat(mix(values ^ np.uint64(c)), heads) + counts.astype(np.uint64)) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    return [x.tobytes() for x in np.ascontiguousarray(np.stack(both, axis=1))]


def sketch_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """For every row the name of its set (None if empty), its size, the keys of its bands and the words of its odd sketches."""
    rows = len(offsets) - 1
    names, sizes = [None] * rows, np.zeros(rows, np.int64)
    keys, sketch = np.zeros((rows, BANDS), np.uint64), np.zeros((rows, len(_WORDS)), np.uint64)
    multipliers = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
    for first, last, values, counts in shingle_sets(data, offsets, shingle):
        full = np.flatnonzero(counts)
        sizes[first:last] = counts
        if not len(full):
            continue
        heads = (np.cumsum(counts) - counts)[full]
        at = first + full
        for i, name in zip(at.tolist(), _names(values, heads, counts[full]), strict=True):
            names[i] = name
        for s, by in enumerate(multipliers):
            least = mix(np.minimum.reduceat(values * by, heads) ^ by)
            keys[at, s // ROWS] = mix(keys[at, s // ROWS] * np.uint64(31) + least + np.uint64(s // ROWS))
            bit = least % np.uint64(BITS)
            sketch[at, (bit // np.uint64(64)).astype(np.int64)] ^= np.uint64(1) << (bit % np.uint64(64))
        bit = mix(values) % np.uint64(WHOLE)
        one, word = np.uint64(1) << (bit % np.uint64(64)), bit // np.uint64(64)
        for i in range(WHOLE // 64):
            sketch[at, BITS // 64 + i] = np.bitwise_xor.reduceat(np.where(word == i, one, np.uint64(0)), heads)
    return names, sizes, keys, sketch


def _add_sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (..., text) without the text and with _t, _n, _bands and the words of the sketch."""
    names = [c for c in docs.columns if c != "text"]
    long = T.LongType()
    added = [T.StructField("_t", T.BinaryType()), T.StructField("_n", long), T.StructField("_bands", T.ArrayType(long)), *[T.StructField(s, long) for s in _WORDS]]

    def run(batches):
        for batch in pieces(batches, len(names)):
            named, sizes, keys, sketch = sketch_sets(*text_bytes(batch.column(len(names))), shingle)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            columns = [pa.array(named, pa.binary()), pa.array(sizes), bands, *[pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(len(_WORDS))]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*names, *[f.name for f in added]])

    return docs.select(*names, "text").mapInArrow(run, T.StructType([*docs.select(*names).schema.fields, *added]))


def _full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(_t, _set) of the column text."""

    def run(batches):
        for batch in pieces(batches, 0):
            for _, _, values, counts in shingle_sets(*text_bytes(batch.column(0)), shingle):
                counts = counts[counts > 0]
                if len(counts):
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(_names(values, ends[:-1], counts), pa.binary()), sets], ["_t", "_set"])

    return docs.select("text").mapInArrow(run, "_t binary, _set array<long>")


def _ones(other: str, names: list[str]) -> Column:
    return sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"{other}{s}"))) for s in names), F.lit(0))


def _alike(limit: int, percent: int, other: str) -> Column:
    """Whether sizes allow the similarity and the sketches make it likely."""
    sizes = 100 * F.least("_n", f"{other}_n") >= percent * F.greatest("_n", f"{other}_n")
    # Sets of sizes a and b and similarity s differ in (a + b)(1 - s) / (1 + s) shingles.
    differ = (100 + percent) * _ones(other, _WHOLE) <= (100 - percent) * (F.col("_n") + F.col(f"{other}_n"))
    return sizes & differ & (_ones(other, _MINIMA) <= limit)


class _Sets:
    """Full sets of texts, made for those that pairs ask for, each once."""

    def __init__(self, docs: DataFrame, key: list[Column], texts: DataFrame, shingle: int):
        self.docs, self.key, self.texts, self.shingle, self.made = docs, key, texts, shingle, None

    def confirm(self, pairs: DataFrame, percent: int) -> DataFrame:
        """The pairs (src, dst) whose sets have this similarity."""
        ends = pairs.select(F.explode(F.array("src", "dst")).alias("_t")).distinct()
        fresh = ends if self.made is None else ends.join(self.made.select("_t"), "_t", "left_anti")
        wanted = materialise(self.texts.select("_t", "_own.r1", "_own.r2").join(fresh, "_t", "left_semi").select("r1", "r2"), "pair-texts")
        rows = join_by_key(self.docs.select(*self.key, "text"), wanted, ["r1", "r2"], "left_semi", row_bytes=16)
        made = materialise(_full_sets(rows, self.shingle).dropDuplicates(["_t"]), "pair-sets")
        first, self.made = self.made is None, made if self.made is None else self.made.unionByName(made)
        sets = self.made if first else self.asked(ends)
        size = 16 + 8 * F.size("_a")
        both = join_by_key(pairs, sets.toDF("src", "_a"), ["src"], row_bytes=size)
        both = join_by_key(both, sets.toDF("dst", "_b"), ["dst"], copies=pairs.groupBy("dst").agg(F.count("*").alias("n")), row_bytes=16 + 8 * F.size("_b"))
        common = F.size(F.array_intersect("_a", "_b"))
        return materialise(both.filter(100 * common >= percent * (F.size("_a") + F.size("_b") - common)).select("src", "dst"), "confirmed-pairs")

    def asked(self, ends: DataFrame) -> DataFrame:
        """Sets made so far that hold those of these texts (_t)."""
        return self.made


class _FewSets(_Sets):
    """Sets for rounds that ask fewer and fewer pairs: those that were made for earlier rounds alone stay out of the joins."""

    def asked(self, ends: DataFrame) -> DataFrame:
        return materialise(join_by_key(self.made, ends, ["_t"], "left_semi", row_bytes=16), "asked-sets")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def similar_components(texts: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """(_t, component) of texts (_t, _own, _n, _bands, sketch) that have a link."""
    limit = ones_limit(percent / 100)
    sketch = texts.select("_t", "_n", *_WORDS)
    keyed = texts.select("_t", F.explode("_bands").alias("_key"))
    shared = materialise(keyed.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-keys")
    members = join_by_key(keyed, shared.select("_key", F.col("n").alias("_size")), ["_key"], copies=shared, row_bytes=16)
    members = materialise(members.join(sketch, "_t"), "members")

    centred = join_by_key(members, _centres(members.withColumnRenamed("_s0", "_fp")), ["_key"], copies=shared, row_bytes=16)
    best = centred.groupBy("_key").agg(F.min(F.struct(F.bit_count(F.col("_s0").bitwiseXOR(F.col("_centre"))).alias("apart"), "_t", "_n", *_WORDS)).alias("h"))
    hubs = materialise(best.select("_key", *[F.col(f"h.{c}").alias(f"h{c}") for c in ("_t", "_n", *_WORDS)]), "hubs")
    met = join_by_key(members, hubs, ["_key"], copies=shared, row_bytes=80).filter(F.col("_t") != F.col("h_t")).filter(_alike(limit, percent, "h"))
    # A text asks the likeliest hub of all its keys.
    likeliest = met.groupBy("_t").agg(F.min(F.struct(_ones("h", _WORDS).alias("ones"), "h_t")).alias("b"))
    tested = materialise(_pairs(likeliest.select("_t", "b.h_t"), "_t", "h_t"), "candidate-pairs")
    confirmed, most, labels, parts = sets.confirm(tested, percent), 1, None, list(PARTS)
    while True:
        if labels is None or not confirmed.isEmpty():
            labels = materialise(connected_components(confirmed) if labels is None else merged(labels, confirmed), "labels")
            named = members.join(labels.withColumnRenamed("id", "_t"), "_t", "left").withColumn("_label", F.coalesce("component", "_t")).drop("component")
            main = hubs.select("_key", F.col("h_t").alias("_t")).join(labels.withColumnRenamed("id", "_t"), "_t", "left").select("_key", F.coalesce("component", "_t").alias("_main"))
            named = materialise(join_by_key(named, main, ["_key"], copies=shared, row_bytes=32), "labelled-members")
            outside = named.filter("_label != _main")
            open_ = materialise(outside.groupBy("_key").agg(F.count("*").alias("n")), "open-keys")
        inside = join_by_key(named, open_.select("_key"), ["_key"], "left_semi", shared, row_bytes=8)
        salts = F.ceil(F.col("_size") / SALTED).cast("int")
        inside = inside.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("_key", "_salt", *[F.col(c).alias(f"o{c}") for c in ("_t", "_n", "_label", *_WORDS)])
        asking = outside.withColumn("_salt", F.pmod(F.xxhash64("_t"), salts).cast("int")).select("_key", "_salt", "_size", "_t", "_n", "_label", *_WORDS).alias("a")
        drawn = F.pmod(F.xxhash64("_t"), F.lit(parts[0])) == F.pmod(F.xxhash64("o_t"), F.lit(parts[0]))
        met = asking.join(inside.alias("b"), (F.col("a._key") == F.col("b._key")) & (F.col("a._salt") == F.col("b._salt")) & ((F.col("_size") <= CROWD) | drawn) & (F.col("_label") != F.col("o_label")) & _alike(limit, percent, "o"))
        # Tried ones are passed over; of the rest the likeliest of each share goes on.
        fresh = met.select(F.least("_t", "o_t").alias("src"), F.greatest("_t", "o_t").alias("dst"), "_t", "o_t", _ones("o", _WORDS).alias("ones")).join(tested, ["src", "dst"], "left_anti")
        some = fresh.groupBy("_t", F.pmod(F.xxhash64("o_t"), F.lit(most)).alias("share")).agg(F.min(F.struct("ones", "o_t")).alias("b"))
        asked = materialise(_pairs(some.select("_t", "b.o_t"), "_t", "o_t"), "candidate-pairs")
        full = len(parts) == 1
        if asked.isEmpty():
            if full:
                return labels.select(F.col("id").alias("_t"), "component")
            confirmed, parts = asked, parts[1:]
            continue
        confirmed, tested, most, parts = sets.confirm(asked, percent), tested.unionByName(asked), most * 256 if full else most, parts[1:] or parts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Every row of docs, without the text, with ``n_shingles``, ``component_id`` and ``kept``; texts link at this Jaccard similarity in per cent."""
    docs = without(docs, "n_shingles", "component_id", "kept")
    out = without(docs, "text")
    id_, text = F.col(f"`{id_col}`"), F.coalesce(F.col("text"), F.lit(""))
    key = [F.xxhash64(id_, text).alias("r1"), F.xxhash64(F.lit(1), id_, text).alias("r2")]
    row = F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("_row")
    marked = materialise(_add_sketches(docs.select(row, id_.alias("_id"), *key, "text"), shingle), "odd-sketches")
    firsts = [F.first(c).alias(c) for c in ("_n", "_bands", *_WORDS)]
    grouped = marked.filter("_t is not null").groupBy("_t").agg(F.min(F.struct("r1", "r2")).alias("_own"), F.min("_id").alias("_least"), F.count("*").alias("n"), *firsts)
    texts = materialise(grouped, "texts")
    found = similar_components(texts, _Sets(docs, key, texts, shingle), percent)
    named = materialise(texts.select("_t", "_least", "n").join(found, "_t", "left").withColumn("component", F.coalesce("component", "_t")), "text-components")
    least = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    named = join_by_key(named, least, ["component"]).select("_t", "component_id")
    judged = join_by_key(marked, named, ["_t"], "left", copies=texts.select("_t", "n"), row_bytes=24)
    own = F.when(F.col("_t").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return judged.select(*fields(out), F.col("_n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("_id")).alias("kept"))
