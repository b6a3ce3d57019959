"""SimHash near-duplicates, found through tables of distances to reference fingerprints.

A fingerprint holds 64 majority bits over the hashes of a text's word shingles (XXH64 with seed 42, three words,
in ``near_duplicates``).  Texts link when their fingerprints differ in at most two bits; a class is a connected
component of links.

Pivot distance tables.  For every different fingerprint the Hamming distances to all references are computed
once and kept beside it.  By the triangle inequality two fingerprints at distance r differ by at most r in
every coordinate.

* Near references: a base and the 64 fingerprints one bit away from it.  The distance to the base less that to
  neighbour i is +1 or -1, so these coordinates are kept as one packed bit each.  They locate: split into four
  quarters, two fingerprints within two bits agree on two whole quarters, and each of the six pairs of quarters
  is a join key.  Plainly said, these coordinates are the fingerprint's bits against the base's, so partners are located by
  blocks of bits; true distances, those to the far references, only discard.
* Far references: 16 fixed pseudo-random fingerprints.  A joined pair is discarded when its largest coordinate
  difference is above the radius; the survivors are verified by counting differing bits.

A key that more than ``CROWD`` fingerprints share is split by further coordinates: those not yet in the key are
quartered again, and so on until keys are small or only two coordinates are left, when four fingerprints at most
can share one.  Two fingerprints within two bits agree on two quarters at every level, so no link is lost.

``keep_one`` works on similarity instead: five-word shingles with a Jaccard similarity of 0.8 or more.  Such texts
are up to some 20 bits apart, where pivots can no longer locate partners.

* Hubs.  Texts that share a band of four minima of hashed shingles (``BANDS`` of them) are compared with the band's hub, the one
  nearest to the majority fingerprint.  That links most, at a pair a text and band; it is no more than a quick start.
* All others.  In the order of their hashes, two sets of similarity s have an element in common among the first
  n - ceil(s n) + 1 of each, and k among k - 1 more.  These prefixes are join keys.  Of two texts that must share k keys the rarest
  shared one is not among the k - 1 most frequent keys of either, so every text leaves out as many of its own (for the least k that
  a partner's size allows): a passage that very many long texts hold locates none of them by itself.  Under a key that is left, every
  text outside the key's most frequent component is compared with all of other components, after a first round over a part of them;
  pairs that share fewer of all keys than their prefixes must are dropped, the others are verified until none is left that could tie
  two components.  So no link between components is lost, however many texts share a band or a key, and a large group costs no pair
  of its own members.

Otherwise pairs are discarded by sizes and parities alone: every shingle of a set flips one bit of its parities, so two of them
differ in no more bits than the sets in shingles.  No pair of the wanted similarity is discarded so.  The others are
verified on their whole sets of 64-bit hashes, which are made anew from the texts of such pairs.  Equal sets are one text.

Only different fingerprints or texts take part, so copies cost one row however many there are.

Defined results: a null or wordless text has fingerprint zero and links like any other; texts shorter than a
shingle use their whole word sequence; repeated rows share a class; a class is named by its smallest id, ignoring
null ids unless there is no other; of rows that are equal in id and text one is kept; an empty table gives an empty
result; input columns named like an output are replaced.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, bounded_batches, chunks, fields, join_by_key, materialise, mix, packed, pieces, text_bytes, without, words
from .components import connected_components, merged

SHINGLE, SEED, MAX_DISTANCE = 3, 42, 2
#: Fingerprints that may share a key before it is split further.
CROWD = 32
#: Of keep_one: words of a shingle, the least similarity, bands and the minima of each.
KEPT_SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 10, 4
#: Of keys of more than CROWD texts, one in so many is asked at first, and there one in so many texts of fingerprints this near; then all.
DRAWN, NEAR_BITS = 16, 12
#: Of a set, one element in so many has to be shared by prefixes beyond the first.
NEED_ONE_IN = 40
_BASE = 0x5A5A5A5A5A5A5A5A
NEAR = [_BASE, *[_BASE ^ (1 << i) for i in range(64)]]
FAR = [int(x) for x in mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
_SHINGLES_AT_ONCE = 1 << 18


def _ones(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row and bit the number of hashes in which it is set; rows ascend."""
    out = np.zeros((rows, 64), np.int64)
    for at in range(0, len(hashes), _SHINGLES_AT_ONCE):
        h, r = hashes[at : at + _SHINGLES_AT_ONCE], row[at : at + _SHINGLES_AT_ONCE]
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return out


def _majority(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    n = np.bincount(row, minlength=rows)
    return ((2 * _ones(hashes, row, rows) > n[:, None]) * weights).sum(axis=1, dtype=np.uint64)


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every row as an unsigned 64-bit value, by XXH64 over the words joined by spaces."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for first, last, part, offs in chunks(data, offsets):
        w = words(part, offs, NOT_SPACE)
        # The words of the chunk again, each followed by one space, so that a shingle is one slice.
        length = w.ends - w.starts
        begin = np.cumsum(length + 1) - length - 1
        joined = np.full(int((length + 1).sum()), 32, np.uint8)
        keep = np.repeat(begin - w.starts, length) + _ranges(w.starts, length)
        joined[keep] = LOWER[part][_ranges(w.starts, length)]
        text, end = memoryview(joined.tobytes()), begin + length
        lo, hi, row, _ = _shingle_bounds(w.counts, shingle)
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(begin[lo].tolist(), end[hi].tolist(), strict=True)], np.uint64)
        out[first:last] = _majority(hashes, row, last - first)
    return out


def _shingle_bounds(counts: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last word, row and number of words of every shingle, for rows of these numbers of words."""
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n)
    lo = _ranges(np.cumsum(counts) - counts, n)
    span = np.minimum(counts, shingle)[row]
    return lo, lo + span - 1, row, span


def _ranges(starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, end to end."""
    total = int(length.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(length) - length), length)


def add_fingerprint(docs: DataFrame, text_col: str = "text", column: str = "_fp") -> DataFrame:
    """docs without the text and with the fingerprint as a signed long."""
    names = [c for c in docs.columns if c != text_col]
    kept = docs.select(*[f"`{c}`" for c in names])
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.LongType())])

    def run(batches):
        for batch in pieces(batches, len(names)):
            found = fingerprints(*text_bytes(batch.column(len(names)))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*names, column])

    return docs.select(*[f"`{c}`" for c in names], F.col(f"`{text_col}`")).mapInArrow(run, schema)


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def pivot_columns(fp: Column) -> list[Column]:
    """``_near``, the packed coordinates to the near references, and ``_far``, those to the far ones."""
    apart = F.struct(*[_distance(fp, _long(r)).cast("tinyint").alias(f"c{i}") for i, r in enumerate(FAR)])
    return [fp.bitwiseXOR(_long(_BASE)).alias("_near"), apart.alias("_far")]


def _within(radius: int, far: str, other: str) -> Column:
    """Whether no coordinate differs by more than the radius."""
    return F.greatest(*[F.abs(F.col(f"{far}.c{i}") - F.col(f"{other}.c{i}")) for i in range(len(FAR))]) <= radius


def _split(rows: DataFrame, width: int) -> DataFrame:
    """Every row under six keys: the key so far with two quarters of the ``width`` coordinates that are left."""
    size = width // 4
    quarter = [F.shiftrightunsigned("_rest", (3 - q) * size).bitwiseAND(F.lit((1 << size) - 1)) for q in range(4)]
    options = []
    for a, b in combinations(range(4), 2):
        c, d = (q for q in range(4) if q not in (a, b))
        options.append(F.struct(F.xxhash64("_key", F.lit(10 * a + b), quarter[a], quarter[b]).alias("key"), F.shiftleft(quarter[c], size).bitwiseOR(quarter[d]).alias("rest")))
    return rows.select("_fp", "_far", F.explode(F.array(*options)).alias("k")).select("_fp", "_far", F.col("k.key").alias("_key"), F.col("k.rest").alias("_rest"))


def fingerprint_links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (src, dst) of the fingerprints (_fp) within MAX_DISTANCE bits."""
    near, far = pivot_columns(F.col("_fp"))
    rows, width, found = distinct.select("_fp", far, F.lit(0).cast("long").alias("_key"), near.alias("_rest")), 64, []
    while True:
        rows = materialise(_split(rows, width), "pivot-keys")
        width //= 2
        sizes = rows.groupBy("_key").agg(F.count("*").alias("n"))
        crowded = materialise(sizes.filter(F.col("n") > (crowd if width > 2 else 1 << 62)), "crowded-keys")
        none = crowded.isEmpty()
        own = rows if none else join_by_key(rows, crowded.select("_key"), ["_key"], "left_anti", crowded)
        left, right = own.select("_key", F.col("_fp").alias("src"), F.col("_far").alias("_f")), own.select("_key", F.col("_fp").alias("dst"), F.col("_far").alias("_g"))
        pairs = left.join(right, "_key").filter("src < dst").filter(_within(MAX_DISTANCE, "_f", "_g"))
        found.append(pairs.filter(_distance(F.col("src"), F.col("dst")) <= MAX_DISTANCE).select("src", "dst"))
        if none:
            return reduce(DataFrame.unionByName, found).distinct()
        rows = join_by_key(rows, crowded.select("_key"), ["_key"], "left_semi", crowded)


def _parallel(df: DataFrame, column: str) -> DataFrame:
    """df over as many tasks as a shuffle has, as its few bytes become many times as many in the next step."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def classes(counted: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(_fp, _class) of different fingerprints (_fp); a class is named by its smallest fingerprint."""
    labels = connected_components(fingerprint_links(_parallel(counted.select("_fp"), "_fp"), crowd)).withColumnRenamed("id", "_fp")
    return counted.join(labels, "_fp", "left").select(*counted.columns, F.coalesce("component", "_fp").alias("_class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", crowd: int = CROWD, keep_text: bool = False) -> DataFrame:
    """Every row of docs with ``fingerprint`` (hex) and ``component_id``, the smallest id of its class."""
    docs = without(docs, "fingerprint", "component_id")
    out = docs if keep_text else without(docs, "text")
    row = F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("_row")
    marked = materialise(add_fingerprint(docs.select(row, F.col(f"`{id_col}`").alias("_id"), "text")), "fingerprints")
    counted = materialise(marked.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count("*").alias("n")), "distinct-fingerprints")
    grouped = materialise(classes(counted, crowd), "classes")
    least = grouped.groupBy("_class").agg(F.min("_least").alias("component_id"))
    named = join_by_key(grouped, least, ["_class"]).select("_fp", "component_id")
    kept = join_by_key(marked, named, ["_fp"], copies=counted)
    return kept.select(*fields(out), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def prefix_lengths(sizes: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """For sets of these sizes the number of smallest hashes to look at, and how many of them a set of similarity ``share`` has too.

    At least share * size elements of either are common, so at most size - that many are not, and the k-th least common element
    comes after at most these and k - 1 others, in both.  The two prefixes share as many as the lesser of their k.
    """
    sizes = sizes.astype(np.int64)
    common = -(-sizes * share.numerator // share.denominator)
    need = np.minimum(1 + sizes // NEED_ONE_IN, np.maximum(common, 1))
    return np.where(sizes > 0, sizes - common + need, 0), need


def sketch_texts(data: np.ndarray, offsets: np.ndarray, shingle: int, bands: int, share: Fraction) -> tuple:
    """For every row: name and size of its set of shingles, fingerprint, hash of each band of minima, parities, prefix.

    Parities are ``WHOLE`` bits, each flipped by the shingles that fall to it; the prefix holds the smallest hashes.
    A row without words has an empty name and an empty set.
    """
    from .odd_sketch import WHOLE, _names, shingle_sets  # it builds on this module

    rows = len(offsets) - 1
    names, sizes, prints = [b""] * rows, np.zeros(rows, np.int64), np.zeros(rows, np.uint64)
    keys, parity, prefixes = np.zeros((rows, bands), np.uint64), np.zeros((rows, WHOLE // 64), np.uint64), []
    seeds = mix(np.arange(1, bands * BAND_ROWS + 1, dtype=np.uint64))
    for first, last, values, counts in shingle_sets(data, offsets, shingle):
        sizes[first:last] = counts
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        heads, at = (np.cumsum(counts) - counts)[full], first + full
        for i, name in zip(at.tolist(), _names(values, heads, counts[full]), strict=True):
            names[i] = name
        prints[first:last] = _majority(values, np.repeat(np.arange(last - first), counts), last - first)
        for n, s in enumerate(seeds):
            least = np.minimum.reduceat((values ^ s) * np.uint64(0x9E3779B97F4A7C15) ^ (values >> np.uint64(29)), heads)
            keys[at, n // BAND_ROWS] = mix(keys[at, n // BAND_ROWS] * np.uint64(31) + least)
        bit = mix(values) % np.uint64(WHOLE)
        one, word = np.uint64(1) << (bit % np.uint64(64)), bit // np.uint64(64)
        for i in range(WHOLE // 64):
            parity[at, i] = np.bitwise_xor.reduceat(np.where(word == i, one, np.uint64(0)), heads)
        prefixes.append(values[_ranges(heads, prefix_lengths(counts[full], share)[0])])
    return names, sizes, prints, keys, parity, np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)


def _add_sketches(docs: DataFrame, shingle: int, bands: int, share: Fraction) -> DataFrame:
    """docs (..., text) without the text and with _t, _n, _need, _spare, _fp, the words of the parities, _bands and _prefix."""
    from .odd_sketch import _WHOLE

    names = [c for c in docs.columns if c != "text"]
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    added = [T.StructField("_t", T.BinaryType()), *[T.StructField(c, long) for c in ("_n", "_need", "_spare", "_fp", *_WHOLE)], T.StructField("_bands", longs), T.StructField("_prefix", longs)]
    schema = T.StructType([*docs.select(*names).schema.fields, *added])

    def run(batches):
        for batch in pieces(batches, len(names)):
            named, sizes, prints, keys, parity, prefix = sketch_texts(*text_bytes(batch.column(len(names))), shingle, bands, share)
            lengths, need = prefix_lengths(sizes, share)
            # A partner has at least this share of the size, and so needs this many common keys, or more.
            spare = prefix_lengths(-(-sizes * share.numerator // share.denominator), share)[1] - 1
            ends = np.concatenate([[0], np.cumsum(lengths)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix.view(np.int64)))
            bands_ = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel(), pa.int64()))
            words_ = [pa.array(np.ascontiguousarray(parity[:, i]).view(np.int64)) for i in range(len(_WHOLE))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(named, pa.binary()), pa.array(sizes), pa.array(need), pa.array(spare), pa.array(prints.view(np.int64)), *words_, bands_, lists], [*names, *[f.name for f in added]])

    return docs.select(*names, "text").mapInArrow(run, schema)


def _centres(rows: DataFrame) -> DataFrame:
    """(_key, _centre): the majority fingerprint of every band's members."""
    sums = rows.groupBy("_key").agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("_fp", i).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(64)])
    return sums.select("_key", reduce(Column.bitwiseOR, [F.when(2 * F.col(f"s{i}") > F.col("n"), _long(1 << i)).otherwise(F.lit(0).cast("long")) for i in range(64)]).alias("_centre"))


def _alike(share: Fraction, other: str) -> Column:
    """Whether sizes and parities allow the similarity; it is true of every pair that has it."""
    from .odd_sketch import _WHOLE, _ones

    num, den = share.numerator, share.denominator
    sizes = den * F.least("_n", f"{other}_n") >= num * F.greatest("_n", f"{other}_n")
    # Sets of sizes a and b and similarity s differ in at most (a + b)(1 - s) / (1 + s) shingles, and each flips one bit.
    return sizes & ((den + num) * _ones(other, _WHOLE) <= (den - num) * (F.col("_n") + F.col(f"{other}_n")))


def _hub_pairs(texts: DataFrame, share: Fraction) -> DataFrame:
    """Pairs (src, dst) of texts with the likeliest hub of their bands; a hub is the member nearest to the majority fingerprint."""
    from .odd_sketch import _WHOLE, _pairs

    sketch = ["_n", "_fp", *_WHOLE]
    keyed = texts.select("_t", F.posexplode("_bands").alias("_b", "_v")).select("_t", F.xxhash64("_b", "_v").alias("_key"))
    shared = materialise(keyed.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-bands")
    members = join_by_key(keyed, shared.select("_key"), ["_key"], "left_semi", shared, row_bytes=8)
    members = materialise(members.join(texts.select("_t", *sketch), "_t"), "band-members")
    apart = join_by_key(members, _centres(members), ["_key"], copies=shared, row_bytes=16).withColumn("_apart", _distance(F.col("_fp"), F.col("_centre")))
    best = apart.groupBy("_key").agg(F.min(F.struct("_apart", "_t", *sketch)).alias("h"))
    hubs = materialise(best.select("_key", *[F.col(f"h.{c}").alias(f"h{c}") for c in ("_t", *sketch)]), "band-hubs")
    met = join_by_key(members, hubs, ["_key"], copies=shared, row_bytes=120).filter(F.col("_t") != F.col("h_t")).filter(_alike(share, "h"))
    likeliest = met.groupBy("_t").agg(F.min(F.struct(_distance(F.col("_fp"), F.col("h_fp")).alias("apart"), "h_t")).alias("b"))
    return materialise(_pairs(likeliest.select("_t", "b.h_t"), "_t", "h_t"), "hub-pairs")


def _prefix_members(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """(_key, _i) of the hashes that the prefixes of different texts (_i) share."""
    owners = texts.filter("_n > 0").select("_own.r1", "_own.r2", "_i")
    keyed = join_by_key(marked.select("r1", "r2", "_prefix"), owners, ["r1", "r2"], row_bytes=24).select("_i", F.explode("_prefix").alias("_key"))
    same = Window.partitionBy("_key")
    keyed = keyed.select("_key", "_i", F.min("_i").over(same).alias("_from"), F.max("_i").over(same).alias("_to"))
    return materialise(keyed.filter("_from < _to").select("_key", "_i"), "shared-prefixes")


def _rare(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members (_key, _i, _often) without the most frequent keys of every text, as many as a pair of the similarity can spare."""
    order = Window.partitionBy("_i").orderBy(F.desc("_often"), "_key")
    ranked = members.withColumn("_rank", F.row_number().over(order)).join(texts.select("_i", "_spare"), "_i")
    return materialise(ranked.filter("_rank > _spare").select("_key", "_i"), "rare-members")


def _sharing(met: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (_i, o_i, need) whose texts share at least ``need`` of all their keys."""
    ends = met.select(F.explode(F.array("_i", "o_i")).alias("_i")).distinct()
    keys = materialise(join_by_key(members, ends, ["_i"], "left_semi", row_bytes=8).groupBy("_i").agg(F.collect_set("_key").alias("_keys")), "keys-of-texts")
    size = 16 + 8 * F.size("_keys")
    both = join_by_key(met, keys, ["_i"], row_bytes=size).withColumnRenamed("_keys", "_own_keys")
    both = join_by_key(both, keys.withColumnRenamed("_i", "o_i"), ["o_i"], copies=met.groupBy("o_i").agg(F.count("*").alias("n")), row_bytes=size)
    return both.filter(F.size(F.array_intersect("_own_keys", "_keys")) >= F.col("need"))


def _label(df: DataFrame, labels: DataFrame, end: str = "_t", column: str = "_label") -> DataFrame:
    """df with the component of the texts in a column."""
    return join_by_key(df, labels.toDF(end, column), [end], "left", row_bytes=32).withColumn(column, F.coalesce(column, end))


def _numbered(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(_i, _label) of all texts; a component is named by the number of its first text, which is shorter than a hash."""
    own = texts.select("_i", "_t")
    linked = join_by_key(labels.toDF("_t", "_first"), own.toDF("_label", "_first"), ["_first"], row_bytes=24).select("_t", "_label")
    return materialise(join_by_key(own, linked, ["_t"], "left", row_bytes=24).select("_i", F.coalesce("_label", "_i").alias("_label")), "numbered")


def _open(members: DataFrame, numbered: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members (_key, _i) of keys that several components share, with _label, the key's most frequent one (_main), _size and the sketches.

    Sketches come last, by text: rows of one text lie together then, and take a fraction of the bytes that they would in order of keys.
    """
    named = members.join(numbered, "_i")
    each = named.groupBy("_key", "_label").agg(F.count("*").alias("n")).groupBy("_key").agg(F.max(F.struct("n", "_label")).alias("m"), F.count("*").alias("labels"), F.sum("n").alias("n"))
    keys = materialise(each.filter("labels > 1").select("_key", F.col("m._label").alias("_main"), "n"), "open-keys")
    shared = join_by_key(named, keys.select("_key", "_main", F.col("n").alias("_size")), ["_key"], copies=keys.select("_key", "n"), row_bytes=24)
    return materialise(shared.join(sketches, "_i"), "open-members")


def _met(named: DataFrame, share: Fraction, columns: list[str], also: Column) -> DataFrame:
    """Pairs under a key of texts outside its main component with those (o) of other components; one row a key and pair."""
    from .odd_sketch import SALTED

    salts = F.ceil(F.col("_size") / SALTED).cast("int")
    inside = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("_key", "_salt", *[F.col(c).alias(f"o{c}") for c in ("_label", *columns)])
    asking = named.filter("_label != _main").withColumn("_salt", F.pmod(F.xxhash64("_t"), salts).cast("int")).select("_key", "_salt", "_size", "_main", "_label", *columns)
    other = (F.col("_label") != F.col("o_label")) & ((F.col("o_label") == F.col("_main")) | (F.col("_t") < F.col("o_t")))
    met = asking.alias("a").join(inside.alias("b"), (F.col("a._key") == F.col("b._key")) & (F.col("a._salt") == F.col("b._salt")) & other & also & _alike(share, "o"))
    return met.withColumns({"src": F.least("_t", "o_t"), "dst": F.greatest("_t", "o_t"), "apart": _distance(F.col("_fp"), F.col("o_fp"))})


def similar_components(texts: DataFrame, marked: DataFrame, sets, share: Fraction) -> DataFrame:
    """(id, component) of texts (_t, _i, _own, _n, _need, _spare, _fp, _bands, parities) that have a link of this similarity; ``marked`` has rows with their prefixes."""
    from .odd_sketch import _WHOLE, _pairs

    percent, columns = float(100 * share), ["_i", "_t", "_n", "_need", "_fp", *_WHOLE]
    tested = _hub_pairs(texts.filter("_n > 0"), share)
    labels = materialise(connected_components(sets.confirm(tested, percent)), "labels")
    numbered, sketches = _numbered(texts, labels), texts.select(*columns)
    members = materialise(_prefix_members(texts, marked).join(numbered, "_i"), "prefix-members")
    open_ = materialise(members.groupBy("_key").agg(F.min("_label").alias("a"), F.max("_label").alias("z"), F.count("*").alias("n")).filter("a < z").select("_key", "n"), "open-keys")
    members = materialise(join_by_key(members.select("_key", "_i"), open_.select("_key", F.col("n").alias("_often")), ["_key"], copies=open_, row_bytes=16).distinct(), "members")
    rare = _rare(members, texts)
    # Alike texts share many keys, so a few of the large ones link most, before all keys are asked.
    large = materialise(rare.groupBy("_key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD), "large-keys")
    if not large.isEmpty():
        named = _open(join_by_key(rare, large.select("_key"), ["_key"], "left_semi", large, row_bytes=8), numbered, sketches)
        drawn = (F.pmod(F.xxhash64("a._key"), F.lit(DRAWN)) == 0) & (F.pmod(F.xxhash64("_t"), F.lit(DRAWN)) == F.pmod(F.xxhash64("o_t"), F.lit(DRAWN)))
        near = _distance(F.col("_fp"), F.col("o_fp")) <= NEAR_BITS
        met = _met(named, share, columns, (F.col("_size") > CROWD) & drawn & near).join(tested, ["src", "dst"], "left_anti")
        asked = materialise(_pairs(met.groupBy("_t").agg(F.min(F.struct("apart", "o_t")).alias("b")).select("_t", "b.o_t"), "_t", "o_t"), "drawn-pairs")
        if not asked.isEmpty():
            labels, tested = materialise(merged(labels, sets.confirm(asked, percent)), "labels"), tested.unionByName(asked)
            numbered = _numbered(texts, labels)
    met = _met(_open(rare, numbered, sketches), share, columns, F.lit(True)).select("src", "dst", "apart", F.least("_need", "o_need").alias("need"), F.least("_i", "o_i").alias("_i"), F.greatest("_i", "o_i").alias("o_i"))
    met = materialise(met.distinct().join(tested, ["src", "dst"], "left_anti"), "met-pairs")
    left, most = materialise(_sharing(met, members.select("_key", "_i")).select("src", "dst", "apart"), "candidate-pairs"), 1
    while True:
        # Of the pairs that could still tie two components, the likeliest of each share of a text's goes on.
        left = materialise(_label(_label(left, labels, "src", "_a"), labels, "dst", "_b").filter("_a != _b").select("src", "dst", "apart"), "left-pairs")
        if left.isEmpty():
            return labels
        asked = left.groupBy("src", F.pmod(F.xxhash64("dst"), F.lit(most)).alias("share")).agg(F.min(F.struct("apart", "dst")).alias("b")).select("src", "b.dst")
        asked, most = materialise(asked, "asked-pairs"), most * 16
        labels = materialise(merged(labels, sets.confirm(asked, percent)), "labels")
        left = left.join(asked, ["src", "dst"], "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", shingle: int = KEPT_SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """One document of each class of similar texts, the one of the smallest id, with its own columns.

    A row is named by the hashes of its id and text.  Those that go are usually few, and are broadcast only
    if counted to be; rows that are equal in id and text are reduced to one.
    """
    from .odd_sketch import _WHOLE, _FewSets

    bounded_batches(docs.sparkSession)
    share = Fraction(similarity).limit_denominator(10_000)
    text, id_ = F.coalesce(F.col("text"), F.lit("")), F.col(f"`{id_col}`")
    key = [F.xxhash64(id_, text).alias("r1"), F.xxhash64(F.lit(1), id_, text).alias("r2")]
    marked = materialise(_add_sketches(docs.select(id_.alias("_id"), *key, "text"), shingle, bands, share), "sketches")
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), "r1", "r2")
    firsts = [F.first(c).alias(c) for c in ("_n", "_need", "_spare", "_fp", "_bands", *_WHOLE)]
    texts = marked.groupBy("_t").agg(F.min(order).alias("_own"), F.count("*").alias("n"), *firsts)
    texts = materialise(texts.withColumn("_i", F.monotonically_increasing_id()), "texts")
    labels = similar_components(texts, marked, _FewSets(docs, key, texts, shingle), share).withColumnRenamed("id", "_t")
    named = materialise(texts.join(labels, "_t", "left").select("_t", "n", "_own", F.coalesce("component", "_t").alias("_class")), "class-members")
    first = named.groupBy("_class").agg(F.min("_own").alias("_first"))
    named = join_by_key(named, first, ["_class"]).select("_t", "_first")
    judged = join_by_key(marked.select("_t", "_id", "r1", "r2"), named, ["_t"], copies=texts.select("_t", "n")).select("r1", "r2", (order == F.col("_first")).alias("_kept"))
    judged = materialise(judged.groupBy("r1", "r2").agg(F.max("_kept").alias("_kept"), F.count("*").alias("n")), "class-verdicts")
    keyed = packed(docs, *key)
    left = join_by_key(keyed, judged.filter("not _kept").select("r1", "r2"), ["r1", "r2"], "left_anti", row_bytes=40)
    repeated = materialise(judged.filter("_kept and n > 1").select("r1", "r2", "n"), "repeated-rows")
    if not repeated.isEmpty():
        twice = join_by_key(left, repeated.select("r1", "r2"), ["r1", "r2"], "left_semi", repeated, row_bytes=40)
        once = twice.groupBy("r1", "r2").agg(F.first("_row").alias("_row"))
        left = join_by_key(left, repeated.select("r1", "r2"), ["r1", "r2"], "left_anti", repeated, row_bytes=40).select("_row").unionByName(once.select("_row"))
    return left.select(*fields(docs))
