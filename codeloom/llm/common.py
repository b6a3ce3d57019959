"""Helpers shared by the training-data operators.

Texts reach Python as Arrow batches.  The tokenisers here work on the raw UTF-8 bytes of a
whole batch at once, so a batch costs a handful of numpy passes and no per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, written

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


shared_dir, materialise = shared_folder, written


def small(df: DataFrame, most: int, row_bytes: Column | int) -> DataFrame:
    """df, marked for broadcast if its rows are counted to hold at most ``most`` bytes."""
    return F.broadcast(df) if _weight(df, row_bytes) <= most else df


def local_path(path: str) -> str | None:
    """The path without its scheme if the file system is a local or mounted one, else None."""
    if path.startswith("file:"):
        path = path[5:]
        return "/" + path.lstrip("/")
    return path if "://" not in path else None


#: Bytes of a batch that goes to Python; ``pieces`` yields as many at once.
BATCH_BYTES = 4 * CHUNK_BYTES


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at BATCH_BYTES, unless it has a bound of its own.

    They would end at 10,000 rows alone, and both the JVM's vectors and the worker hold a batch whole and several times.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and the offsets of its rows; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], at: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in smaller ones, of about ``most`` bytes of text or media in column ``at``, which bounds a worker's memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: first row, row after the last, bytes, offsets."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], bool)


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Everything but the space and \x09-\x0D.
NOT_SPACE = _table(lambda b: b != 32 and not 9 <= b <= 13)
#: Digits, letters and everything outside ASCII; capitals are words once lower-cased.
ALNUM = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 or b >= 128)


class Words(NamedTuple):
    """Words of a run of rows in order: byte bounds, row, and the number of words of each row."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    counts: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of the given kind that do not cross a row's bounds."""
    rows, inside = len(offsets) - 1, kind[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = np.unique(offsets)
    heads, tails = edges[edges < len(data)], edges[edges > 0] - 1
    begins[heads] = inside[heads]
    stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    return Words(starts, ends, row, np.bincount(row, minlength=rows))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for the bytes of one block."""
    up, down = np.full(CHUNK_BYTES, _BASE, np.uint64), np.full(CHUNK_BYTES, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def word_hashes(lowered: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of every word, from cumulative sums over blocks of CHUNK_BYTES bytes.

    The sums of one block are held at a time.  A word that lies in several blocks adds up what each holds of
    it, shifted to its place in the word.
    """
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    up, down = _powers()
    out = np.zeros(len(w.starts), np.uint64)
    sums = np.zeros(min(len(lowered), CHUNK_BYTES) + 1, np.uint64)
    for at in range(0, len(lowered), CHUNK_BYTES):
        block = lowered[at : at + CHUNK_BYTES]
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=sums[1 : len(block) + 1])
        own = slice(int(np.searchsorted(w.ends, at, "right")), int(np.searchsorted(w.starts, at + len(block), "left")))
        starts, ends = np.maximum(w.starts[own] - at, 0), np.minimum(w.ends[own] - at, len(block))
        held = (sums[ends] - sums[starts]) * down[starts]
        if len(held) and w.starts[own][0] < at:
            held[:1] *= np.uint64(pow(_BASE, at - int(w.starts[own][0]), 1 << 64))
        out[own] += held
    return mix(out + (w.ends - w.starts).astype(np.uint64))


def hash_word(word: bytes) -> int:
    """word_hashes of a single lower-cased word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, Words(np.array([0]), np.array([len(data)]), np.array([0]), np.array([1])))[0])


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, whatever their case: an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def with_last(df: DataFrame, last: str, *names: str) -> DataFrame:
    """df without columns of these names and with the column ``last`` at its end."""
    return df.select(*[F.col(f"`{c}`") for c in without(df, last, *names).columns], F.col(f"`{last}`"))


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """The rows of df as one struct ``_row``, beside columns made from them: no name of df can clash with an operator's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *columns)


def fields(df: DataFrame, *but: str) -> list[Column]:
    """The columns of df, taken out of ``_row``."""
    return [F.col("_row").getField(c).alias(c) for c in df.columns if c not in but]


def content(text: Column | str = "text") -> list[Column]:
    """Two hashes that name a text, which is empty if it is null."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]


#: Rows of one key that a task may gather, and how many keys may have more than their share of all rows.
HOT_ROWS, HOT_KEYS = 1_000, 20_000
#: Bytes of a side's part for hot keys that may be broadcast.
HOT_BYTES = 8 << 20


def _weight(df: DataFrame, row_bytes: Column | int) -> int:
    return df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0


def join_by_key(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", copies: DataFrame | None = None, most: int = 8 << 20, row_bytes: Column | int = 64) -> DataFrame:
    """rows joined with side, which has one row a key, without gathering the rows of a frequent key in one task.

    A side of at most ``most`` bytes is broadcast (never if that is 0).  Beyond it the hot keys, those of more than HOT_ROWS rows and
    more than 1 in HOT_KEYS of all rows, are at most HOT_KEYS in number.  Their part of the side is broadcast if its bytes
    are at most HOT_BYTES; otherwise each hot key is dealt over as many salts as it has times that share of the rows, which
    repeats that part at most 2 * HOT_KEYS times in all.  All other keys are shuffled.  ``copies`` (keys, n) says how many
    rows a key has, else they are counted.
    """
    if most and _weight(side, row_bytes) <= most:
        return rows.join(F.broadcast(side), keys, how)
    copies = rows.groupBy(*keys).agg(F.count("*").alias("n")) if copies is None else copies
    total = copies.agg(F.sum("n")).first()[0] or 0
    share = max(HOT_ROWS, total // HOT_KEYS)
    hot = written(copies.filter(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("_salts")), "hot-keys")
    if hot.isEmpty():
        return rows.join(side, keys, how)
    few = F.broadcast(hot.select(*keys))
    cold = rows.join(few, keys, "left_anti").join(side.join(few, keys, "left_anti"), keys, how)
    hot_side = side.join(few, keys, "left_semi")
    if _weight(hot_side, row_bytes) <= HOT_BYTES:
        some = rows.join(few, keys, "left_semi").join(F.broadcast(hot_side), keys, how)
    else:
        hashed = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
        dealt = rows.join(F.broadcast(hot), keys).withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.col("_salts")).cast("int")).drop("_salts")
        everywhere = hot_side.join(F.broadcast(hot), keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
        some = dealt.join(everywhere, [*keys, "_salt"], how).drop("_salt")
    return cold.unionByName(some)
