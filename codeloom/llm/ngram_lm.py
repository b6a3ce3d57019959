"""Interpolated modified Kneser-Ney scoring with counts made in Spark and kept as sorted hash arrays.

The model has orders one and two.  A text's tokens are its lower-cased words and one end; a text begins
where another ends, so the end is also the context of its first word.

Training, all in partitioned and shuffled tasks:

1. Word counts.  Tasks count the word hashes of their rows and send them on in blobs, one for each range of
   the hash.  A range's blobs meet in one task, which stores sorted hashes and counts.  A word's id is its
   rank over all ranges.
2. Bigram counts.  A bigram is 64 bits, its two ids, scrambled by a bijection; ranges of that value again
   meet in one task each, which stores the sorted array and its counts.  Hashing spreads the successors of
   a frequent word over all ranges.  The same tasks sum up, by word id, how many different words come
   before it (its continuation count) and how many of its successors occur once, twice, or more often.
3. Those sums meet by range of ids and are stored beside the words.

Ranges are made in proportion to the bytes of the corpus (``RANGE_BYTES``), so a range fits in a task
whatever the size.  Arrays are written under a temporary name and then renamed, so a task that runs twice
leaves one file.  Workers map an array into memory when they first search it, and keep ``OPEN_MAPS`` of a kind
open; only sizes and discounts, a few numbers a range, pass through the driver.

The arrays live in the folder of spark.checkpoint.dir, which must be mounted on the workers (a local path
in tests, a network or parallel file system on a cluster), as memory mapping needs a file.

Defined results: a null text is an empty one, which is its end alone; without training rows every count is
zero and each token has the probability of one in one; repeated rows count each time and get equal scores;
an empty table gives an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, chunks, hash_word, local_path, materialise, mix, pieces, shared_dir, text_bytes, unmix, without, word_hashes, words

#: Bytes of text for each range of hashes.
RANGE_BYTES = 16 << 20
#: Different keys that a counting task holds before it sends them on.
HELD_KEYS = 1_000_000
#: Files of one kind that a worker keeps mapped at a time.
OPEN_MAPS = 100
#: A space is in no word, so its hash can stand for the end of a text.
END = np.uint64(hash_word(b" "))
SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


class Model(NamedTuple):
    """Where the arrays are, the sizes of the id ranges, and the numbers that scoring needs."""

    folder: str
    ranges: int
    starts: np.ndarray
    tokens: int
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    lower_total: int
    lower_backoff: float


def _save(folder: str, name: str, array: np.ndarray) -> None:
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


class _Arrays:
    """The stored arrays of one kind, a range each, mapped when first asked for; the least used maps are closed."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.open = folder, name, OrderedDict()

    def __getitem__(self, i: int) -> np.ndarray:
        if i in self.open:
            self.open.move_to_end(i)
        else:
            path = f"{self.folder}/{self.name}-{i}.npy"
            self.open[i] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, np.uint64)
            if len(self.open) > OPEN_MAPS:
                self.open.popitem(last=False)
        return self.open[i]


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of a run of rows, ends included; each token's row; tokens of each row."""
    w = words(data, offsets, NOT_SPACE)
    n = w.counts + 1
    ends = np.cumsum(n) - 1
    out = np.empty(int(n.sum()), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = word_hashes(LOWER[data], w)
    return out, np.repeat(np.arange(len(n)), n), n


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts[order], heads, dtype=counts.dtype)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a 64-bit key by its leading bits; ranges is a power of two."""
    bits = ranges.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


class _Counter:
    """Counts keys; what it holds is sent on as one blob a range."""

    def __init__(self, ranges: int):
        self.ranges, self.keys, self.counts, self.held = ranges, [], [], 0

    def add(self, keys: np.ndarray):
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n.astype(np.uint32))
        self.held += len(k)
        if self.held > HELD_KEYS:
            self._merge()

    def _merge(self):
        k, n = _summed(np.concatenate(self.keys), np.concatenate(self.counts)) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        self.keys, self.counts, self.held = [k], [n], len(k)

    @property
    def full(self) -> bool:
        return self.held > HELD_KEYS // 2 and len(self.keys) == 1

    def send(self):
        self._merge()
        (k,), (n,) = self.keys, self.counts
        self.keys, self.counts, self.held = [], [], 0
        bounds = np.searchsorted(_range_of(k, self.ranges), np.arange(self.ranges + 1))
        at = np.flatnonzero(np.diff(bounds))
        blob = [pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in at], pa.binary()) for x in (k, n)]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *blob], ["part", "keys", "counts"])


_BLOBS = "part int, keys binary, counts binary"


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The blobs of a column end to end."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


def _count(texts: DataFrame, ranges: int, keys_of) -> DataFrame:
    """Blobs of counted keys; ``keys_of`` makes keys of the bytes of a run of rows."""

    def run(batches):
        counter = _Counter(ranges)
        for batch in pieces(batches, 0):
            for _, _, part, offs in chunks(*text_bytes(batch.column(0))):
                counter.add(keys_of(part, offs))
                if counter.full:
                    yield counter.send()
        if counter.held:
            yield counter.send()

    return texts.mapInArrow(run, _BLOBS)


def _by_range(blobs: DataFrame, ranges: int, store, schema: str) -> DataFrame:
    """``store`` over the blobs of each range: a range is a partition of its own."""

    def run(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for part in batch.column(0).unique().to_pylist():
                held.setdefault(part, []).append(batch.filter(pc.equal(batch.column(0), part)))
        for part in sorted(held):
            yield from store(pa.Table.from_batches(held.pop(part))).to_batches()

    return blobs.repartitionById(ranges, F.col("part")).mapInArrow(run, schema)


class _Words:
    """The stored words, found by hash."""

    def __init__(self, folder: str, ranges: int, starts: np.ndarray):
        self.ranges, self.starts = ranges, starts
        self.hashes = _Arrays(folder, "words")

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The words' ids, -1 for words that are not stored."""
        different, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(different), -1, np.int64)
        bounds = np.searchsorted(_range_of(different, self.ranges), np.arange(self.ranges + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            stored, asked = self.hashes[i], different[bounds[i] : bounds[i + 1]]
            if len(stored):
                at = np.minimum(np.searchsorted(stored, asked), len(stored) - 1)
                out[bounds[i] : bounds[i + 1]] = np.where(stored[at] == asked, self.starts[i] + at, -1)
        return out[back]


def _pairs(ids: np.ndarray, row: np.ndarray, end: int) -> np.ndarray:
    """The scrambled key of every token with the token before it."""
    before = np.concatenate([[end], ids[:-1]])
    before[np.concatenate([[True], row[1:] != row[:-1]])] = end
    return mix(before.astype(np.uint64) << np.uint64(32) | (ids.astype(np.uint64) & np.uint64(0xFFFFFFFF)))


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """The three discounts from the numbers of keys that occur 1, 2, 3 and 4 times; 0.5 where they are unknown."""
    n1, n2, n3, n4 = map(float, n)
    if min(n1, n2) <= 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


def _discount_of(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts the texts and stores the arrays."""
    spark = docs.sparkSession
    folder = local_path(shared_dir(spark, "ngram-lm"))
    if folder is None:
        raise ValueError("spark.checkpoint.dir must be a mounted folder: workers map the model's arrays into memory")
    os.makedirs(folder, exist_ok=True)
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(0, int(size // RANGE_BYTES).bit_length())

    def store_words(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, counts = _summed(_joined(table.column("keys"), np.uint64), _joined(table.column("counts"), np.uint32).astype(np.int64))
        _save(folder, f"words-{part}", keys)
        _save(folder, f"counts-{part}", counts)
        return pa.table({"part": pa.array([part], pa.int32()), "size": pa.array([len(keys)], pa.int64()), "tokens": pa.array([counts.sum()], pa.int64())})

    blobs = _count(texts, ranges, lambda part, offs: _tokens(part, offs)[0])
    found = _by_range(blobs, ranges, store_words, "part int, size long, tokens long").collect()
    sizes = np.zeros(ranges, np.int64)
    for r in found:
        sizes[r.part] = r.size
    starts, tokens = np.concatenate([[0], np.cumsum(sizes)]), sum(r.tokens for r in found)
    if starts[-1] >= 1 << 32:
        raise ValueError("more than 2 ** 32 different words")

    opened = {}

    def vocabulary() -> tuple[_Words, int]:
        if not opened:
            stored = _Words(folder, ranges, starts)
            opened["words"] = stored, int(stored.ids(np.array([END]))[0])
        return opened["words"]

    def pairs_of(part, offs):
        stored, end = vocabulary()
        hashes, row, _ = _tokens(part, offs)
        return _pairs(stored.ids(hashes), row, end)

    def store_pairs(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, counts = _summed(_joined(table.column("keys"), np.uint64), _joined(table.column("counts"), np.uint32))
        _save(folder, f"pairs-{part}", keys)
        _save(folder, f"pair-counts-{part}", counts)
        plain = unmix(keys)
        before, word = (plain >> np.uint64(32)).astype(np.int64), (plain & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows = {"part": [-1], "ids": [b""], "sums": [np.array([(counts == i).sum() for i in (1, 2, 3, 4)], np.uint32).tobytes()]}
        used, to = np.unique(np.concatenate([before, word]), return_inverse=True)
        sums = np.zeros((len(used), 4), np.uint32)
        sums[:, 0] = np.bincount(to[len(before) :], minlength=len(used))
        for i, same in enumerate((counts == 1, counts == 2, counts > 2), 1):
            sums[:, i] = np.bincount(to[: len(before)][same], minlength=len(used))
        bounds = np.searchsorted(used, starts)
        for i in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[i], bounds[i + 1])
            rows["part"].append(i)
            rows["ids"].append((used[own] - starts[i]).astype(np.uint32).tobytes())
            rows["sums"].append(sums[own].tobytes())
        return pa.table([pa.array(rows["part"], pa.int32()), pa.array(rows["ids"], pa.binary()), pa.array(rows["sums"], pa.binary())], ["part", "ids", "sums"])

    partial = materialise(_by_range(_count(texts, ranges, pairs_of), ranges, store_pairs, "part int, ids binary, sums binary"), "ngram-sums")

    def store_sums(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        sums = np.zeros((int(sizes[part]), 4), np.uint32)
        for ids, own in zip(table.column("ids"), table.column("sums"), strict=True):
            sums[np.frombuffer(ids.as_buffer(), np.uint32)] += np.frombuffer(own.as_buffer(), np.uint32).reshape(-1, 4)
        _save(folder, f"sums-{part}", sums)
        before = sums[:, 0]
        return pa.table({"part": [part], "total": [int(before.sum(dtype=np.int64))]} | {f"n{i}": [int((before == i).sum())] for i in (1, 2, 3, 4)} | {"more": [int((before > 2).sum())]}, schema=pa.schema([("part", pa.int32()), *[(n, pa.int64()) for n in ("total", "n1", "n2", "n3", "n4", "more")]]))

    lower = partial.filter("part >= 0").groupBy("part").applyInArrow(store_sums, "part int, total long, n1 long, n2 long, n3 long, n4 long, more long").collect()
    # One row of 16 bytes a range.
    times = sum((np.frombuffer(r.sums, np.uint32).astype(np.int64) for r in partial.filter("part = -1").select("sums").collect()), np.zeros(4, np.int64))
    lower_n = np.array([sum(r[f"n{i}"] for r in lower) for i in (1, 2, 3, 4)], np.int64)
    total, d = sum(r.total for r in lower), _discounts(lower_n)
    backoff = (d[0] * lower_n[0] + d[1] * lower_n[1] + d[2] * sum(r.more for r in lower)) / total if total else 1.0
    return Model(folder, ranges, starts, tokens, _discounts(times), d, total, float(backoff))


class Scorer:
    """A worker's view of a model: its arrays, mapped into memory."""

    def __init__(self, model: Model):
        self.m = model
        self.words = _Words(model.folder, model.ranges, model.starts)
        self.counts, self.pairs, self.pair_counts, self.sums = (_Arrays(model.folder, name) for name in ("counts", "pairs", "pair-counts", "sums"))
        self.end = int(self.words.ids(np.array([END]))[0])

    def _by_id(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of words; zero for the unknown."""
        different, back = np.unique(ids, return_inverse=True)
        counts, sums = np.zeros(len(different), np.int64), np.zeros((len(different), 4), np.int64)
        bounds = np.searchsorted(different, self.m.starts)
        for i in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[i], bounds[i + 1])
            at = different[own] - self.m.starts[i]
            counts[own] = self.counts[i][at]
            stored = self.sums[i]
            if len(stored):
                sums[own] = stored[at]
        return counts[back], sums[back]

    def _pair_counts(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        asked, out = keys[order], np.zeros(len(keys), np.int64)
        bounds = np.searchsorted(_range_of(asked, self.m.ranges), np.arange(self.m.ranges + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            own, stored = slice(bounds[i], bounds[i + 1]), self.pairs[i]
            if len(stored):
                at = np.minimum(np.searchsorted(stored, asked[own]), len(stored) - 1)
                out[order[own]] = np.where(stored[at] == asked[own], self.pair_counts[i][at], 0)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        rows = len(offsets) - 1
        out = {"n_tokens": np.zeros(rows, np.int64), "n_known": np.zeros(rows, np.int64), "base_score": np.zeros(rows), "score": np.zeros(rows)}
        m, size = self.m, int(self.m.starts[-1]) + 1
        for first, last, part, offs in chunks(data, offsets):
            hashes, row, n = _tokens(part, offs)
            ids = self.words.ids(hashes)
            count, sums = self._by_id(ids)
            lower = np.maximum(sums[:, 0] - _discount_of(sums[:, 0], m.lower_discounts), 0) / max(m.lower_total, 1) + m.lower_backoff / size
            # The context of a row's first token is the end; its numbers are those of the token before otherwise.
            starts = np.concatenate([[True], row[1:] != row[:-1]])
            end_count, end_sums = self._by_id(np.array([self.end]))
            context, successors = np.roll(count, 1), np.roll(sums, 1, axis=0)
            context[starts], successors[starts] = end_count[0], end_sums[0]
            seen = np.zeros(len(ids), np.int64)
            known = ids >= 0
            before = np.roll(ids, 1)
            before[starts] = self.end
            both = known & (before >= 0)
            seen[both] = self._pair_counts(mix(before[both].astype(np.uint64) << np.uint64(32) | ids[both].astype(np.uint64)))
            d = m.discounts
            left = successors[:, 1] * d[0] + successors[:, 2] * d[1] + successors[:, 3] * d[2]
            some = context > 0
            p = np.where(some, (np.maximum(seen - _discount_of(seen, d), 0) + left * lower) / np.maximum(context, 1), lower)
            at = np.cumsum(n) - n
            out["n_tokens"][first:last] = n
            out["n_known"][first:last] = np.add.reduceat(known.astype(np.int64), at)
            out["base_score"][first:last] = np.add.reduceat(np.log10((count + 1) / (m.tokens + size)), at)
            out["score"][first:last] = np.add.reduceat(np.log10(p), at)
        return out


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the text and with SCORES and ``perplexity``."""
    kept = without(docs, text_col, *SCORES, "perplexity")
    names = kept.columns
    kinds = {"base_score": T.DoubleType(), "score": T.DoubleType(), "perplexity": T.DoubleType()}
    added = [*SCORES, "perplexity"]
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, kinds.get(n, T.LongType())) for n in added]])
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`"))

    def run(batches):
        scorer = Scorer(model)
        for batch in pieces(batches, len(names)):
            found = scorer.score(*text_bytes(batch.column(len(names))))
            found["train_tokens"] = np.full(batch.num_rows, model.tokens)
            found["perplexity"] = 10 ** np.minimum(-found["score"] / np.maximum(found["n_tokens"], 1), 300)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(found[n]) for n in added]], [*names, *added])

    return source.mapInArrow(run, schema)


def score_held_out(docs: DataFrame, held_out: Column, text_col: str = "text") -> DataFrame:
    """Learns from the rows that are not held out and scores them all."""
    marked = without(docs, "held_out").withColumn("held_out", held_out)
    return score_texts(marked, train(marked.filter(~F.col("held_out")), text_col), text_col)
