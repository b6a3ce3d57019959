"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the bytes of whole texts, a batch at a time.  Trees are grown level by
level on quantile bins of a bounded sample of labelled rows (``MAX_TRAINING_ROWS``), all nodes of a
level from one histogram, and kept as flat arrays (feature, threshold, leaf value) of complete binary
trees, so that scoring moves all rows of a batch down a tree with one numpy gather per level.

Defined results: null and empty texts have zero statistics and are scored like any other row; with no
usable label every score is 0.5 and with labels of one kind it is near that label; repeated rows get
equal scores; an empty table gives an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, bounded_batches, chunks, fields, packed, pieces, remainder, text_bytes, with_last, without, word_hashes, words
from .labelled import training_rows

MAX_TRAINING_ROWS = 20_000
MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.3
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "bang_share", "stop_share",
    "wide_share", "space_share", "lines_per_word", "distinct_share", "repeat_share", "top_share", "bigram_share", "longest_word",
)


def _share(kind: str) -> np.ndarray:
    return np.array([chr(b) in kind for b in range(256)], bool)


_UPPER, _DIGIT, _SPACE = _share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _share("0123456789"), _share(" \t\r\x0b\x0c")
_SYMBOL, _BANG, _STOP, _LINE = _share("#$%&*+/<=>@[\\]^_`{|}~"), _share("!?"), _share(".,;:"), _share("\n")
_WIDE = np.arange(256) >= 128


def _distinct(row: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number of different values, and the count of its commonest one."""
    order = np.lexsort((values, row))
    r, v = row[order], values[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(r)))
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, r[at], runs)
    return np.bincount(r[at], minlength=rows), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(STATISTICS)), np.float32)
    for first, last, part, offs in chunks(data, offsets):
        n, size = last - first, np.diff(offs)

        def count(table, part=part, offs=offs):
            sums = np.zeros(len(part) + 1, np.int64)
            np.cumsum(table[part], out=sums[1:])
            return sums[offs[1:]] - sums[offs[:-1]]

        w = words(part, offs, NOT_SPACE)
        h = word_hashes(LOWER[part], w)
        length = w.ends - w.starts
        total = np.bincount(w.row, weights=length, minlength=n)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, w.row, length)
        different, top = _distinct(w.row, h, n)
        same = w.row[1:] == w.row[:-1]
        repeats = np.bincount(w.row[1:][same & (h[1:] == h[:-1])], minlength=n)
        pairs, _ = _distinct(w.row[1:][same], (h[1:] * np.uint64(31) + h[:-1])[same], n)
        b, k = np.maximum(size, 1), np.maximum(w.counts, 1)
        out[first:last] = np.stack(
            [
                np.log1p(size), np.log1p(w.counts), total / k, count(_UPPER) / b, count(_DIGIT) / b, count(_SYMBOL) / b, count(_BANG) / b, count(_STOP) / b,
                count(_WIDE) / b, count(_SPACE) / b, count(_LINE) / k, different / k, repeats / k, top / k, pairs / np.maximum(w.counts - 1, 1), np.log1p(longest),
            ],
            axis=1,
        )
    return out


class Trees(NamedTuple):
    """Complete binary trees of one depth: node i has children 2i+1 and 2i+2; leaves follow the nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0) -> Trees:
    """Boosts the logistic loss; every level of a tree is split from one histogram over all its nodes."""
    n, k = x.shape
    positive = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(positive / (1 - positive)))
    feature, threshold = np.zeros((n_trees, 2**depth - 1), np.int32), np.full((n_trees, 2**depth - 1), np.inf, np.float32)
    leaf = np.zeros((n_trees, 2**depth), np.float32)
    if n < 2 or y.min() == y.max():
        return Trees(feature[:0], threshold[:0], leaf[:0], start, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(n, start)
    least = max(2.0, 0.0005 * n)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            local = node - base
            cell = (local[:, None] * k + np.arange(k)) * bins + binned
            g, h, c = (np.bincount(cell.ravel(), weights=np.repeat(v, k), minlength=width * k * bins).reshape(width, k, bins) for v in (grad, hess, np.ones(n)))
            gl, hl, cl = (np.cumsum(v, axis=2)[:, :, :-1] for v in (g, h, c))
            gt, ht, ct = (v.sum(axis=2, keepdims=True) for v in (g, h, c))
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(cl < least) | (ct - cl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                j, b = divmod(int(best[i]), bins - 1)
                if gain[i, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, base + i], threshold[t, base + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - (2**depth - 1)
        leaf[t] = -rate * np.bincount(at, weights=grad, minlength=2**depth) / (np.bincount(at, weights=hess, minlength=2**depth) + l2)
        margin += leaf[t][at]
    return Trees(feature, threshold, leaf, start, depth)


def predict(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Scores of all rows: one gather per tree and level."""
    margin, rows = np.full(len(x), trees.start), np.arange(len(x))
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(trees.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        margin += leaf[node - (2**trees.depth - 1)]
    return 1 / (1 + np.exp(-margin))


def document_statistics(df: DataFrame, text_col: str = "text", column: str = "statistics") -> DataFrame:
    """Replaces the text by its array of STATISTICS."""
    kept = without(df, text_col, column)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in pieces(batches, len(names)):
            stats = statistics(*text_bytes(batch.column(len(names))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(stats), pa.list_(pa.float32()))], [*names, column])

    return with_last(df, text_col, column).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Trees:
    """Learns quality from the labels outside the held-out fold."""
    rows = document_statistics(training_rows(docs, labels, "quality", MODULUS, HELD_OUT, max_rows), "_text").toPandas()
    rows = rows.sort_values(["_order", "_id"], kind="stable")
    x = np.stack(rows["statistics"].to_list()).astype(np.float32) if len(rows) else np.zeros((0, len(STATISTICS)), np.float32)
    return fit(x, rows["_label"].to_numpy(float))


def score_quality(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted; all rows and whole texts."""
    kept = without(docs, "score", "predicted")
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    text = names.index("text")

    def run(batches):
        for batch in pieces(batches, text):
            score = predict(trees, statistics(*text_bytes(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_()).cast(pa.int32())], [*names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Learns from ``labels`` and scores every document, marking the held-out fold."""
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels, max_rows))
    return scored.select("doc_id", (remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    bounded_batches(docs.sparkSession)
    scored = score_quality(packed(docs, F.col("text")), train(docs, labels, max_rows))
    return scored.filter("predicted = 1").select(*fields(docs))
