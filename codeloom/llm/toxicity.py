"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the different words, word pairs and pairs with one word between, hashed into
``2 ** BITS`` coordinates.  Training follows the per-coordinate rates of FTRL-proximal; the L1 term
leaves most coordinates at exactly zero, so the model is a short list of (coordinate, weight) that is
broadcast.  Its size is bounded by ``2 ** BITS`` entries whatever the corpus.

Learning takes at most ``MAX_TRAINING_ROWS`` labelled rows and runs in one task over that bounded
sample; scoring covers every row and the whole of every text.

Defined results: null and empty texts have no features and get the model's base rate; with no usable
label every score is 0.5; repeated rows get equal scores; an empty table gives an empty result; input columns
named like an output are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, Words, chunks, mix, pieces, remainder, text_bytes, without, word_hashes, words
from .labelled import training_rows

MAX_TRAINING_ROWS = 8_000
MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.7
BITS, EPOCHS, ALPHA, BETA, L1, L2 = 22, 4, 1.0, 1.0, 10.0, 0.5
#: What a toxic row counts against a clean one in training, as few rows are toxic.  Of 1, 2, 4 and 8 it found most toxic rows
#: without a false alarm in three folds of the training rows alone.
TOXIC_WEIGHT = 4.0
_GAPS = (1, 2)
_STEMS, _STEM_TIMES = (4, 5, 6, 7), (1, 3)


def _coordinate(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) pairs, each once, for a run of rows; only coordinates marked in ``known`` if given.

    Words, word pairs and skip-grams count as present or absent.  Stems, the first bytes of a word, have
    a coordinate for each of the frequencies in ``_STEM_TIMES`` that they reach in the row, so that an
    inflected word shows by its stem, and a stem that is merely usual differs from one that abounds.
    """
    w = words(data, offsets, ALNUM)
    lowered = LOWER[data]
    h = word_hashes(lowered, w)
    found = []

    def add(row, value):
        at = _coordinate(value)
        if known is not None:
            some = known[at]
            row, at = row[some], at[some]
        found.append(row << BITS | at)

    add(w.row, h)
    for gap in _GAPS:
        if len(h) > gap:
            same = w.row[gap:] == w.row[:-gap]
            add(w.row[gap:][same], mix(h[:-gap][same] * np.uint64(2 * gap + 1) + h[gap:][same]))
    for size in _STEMS:
        long = w.ends - w.starts > size
        stem = word_hashes(lowered, Words(w.starts[long], w.starts[long] + size, w.row[long], w.counts)) ^ np.uint64(size)
        r = w.row[long]
        if known is not None:
            some = np.any([known[_coordinate(mix(stem + np.uint64(least)))] for least in _STEM_TIMES], axis=0)
            r, stem = r[some], stem[some]
        order = np.lexsort((stem, r))
        r, v = r[order], stem[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(r)))
        for least in _STEM_TIMES:
            add(r[at][times >= least], mix(v[at][times >= least] + np.uint64(least)))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


class Weights(NamedTuple):
    """The coordinates that are not zero, sorted, their weights, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float


def fit(examples: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal with binary features; the bias stays at the share of positive labels."""
    if not len(y):
        return Weights(np.zeros(0, np.int64), np.zeros(0), 0.0)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rows = np.zeros(1 << BITS, np.int32)
    for i in examples:
        rows[i] += 1
    # A gradient is below TOXIC_WEIGHT, so L1 keeps a coordinate of this few rows at zero in any case.
    examples = [i[rows[i] * epochs * TOXIC_WEIGHT > L1] for i in examples]
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = np.log(share / (1 - share))

    def weight(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0
        return w

    for _ in range(epochs):
        for i, label in zip(examples, y, strict=True):
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = (p - label) * (TOXIC_WEIGHT if label else 1.0)
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    at = np.flatnonzero(np.abs(z) > L1)
    return Weights(at, weight(at), float(bias))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Weights:
    """Fits the weights in one task over the bounded sample and brings the sparse result to the driver."""
    sample = training_rows(docs, labels, "toxic", MODULUS, HELD_OUT, max_rows).repartition(1).sortWithinPartitions("_order", "_id", F.xxhash64("_text"))

    def run(batches):
        examples, y = [], []
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            for first, last, part, offs in chunks(data, offsets):
                row, at = features(part, offs)
                examples += np.split(at.astype(np.int32), np.cumsum(np.bincount(row, minlength=last - first))[:-1])
            y += batch.column("_label").to_pylist()
        model = fit(examples, np.array(y, float))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *model.at], pa.int64()), pa.array([model.bias, *model.weight], pa.float64())], ["at", "weight"])

    found = sample.select("_text", "_label").mapInArrow(run, "at long, weight double").toPandas().sort_values("at")
    at, weight = found["at"].to_numpy(), found["weight"].to_numpy()
    return Weights(at[at >= 0], weight[at >= 0], float(weight[at < 0].sum()))


def score_texts(model: Weights, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.full(len(offsets) - 1, model.bias)
    known = np.zeros(1 << BITS, bool)
    known[model.at] = True
    for first, last, part, offs in chunks(data, offsets):
        row, at = features(part, offs, known)
        if len(at):
            out[first:last] += np.bincount(row, weights=model.weight[np.searchsorted(model.at, at)], minlength=last - first)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score_toxicity(docs: DataFrame, model: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted, for all rows."""
    kept = without(docs, "score", "predicted")
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    text, weights = names.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, text):
            score = score_texts(weights.value, *text_bytes(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_()).cast(pa.int32())], [*names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Learns from ``labels`` and scores every document, marking the held-out fold."""
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, labels, max_rows))
    return scored.select("doc_id", (remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", "predicted")
