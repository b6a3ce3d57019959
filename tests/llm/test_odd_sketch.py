"""Near-duplicates by odd sketches against a comparison of all pairs, and odd input."""

import random
import re

import numpy as np
import pytest
from codeloom.llm import odd_sketch
from pyspark.sql import functions as F


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                group[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(top(i)), d == least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def family(dice, base, copies, changes):
    """Copies of a text with some words replaced."""
    for _ in range(copies):
        w = base.split()
        for _ in range(dice.randint(0, changes)):
            w[dice.randrange(len(w))] = f"new{dice.randrange(10_000)}"
        yield " ".join(w)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in odd_sketch.near_duplicates(docs).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(4)
    word = lambda: "".join(dice.choices("abcdefgh", k=dice.randint(2, 6)))
    texts = []
    for size, copies, changes in ((60, 30, 3), (200, 60, 9), (400, 20, 14), (12, 20, 1), (3, 4, 0)):
        texts += family(dice, " ".join(word() for _ in range(size)), copies, changes)
    texts += [" ".join(word() for _ in range(dice.randint(1, 80))) for _ in range(60)]
    texts += [None, "", "  \t\n", "One", "one", "ONE\x0b", "a b c d", "A  b\tc d", "a b c d e", texts[0].upper(), texts[0]]
    dice.shuffle(texts)
    return list(enumerate(texts, start=5))


def test_components_equal_those_of_all_pairs(spark, rows):
    got = found(spark, rows)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got) - 40


def test_crowded_keys_lose_no_link(spark, rows, monkeypatch):
    # Salts of a few members, so that outsiders are dealt out.
    monkeypatch.setattr(odd_sketch, "SALTED", 4)
    assert found(spark, rows[:150]) == brute(rows[:150])


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "alone"), (2, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_t", F.lit(1)).withColumn("component_id", F.lit("old")).withColumn("_n", F.lit(2)).withColumn("r1", F.lit(3))
    out = odd_sketch.near_duplicates(docs)
    assert out.columns == ["doc_id", "_t", "_n", "r1", "n_shingles", "component_id", "kept"]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (2, 0, 2, True), (2, 0, 2, True)], key=repr)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_very_long_text(spark):
    dice = random.Random(5)
    w = [f"w{dice.randrange(5000)}" for _ in range(400_000)]
    near = list(w)
    for i in range(0, len(near), 200):
        near[i] = "x"
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(w[:200_000])), (4, "y" * 3_000_000)]
    assert [(r[0], r[2]) for r in found(spark, rows)] == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_the_limit_covers_the_wanted_similarity():
    dice = np.random.default_rng(6)
    counts = []
    for _ in range(4000):
        a = dice.integers(0, 1 << 62, odd_sketch.SAMPLES)
        b = np.where(dice.random(odd_sketch.SAMPLES) < 0.85, a, dice.integers(0, 1 << 62, odd_sketch.SAMPLES))
        bits = [np.bincount(x % odd_sketch.BITS, minlength=odd_sketch.BITS) % 2 for x in (a, b)]
        counts.append(int((bits[0] != bits[1]).sum()))
    assert max(counts) <= odd_sketch.LIMIT < odd_sketch.BITS / 2 - 40
    assert odd_sketch.ones_limit(0.85, lost=0.5) == pytest.approx(np.median(counts), abs=2)
