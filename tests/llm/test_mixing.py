"""The mixture against the weights that were given: windows, deviation at every slot, and odd input."""

import random
from fractions import Fraction

import pytest
from codeloom.llm import mixing
from pyspark.sql import functions as F


def planned(spark, weights, blocks):
    """Slots by source, and the exact target of each."""
    df = spark.createDataFrame([(f"={i:05d}", float(w), b) for i, (w, b) in enumerate(zip(weights, blocks, strict=True))], "_name string, weight double, blocks long")
    rows = mixing.schedule(mixing.units(df).select("_name", "units", "blocks")).orderBy("_name", "block").collect()
    slots = {}
    for r in rows:
        slots.setdefault(int(r["_name"][1:]), []).append((r["block"], r["slot"]))
    assert {s: [b for b, _ in found] for s, found in slots.items()} == {s: list(range(1, n + 1)) for s, n in enumerate(blocks) if n}
    assert len({slot for found in slots.values() for _, slot in found}) == sum(blocks)
    total = sum(map(Fraction, weights))
    return {s: [slot for _, slot in found] for s, found in slots.items()}, [Fraction(w) / total for w in weights]


def deviation(slots, target):
    """The largest distance from the target at any slot up to the last block; it is reached beside a block."""
    return max(max(abs(k - target * slot), abs(k + 1 - target * (slot + 1))) for k, slot in enumerate(slots))


def check(slots, targets, most=1):
    for s, found in slots.items():
        assert found == sorted(found)
        assert deviation(found, targets[s]) < most


def test_twenty_equal_sources_over_fifty_segments(spark):
    slots, targets = planned(spark, [1] * 20, [50 * mixing.PERIOD // 20] * 20)
    check(slots, targets)
    assert max(map(max, slots.values())) == 50 * mixing.PERIOD - 1


def test_odd_weights_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PERIOD", 32)
    dice = random.Random(7)
    for _ in range(3):
        weights = [dice.choice([1, 1, 2, 7]) * dice.choice([1, dice.random() + 0.1]) for _ in range(dice.randint(5, 12))]
        slots, targets = planned(spark, weights, [int(2000 * w / sum(weights)) + 1 for w in weights])
        check(slots, targets)


def test_equal_rests_and_unequal_weights(spark, monkeypatch):
    # At many cuts half the sources are half a block in; who goes first there must follow the windows.
    monkeypatch.setattr(mixing, "PERIOD", 32)
    slots, targets = planned(spark, [16, 16, 16, 12, 1, 1, 1, 1], [400, 400, 400, 300, 25, 25, 25, 25])
    check(slots, targets)


def test_two_thousand_sources(spark):
    slots, targets = planned(spark, [0.3 * 1999 / 0.7] + [1] * 1999, [1200] + [2] * 1999)
    check({0: slots[0]}, targets)
    # Pools hold 128 sources of equal weight, the last one fewer.
    check({s: slots[s] for s in range(1, 2000)}, targets, 1 + 1 / 79)


def test_a_weight_of_one_in_a_million(spark):
    slots, targets = planned(spark, [1e-6, 0.5, 0.3, 0.2 - 1e-6], [1, 2000, 1200, 800])
    check(slots, targets)
    assert slots[0][-1] > 900_000


def test_pooled_light_sources(spark):
    slots, targets = planned(spark, [1.0] + [1e-5] * 30 + [3e-6], [3000] + [2] * 30 + [1])
    check({0: slots[0]}, targets)
    pool = sum(targets[1:])
    for s in range(1, 32):
        assert deviation(slots[s], targets[s]) < 1 + targets[s] / pool


def mixed(spark, docs, weights=None, **options):
    w = spark.createDataFrame(weights, "source string, weight double") if weights is not None else None
    return mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string"), w, **options).collect()


@pytest.mark.parametrize("hash_bits", [2, 12])
def test_every_row_once_in_its_window(spark, hash_bits):
    docs = [(i, f"t{i}", "abc"[min(i % 5, 2)]) for i in range(300)] + [(7, "t7", "a")] * 3 + [(None, None, None)]
    rows = mixed(spark, docs, block_docs=2, hash_bits=hash_bits)
    assert len(rows) == len(docs)
    assert len({(r.mix_slot, r.mix_in_block) for r in rows}) == len(rows)
    for r in rows:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    for s in {r.source for r in rows}:
        places = sorted((r.mix_slot, r.mix_in_block) for r in rows if r.source == s)
        assert sorted((r.mix_block - 1) * 2 + r.mix_in_block for r in rows if r.source == s) == list(range(len(places)))


def test_weights_that_are_missing_or_not_positive_count_as_the_least(spark):
    docs = [(i, "t", "abcd"[i % 4]) for i in range(80)]
    rows = mixed(spark, docs, [("a", 4.0), ("b", 1.0), ("c", -3.0), ("e", 9.0)])
    assert {(r.source, round(r.mix_weight, 6)) for r in rows} == {("a", round(4 / 7, 6)), ("b", round(1 / 7, 6)), ("c", round(1 / 7, 6)), ("d", round(1 / 7, 6))}


def test_empty_and_clashing_names(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    df = spark.createDataFrame([(1, "t", "s", 5)], "doc_id long, text string, source string, mix_slot int").withColumn("units", F.lit(1)).withColumn("block", F.lit(2))
    assert mixing.mix_sources(df).first().mix_slot == 0


def test_very_long_texts_travel(spark):
    rows = mixed(spark, [(1, "x" * 5_000_000, "a"), (2, "y", "a"), (3, None, "b")])
    assert sorted((r.doc_id, len(r.text or "")) for r in rows) == [(1, 5_000_000), (2, 1), (3, 0)]
