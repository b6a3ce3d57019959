"""What is alive after random changes against a walk from the roots anew."""

import random

from codeloom import schema
from codeloom.operators import maintain


def test_changes_give_what_a_new_walk_gives(spark):
    dice = random.Random(11)
    ids = [f"n{k}" for k in range(40)]
    table = lambda pairs: spark.createDataFrame([(a, b, "CALLS", 1) for a, b in sorted(pairs)], schema.EDGES)
    named = lambda some: spark.createDataFrame([(i,) for i in sorted(some)], "id string")
    pairs, roots = {(dice.choice(ids), dice.choice(ids)) for _ in range(60)}, {"n0", "n1", "n2"}
    for step in range(3):
        before = maintain.alive(table(pairs), named(roots))
        gone = set(dice.sample(sorted(pairs), 8))
        came = {(dice.choice(ids), dice.choice(ids)) for _ in range(4)}
        left = {sorted(roots)[step]}
        pairs, roots = (pairs - gone) | came, (roots - left) | {dice.choice(ids)}
        got = maintain.maintain(before, table(pairs), named(roots), table(gone), table(came), named(left))
        want = {r.id for r in maintain.alive(table(pairs), named(roots)).collect()}
        assert {r.id for r in got.alive.collect()} == want and got.rederived <= got.deleted


def test_a_ring_does_not_keep_itself_alive(spark):
    edges = lambda *pairs: spark.createDataFrame([(a, b, "CALLS", 1) for a, b in pairs], schema.EDGES)
    root = spark.createDataFrame([("r",)], "id string")
    all_ = edges(("r", "a"), ("a", "b"), ("b", "a"), ("r", "c"), ("c", "d"), ("r", "d"))
    got = maintain.maintain(maintain.alive(all_, root), edges(("a", "b"), ("b", "a"), ("c", "d"), ("r", "d")), root, edges(("r", "a"), ("r", "c")), all_.limit(0))
    assert {r.id for r in got.alive.collect()} == {"r", "d"} and (got.deleted, got.rederived, got.reached) == (4, 1, 0)
