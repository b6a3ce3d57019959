"""Walks over bucketed edges against walks over plain ones, and what a hop's plan shuffles."""

import random
import tempfile

import pytest
from codeloom import schema
from codeloom.operators import traverse
from codeloom.operators.adjacency import Adjacency


@pytest.fixture(scope="module")
def edges(spark):
    dice = random.Random(9)
    pairs = [(f"n{dice.randrange(60)}", f"n{dice.randrange(60)}") for _ in range(90)]
    return spark.createDataFrame([(a, b, "CALLS", 1) for a, b in pairs], schema.EDGES)


def test_walks_are_those_over_plain_edges(spark, edges, monkeypatch):
    folder = tempfile.mkdtemp()
    built = Adjacency.build(edges, folder + "/kept")
    again = Adjacency.open(spark, folder + "/kept", built.buckets)
    root = edges.select("source_id").limit(1).toDF("id")
    for most in (100_000, -1):
        monkeypatch.setattr(traverse, "BROADCAST_ROWS", most)
        for way in ("out", "in", "both"):
            want = sorted(traverse.reach(edges, root, 3, way).nodes.collect())
            assert sorted(traverse.reach(built, root, 3, way).nodes.collect()) == want
            assert sorted(traverse.reach(again, root, 3, way).nodes.collect()) == want


def test_no_edge_is_shuffled_to_meet_a_large_frontier(spark, edges):
    kept = Adjacency.build(edges)
    frontier = edges.select("source_id").distinct().toDF("a")
    for way in ("out", "both"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = traverse.hop_from(kept.steps(way), frontier)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        lines = plan.split("\n")
        scans = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
        assert len(scans) == len(kept.steps(way))
        for i in scans:
            # Upwards from the scan the join comes before any exchange.
            above = next(line for line in reversed(lines[:i]) if "Join" in line or "Exchange" in line)
            assert "Join" in above
