"""Connected components by rounds of neighbourhood minima, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialise

MAX_ROUNDS = 60
#: Edges a task of a round holds, and the tasks that even a small graph is dealt over.
TASK_EDGES, TASKS = 200_000, 8


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of the undirected edges (src, dst); component is the smallest id.

    Alternating rounds rewrite the edges.  The large-star round ties each node's larger neighbours to its
    smallest one, the small-star round ties a node and its smaller neighbours to the smallest.  Both keep
    components whole and shrink paths to stars in a number of rounds that is logarithmic in practice.
    Aggregates use minima and joins split hot keys, so a hub's neighbours are never gathered in one task.  Edges are written to the
    shared folder after each round, and the loop ends when a round changes nothing.  A round's tasks and files follow the
    counted edges, as a graph that has shrunk to little would else cost a file for every shuffle partition.
    """
    edges = materialise(links.filter("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    before = _signature(edges)
    for _ in range(MAX_ROUNDS):
        tasks = max(TASKS, -(-before[0] // TASK_EDGES))
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")).coalesce(tasks), "least-neighbours")
        large = join_by_key(both, low.select("u", "m"), ["u"], copies=low.select("u", "n")).filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)
        # A node's edges to smaller ones are few after a large-star round, as each larger neighbour keeps one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialise(small.distinct().coalesce(tasks), "edges")
        if (now := _signature(edges)) == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, component) of a graph whose components were ``labels`` before these links (src, dst) were added.

    Links are carried over to the components that they tie, so only those are walked again.
    """
    ends = links
    for end in ("src", "dst"):
        ends = join_by_key(ends, labels.toDF(end, f"_{end}"), [end], "left", row_bytes=32).withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    moved = materialise(connected_components(ends.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))), "moved-components")
    kept = join_by_key(labels, moved.toDF("component", "_now"), ["component"], "left", row_bytes=32).select("id", F.coalesce("_now", "component").alias("component"))
    return kept.unionByName(moved.join(labels.select("id"), "id", "left_anti"))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
