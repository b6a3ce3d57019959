"""Bounded graph traversals as frontier joins.

Every hop is one join of the frontier with the edges, a distinct, and an anti join with what was visited.
What was visited is written to the shared folder every few hops, so no plan grows with the depth and a lost
executor costs a few hops.  The frontier is broadcast while it is counted to be small, and joined by a shuffle
beyond that.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import STUB
from ..storage import BROADCAST_ROWS, Rounds, if_small, written
from .adjacency import Adjacency


class Reached(NamedTuple):
    """(id, depth) of all nodes reached; whether the depth limit cut the walk short."""

    nodes: DataFrame
    partial: bool


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b): a step from a leads to b."""
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def usable(edges: DataFrame, relations: list[str] | None = None, stubs: bool = False) -> DataFrame:
    """Edges of the given relations, without ends outside the indexed code unless asked for."""
    kept = edges if relations is None else edges.filter(F.col("type_relation").isin(*relations))
    return kept if stubs else kept.filter(~F.startswith("source_id", F.lit(STUB)) & ~F.startswith("target_id", F.lit(STUB)))


def hop_from(ways: list[DataFrame], few: DataFrame) -> DataFrame:
    """(id) of where the steps (a, b) of any of the ways lead from a frontier (a)."""
    return reduce(DataFrame.unionByName, [way.join(few, "a", "left_semi").select(F.col("b").alias("id")) for way in ways]).distinct()


def reach(edges: DataFrame | Adjacency, seeds: DataFrame, depth: int | None, direction: str = "out", gate: DataFrame | None = None) -> Reached:
    """Breadth-first search from seeds (id).  With ``gate`` (id), only nodes in it are expanded."""
    ways = edges.steps(direction) if isinstance(edges, Adjacency) else [steps(edges, direction)]
    if gate is not None:
        ways = [way.join(gate.select(F.col("id").alias("a")).distinct(), "a", "left_semi") for way in ways]
    rounds = Rounds("reached")
    frontier = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "seeds")
    visited, hop, n = frontier, 0, frontier.count()
    while True:
        few = frontier.select(F.col("id").alias("a"))
        few = F.broadcast(few) if n <= BROADCAST_ROWS else few
        found = hop_from(ways, few).join(visited.select("id"), "id", "left_anti")
        found = rounds.hold(found.withColumn("depth", F.lit(hop + 1)))
        n = found.count()
        if not n or (depth is not None and hop >= depth):
            return Reached(rounds.write(visited)[0], n > 0)
        visited, frontier = rounds.turn(visited.unionByName(found), found)
        hop += 1


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges both of whose ends are among ids (id)."""
    some = ids.select("id").distinct()
    some = if_small(some)
    return edges.join(some.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(some.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def neighbourhood(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes with their depth and edges with their direction, around a root; a missing root gives nothing."""
    kept = usable(edges)
    near = reach(kept, nodes.filter(F.col("id") == root).select("id"), depth, "both").nodes
    around = induced(kept, near).withColumn("direction", F.when(F.col("source_id") == root, "outgoing").when(F.col("target_id") == root, "incoming").otherwise("lateral"))
    return nodes.join(near, "id"), around


def relations(edges: DataFrame, root: DataFrame, direction: str, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """The edges of all nodes nearer than ``depth``, with the distance of the node they belong to."""
    kept, own = usable(edges, kinds), "source_id" if direction == "out" else "target_id"
    near = reach(kept, root, depth - 1, direction).nodes if depth > 0 else root.limit(0).withColumn("depth", F.lit(0))
    return kept.join(near.withColumnRenamed("id", own), own).select(*edges.columns, (F.col("depth") + 1).alias("depth"))


def crawl(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes at a depth of at most ``depth`` are expanded, so targets reach one level more."""
    return reach(edges, start, depth + 1, "out").nodes


def budgeted(edges: DataFrame, seeds: DataFrame, depth: int, most: int) -> DataFrame:
    """Search from many seeds that keeps at most ``most`` nodes, nearest first, then by id; all seeds stay."""
    near = reach(edges, seeds, depth, "both").nodes
    first = near.filter("depth > 0").orderBy("depth", "id").limit(most)
    room = F.lit(most) - F.lit(near.filter("depth = 0").count())
    ranked = first.withColumn("_k", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("depth", "id")))
    return near.filter("depth = 0").unionByName(ranked.filter(F.col("_k") <= room).drop("_k"))


def impact(edges: DataFrame, root: DataFrame, depth: int = 3) -> DataFrame:
    """One row: direct, transitive and all dependents, runtime and type-only direct edges, level, partial."""
    reached = reach(edges, root, depth, "in")
    near = reached.nodes.filter("depth > 0").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"), F.count("*").alias("total"))
    kinds = edges.join(root.select(F.col("id").alias("target_id")), "target_id").agg(F.count_if(F.col("type_relation") != "USES").alias("runtime"), F.count_if(F.col("type_relation") == "USES").alias("type_only"))
    level = F.when((F.col("total") > 20) | (F.col("direct") > 10), "high").when((F.col("total") > 5) | (F.col("direct") > 3), "medium").otherwise("low")
    return near.join(kinds).select("*", level.alias("level"), F.lit(reached.partial).alias("partial"))


def review_impact(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(id, dependents, partial) for every root (id): its dependents up to ``depth`` steps, and whether the walk was cut.

    All roots are walked at once, 64 of them as the bits of one number: a node has a row for each 64 roots that it depends
    on, steps are merged by ``bit_or``, and what a node had before is taken off.  The walk is cut if its last step
    still found some.
    """
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("b")).distinct()
    at = F.monotonically_increasing_id()
    numbered = written(roots.select("id").distinct().select("id", F.shiftright(at, 6).alias("block"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")), "numbered-roots")
    rounds = Rounds("impact")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    frontier = rounds.hold(numbered.select("id", "block", one.alias("mask")))
    visited = frontier.limit(0)
    for _ in range(depth):
        told = frontier.join(back, "id").groupBy(F.col("b").alias("id"), "block").agg(F.bit_or("mask").alias("told"))
        met = told.join(visited, ["id", "block"], "left").select("id", "block", F.col("told").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0).cast("long")))).alias("mask"))
        frontier = rounds.hold(met.filter("mask != 0"))
        visited, frontier = rounds.turn(visited.unionByName(frontier).groupBy("id", "block").agg(F.bit_or("mask").alias("mask")), frontier)
    bits = [F.shiftrightunsigned("mask", i).bitwiseAND(F.lit(1)) for i in range(64)]

    def by_root(rows: DataFrame, name: str) -> DataFrame:
        sums = rows.groupBy("block").agg(F.array(*[F.sum(b) for b in bits]).alias("sums"))
        return sums.select("block", F.posexplode("sums").alias("bit", name))

    joined = numbered.join(by_root(visited, "n"), ["block", "bit"], "left").join(by_root(frontier, "cut"), ["block", "bit"], "left")
    return rounds.write(joined.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("dependents"), F.coalesce(F.col("cut") > 0, F.lit(False)).alias("partial")))[0]


def connected(edges: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id) of everything linked with root (id) in either direction over any distance, and the edges between."""
    near = reach(edges, root, None, "both").nodes.select("id")
    return near, edges.join(near.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(*edges.columns)


def visible(edges: DataFrame, root: DataFrame, expanded: DataFrame, parents: bool = True) -> tuple[DataFrame, DataFrame]:
    """(id) and edges that show when root and the nodes of ``expanded`` (id) are open: the targets of open nodes.

    A node counts as open only if it is reached through open ones.  ``parents`` adds what leads into root.
    """
    gate = expanded.select("id").union(root.select("id")).distinct()
    open_ = reach(induced(edges, gate), root, None).nodes.select("id")
    shown = edges.join(open_.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("source_id", "target_id")
    if parents:
        shown = shown.union(edges.join(root.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id"))
    shown = shown.distinct()
    return shown.select(F.col("source_id").alias("id")).union(shown.select("target_id")).union(root.select("id")).distinct(), shown


def scoped(nodes: DataFrame, edges: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """Files and edges of a scope: around a file its direct neighbours, below a folder all files; edges need both ends."""
    is_file = not nodes.filter(F.col("id") == scope).isEmpty()
    if is_file:
        at = edges.filter((F.col("source_id") == scope) | (F.col("target_id") == scope))
        kept = at.select(F.col("source_id").alias("id")).union(at.select("target_id")).union(nodes.filter(F.col("id") == scope).select("id")).distinct()
    else:
        kept = nodes.filter((F.col("id") == scope) | F.startswith("id", F.lit(scope.rstrip("/") + "/"))).select("id").distinct()
    return nodes.join(kept, "id", "left_semi"), induced(edges, kept)

