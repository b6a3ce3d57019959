"""What is alive (reached from roots), kept up to date from the edges that went and came instead of anew.

Delete and rederive: all that hung on a removed edge is taken out, however else it may still be reached; then what has an
edge from what stayed, or is a root, comes back with all that it leads to.  Work follows what hung on the changes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import if_small, written
from .traverse import induced, reach


class Maintained(NamedTuple):
    """(id) of what is alive now, and how many nodes were taken out, brought back and newly reached."""

    alive: DataFrame
    deleted: int
    rederived: int
    reached: int


def alive(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of everything that roots (id) lead to, themselves included."""
    return reach(edges, roots, None).nodes.select("id")


def maintain(before: DataFrame, edges: DataFrame, roots: DataFrame, removed: DataFrame, added: DataFrame, lost_roots: DataFrame | None = None) -> Maintained:
    """What was alive (id) ``before``, after edges (source_id, target_id) went and came; ``edges`` and ``roots`` (id) are those of now.

    ``lost_roots`` (id) are those that were roots before and are none now.  A removed edge of which there is a second
    one in ``edges`` is no loss, but may be given.
    """
    was, known = written(before.select("id").distinct(), "alive-before"), roots.select("id").distinct()
    hung = removed.join(was.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    hung = hung if lost_roots is None else hung.unionByName(lost_roots.select("id"))
    first = hung.distinct().join(was, "id", "left_semi")
    out = written(reach(edges, first, None).nodes.select("id").join(was, "id", "left_semi"), "over-deleted")
    stayed = was.join(if_small(out), "id", "left_anti")
    # Of the edges only those into what was taken out are looked at again.
    into = written(edges.select("source_id", "target_id").join(if_small(out.withColumnRenamed("id", "target_id")), "target_id", "left_semi"), "edges-of-deleted")
    again = into.join(stayed.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    again = again.unionByName(out.join(known, "id", "left_semi")).distinct()
    back = written(reach(induced(into, out), again, None).nodes.select("id"), "rederived")
    kept = written(stayed.unionByName(back), "kept-alive")
    fresh = added.join(kept.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    fresh = fresh.unionByName(known).distinct().join(kept, "id", "left_anti")
    new = written(reach(edges, fresh, None).nodes.select("id").join(kept, "id", "left_anti"), "newly-alive")
    return Maintained(written(kept.unionByName(new), "alive"), out.count(), back.count(), new.count())
