"""Change events: bursts per file become one change, in batch or in a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import invalidate, upsert_files
from ..storage import written
from .store import GraphStore

#: In a burst the gravest event counts.
PRIORITY = ("create", "change", "delete")


def debounce(events: DataFrame, gap: str = "300 milliseconds", late: str | None = None, last_wins: bool = False) -> DataFrame:
    """(path, started, ended, event_type, events) for every burst of a file's events.

    ``late`` is the watermark that a stream needs.  The gravest event counts, or with ``last_wins`` the last.
    """
    source = events.withWatermark("ts", late) if late else events
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("event_type"))
    pick = F.max_by("event_type", F.struct("ts", rank)) if last_wins else F.max_by("event_type", rank)
    bursts = source.groupBy("path", F.session_window("ts", gap).alias("w")).agg(pick.alias("event_type"), F.count("*").alias("events"))
    return bursts.select("path", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "event_type", "events")


def apply_batch(nodes: DataFrame, edges: DataFrame, changes: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after a micro-batch of changes: deleted files go, the others are replaced.  For foreachBatch."""
    nodes, edges = invalidate(nodes, edges, changes.filter("event_type = 'delete'").select("path"))
    return upsert_files(nodes, edges, new_nodes, new_edges)


def follow(changes: DataFrame, nodes: DataFrame, edges: DataFrame, read: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, timeout: int = 600, compact_every: int = 64) -> tuple[DataFrame, DataFrame]:
    """The graph after all micro-batches of a stream of changes (path, event_type) that are there now.

    ``read`` gives the nodes and edges of the changed files (path) of a batch.  The graph lies in a GraphStore beside the
    checkpoint; batch n is its version n + 1.  Started again on the same checkpoint, the stream goes on with
    that graph, and ``nodes`` and ``edges`` are not looked at; a batch that runs twice is entered once.
    """
    store = GraphStore(nodes.sparkSession, f"{checkpoint.rstrip('/')}-graph")
    if store.latest() is None:
        store.create(nodes, edges)

    def step(batch: DataFrame, number: int) -> None:
        if number + 1 <= store.latest():
            return
        changed = written(batch.select("path", "event_type").distinct(), "changes")
        # A changed file without any definition is replaced by nothing.
        store.apply(number + 1, changed, *read(changed.filter("event_type != 'delete'").select("path")))
        if (number + 1) % compact_every == 0:
            store.compact()

    run = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not run.awaitTermination(timeout):
        run.stop()
        raise TimeoutError("the stream of changes did not end")
    return store.nodes(), store.edges()
