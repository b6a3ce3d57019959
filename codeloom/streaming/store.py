"""A graph of files that is kept as a base and the changes since: what is written follows a change, not the graph.

Rows are never rewritten.  Every version writes the nodes and edges of the files that it read again, the paths of the files that it
replaced or deleted (``gone``) and the ids that went with them for good (``lost``), each under a folder of its own and
dealt to buckets by a hash of the file's path; then it is entered in ``commits``.  Readers merge: a row of version v is
there if its file has not gone in a later version and, for an edge, its target has not been lost in a later one.

A version that was not entered is not seen, and is overwritten when it is written again; one that was entered is not written a second
time.  So a stream may stop anywhere and start again.  ``compact`` writes the merged graph as a new base, after which
older versions are not read; ``clean`` deletes them.  Folders of changes have even numbers, those of bases odd ones.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import STUB
from ..storage import if_small, remove, written

BUCKETS = 32
_COMMITS = "version long, base boolean"


class Versions:
    """Folders of versions and the table that says which of them are entered."""

    KINDS: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commits(self) -> list[tuple[int, bool]]:
        """Versions from the last base on, in order; empty before there is one."""
        try:
            rows = self.spark.read.schema(_COMMITS).parquet(f"{self.folder}/commits").distinct().collect()
        except AnalysisException:
            return []
        known = sorted((r.version, r.base) for r in rows)
        bases = [v for v, base in known if base]
        return [(v, base) for v, base in known if bases and v >= bases[-1]]

    def latest(self) -> int | None:
        """The last version that was entered, None before there is a base."""
        known = self.commits()
        return known[-1][0] // 2 if known else None

    def _commit(self, version: int, base: bool) -> None:
        self.spark.createDataFrame([(version, base)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _read(self, kind: str, schema: T.StructType) -> DataFrame:
        """All rows of this kind of the versions since the last base, with their version."""
        paths = [f"{self.folder}/{kind}/version={v}" for v, _ in self.commits()]
        full = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
        return self.spark.read.schema(full).option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def _last(self, kind: str, column: str) -> DataFrame:
        """(column, _last): the last version that has each value."""
        rows = self._read(kind, T.StructType([T.StructField(column, T.StringType())]))
        return if_small(written(rows.groupBy(column).agg(F.max("version").alias("_last")), f"last-{kind}"))

    def clean(self) -> None:
        """Deletes the folders of versions before the last base, which no new reader needs."""
        first = self.commits()[0][0]
        for r in self.spark.read.schema(_COMMITS).parquet(f"{self.folder}/commits").distinct().filter(F.col("version") < first).collect():
            for kind in self.KINDS:
                remove(self.spark, f"{self.folder}/{kind}/version={r.version}")


class GraphStore(Versions):
    KINDS = ("nodes", "edges", "gone", "lost")

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        super().__init__(spark, folder)
        self.buckets = buckets

    def _bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _write(self, kind: str, version: int, rows: DataFrame, path: Column) -> None:
        rows.withColumn("bucket", self._bucket(path)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{kind}/version={version}")

    def create(self, nodes: DataFrame, edges: DataFrame, version: int = 0) -> None:
        """Writes a graph as the base of a version; edges belong to the file of their source."""
        version = 2 * version + 1
        owner = nodes.select(F.col("id").alias("source_id"), F.col("path").alias("source_path"))
        self._write("nodes", version, nodes, F.col("path"))
        self._write("edges", version, edges.join(owner, "source_id", "left").select(*edges.columns, "source_path"), F.col("source_path"))
        for kind, column, schema in (("gone", "path", "path string"), ("lost", "id", "id string")):
            self._write(kind, version, self.spark.createDataFrame([], schema), F.col(column))
        self.spark.createDataFrame([], nodes.schema).write.mode("overwrite").parquet(f"{self.folder}/schema/nodes")
        self.spark.createDataFrame([], edges.schema).write.mode("overwrite").parquet(f"{self.folder}/schema/edges")
        self._commit(version, True)

    def _schema(self, kind: str) -> T.StructType:
        return self.spark.read.parquet(f"{self.folder}/schema/{kind}").schema

    def _live_nodes(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self._read("nodes", T.StructType([*self._schema("nodes").fields, T.StructField("bucket", T.IntegerType())]))
        rows = rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))
        return rows.join(self._last("gone", "path"), "path", "left").filter("_last is null or version >= _last")

    def nodes(self) -> DataFrame:
        return self._live_nodes().select(*self._schema("nodes").names)

    def edges(self) -> DataFrame:
        names = self._schema("edges")
        rows = self._read("edges", T.StructType([*names.fields, T.StructField("source_path", T.StringType())]))
        gone, lost = self._last("gone", "path").withColumnRenamed("path", "source_path"), self._last("lost", "id").toDF("target_id", "_lost")
        kept = rows.join(gone, "source_path", "left").filter("_last is null or version >= _last").join(lost, "target_id", "left")
        return kept.filter("_lost is null or version >= _lost").select(*names.names)

    def apply(self, version: int, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> bool:
        """Enters a change: files (path) are replaced by new nodes and edges, or by nothing.  False if that version is there already.

        Outgoing edges of the files go, incoming ones stay if their target is still there, and new ones need a target.
        """
        known, version = self.commits(), 2 * version
        if not known:
            raise ValueError("create the store first")
        if version <= known[-1][0]:
            return False
        paths = written(changed.select("path").distinct(), "changed-paths")
        fresh = written(new_nodes.join(paths, "path", "left_semi").select(*new_nodes.columns), "changed-nodes")
        # At most as many numbers as there are buckets; only those folders are read.
        buckets = [r[0] for r in paths.select(self._bucket(F.col("path"))).distinct().collect()]
        old = self._live_nodes(buckets).join(if_small(paths), "path", "left_semi").select("id")
        lost = old.join(fresh.select("id"), "id", "left_anti").distinct()
        made = new_edges.join(fresh.select(F.col("id").alias("source_id"), F.col("path").alias("source_path")), "source_id").select(*new_edges.columns, "source_path")
        made = written(made, "changed-edges")
        asked = if_small(made.select(F.col("target_id").alias("id")).distinct())
        there = self._live_nodes().join(if_small(paths), "path", "left_anti").select("id").join(asked, "id", "left_semi").unionByName(fresh.select("id").join(asked, "id", "left_semi"))
        stub = F.startswith("target_id", F.lit(STUB))
        kept = made.filter(stub).unionByName(made.filter(~stub).join(there.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi").select(*made.columns))
        self._write("nodes", version, fresh, F.col("path"))
        self._write("edges", version, kept, F.col("source_path"))
        self._write("lost", version, lost, F.col("id"))
        self._write("gone", version, paths, F.col("path"))
        self._commit(version, False)
        return True

    def compact(self) -> None:
        """Writes the merged graph as a base; readers start from it."""
        nodes, edges = written(self.nodes(), "compacted-nodes"), written(self.edges(), "compacted-edges")
        self.create(nodes, edges, self.latest())
