"""Edges kept for many walks: bucketed and sorted by either end, so that a hop shuffles its frontier and no edge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder

_ENDS = {"out": ("source_id", "target_id"), "in": ("target_id", "source_id")}


class Adjacency:
    """Steps (a, b) of edges as two tables, bucketed by a: along the edges and against them.

    A frontier that is too large to broadcast is shuffled into the same buckets and meets them where they lie.  ``buckets``
    should be the number of shuffle partitions or more, as Spark deals a join anew whose sides have fewer.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets, self._names = spark, folder.rstrip("/"), buckets, {}

    @classmethod
    def build(cls, edges: DataFrame, folder: str | None = None, buckets: int | None = None) -> Adjacency:
        """Writes the different pairs of ends of edges (source_id, target_id) below a shared folder."""
        spark = edges.sparkSession
        found = cls(spark, folder or shared_folder(spark, "adjacency"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        for way, (a, b) in _ENDS.items():
            pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
            found._names[way] = name = f"adjacency_{way}_{uuid.uuid4().hex}"
            # One task a bucket writes one file of it, which keeps its order.
            pairs.repartition(found.buckets, "a").write.bucketBy(found.buckets, "a").sortBy("a").option("path", f"{found.folder}/{way}").saveAsTable(name)
        return found

    @classmethod
    def open(cls, spark: SparkSession, folder: str, buckets: int) -> Adjacency:
        """What ``build`` wrote there with as many buckets, in any session."""
        found = cls(spark, folder, buckets)
        for way in _ENDS:
            found._names[way] = name = f"adjacency_{way}_{uuid.uuid4().hex}"
            fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{found.folder}/{way}").schema)
            spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (a) SORTED BY (a) INTO {buckets} BUCKETS LOCATION '{found.folder}/{way}'")
        return found

    def steps(self, direction: str) -> list[DataFrame]:
        """The tables (a, b) of a direction, each to be joined by itself; of ``both`` the two of them."""
        return [self.spark.table(self._names[way]) for way in (_ENDS if direction == "both" else (direction,))]
