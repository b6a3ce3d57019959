"""Written tables that cut lineage, and the size check before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share.

    Without that setting a session on one machine gets a temporary folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df below spark.checkpoint.dir and reads it back; a lost executor loses nothing of it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that Spark itself uses."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df of ids or other short columns, marked for broadcast if it is counted to have few rows."""
    return F.broadcast(df) if df.count() <= rows else df


class Rounds:
    """The tables of a loop.  Most are held by the executors; every EVERY-th round all that the loop still needs is written.

    A lost executor then costs a few rounds and not the loop, and no plan is deeper than that.
    """

    EVERY = 2

    def __init__(self, name: str):
        self.name, self.held, self.n = name, [], 0

    def hold(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def turn(self, *tables: DataFrame) -> tuple[DataFrame, ...]:
        """The tables that the next round starts from."""
        self.n += 1
        return tables if self.n % self.EVERY else self.write(*tables)

    def write(self, *tables: DataFrame) -> tuple[DataFrame, ...]:
        out = tuple(written(t, self.name) for t in tables)
        for t in self.held:
            t.unpersist()
        self.held.clear()
        return out
