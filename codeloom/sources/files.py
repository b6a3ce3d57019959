"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MANIFESTS, extension, is_ignored, language, normalize_path

MAX_BYTES = 5 * 1024 * 1024


def source_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, text, lang, mtime_ms, size) of all source files below root, ignored folders, empty and large files apart."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = normalize_path(F.regexp_replace("path", "^file:", ""))
    kept = found.filter(F.col("length") <= max_bytes).withColumn("path", path)
    lang = F.when(extension(F.col("path")).isin(*MANIFESTS), extension(F.col("path"))).otherwise(language(F.col("path")))
    kept = kept.withColumn("lang", lang).filter((F.col("lang") != "unknown") & ~is_ignored(F.col("path")))
    return kept.select("path", F.decode("content", "UTF-8").alias("text"), "lang", (F.unix_micros("modificationTime") / 1000).cast("long").alias("mtime_ms"), F.col("length").alias("size"))


def stale(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files that were never indexed or whose time or size differs."""
    old = indexed.select("path", F.col("mtime_ms").alias("_m"), F.col("size").alias("_s"))
    return files.join(old, "path", "left").filter(~(F.col("mtime_ms").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s")))).select(*files.columns)
