"""Digests of folders, rolled up from those of their files, so that a look for changes goes down only where two differ.

A folder's digest is the exclusive or of the hashes of all files below it (path, size and time), 128 bits; equal
digests mean equal files.  ``rollup`` is made once for what was indexed and kept beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import if_small, written


def _hashes(kind: int) -> Column:
    return F.xxhash64(F.lit(kind), "path", "mtime_ms", "size")


def rollup(files: DataFrame) -> DataFrame:
    """(folder, depth, d1, d2, n) of every folder above files (path, mtime_ms, size); the root is the empty name at depth 0."""
    parts = F.split(F.col("path"), "/")
    # Each file adds to all folders above it; folders are merged where they are read, before the shuffle.
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))
    rows = files.select(_hashes(0).alias("h1"), _hashes(1).alias("h2"), F.explode(folders).alias("f"))
    return rows.groupBy("f.folder", "f.depth").agg(F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"), F.count("*").alias("n"))


def changed_folders(now: DataFrame, then: DataFrame) -> tuple[DataFrame, int]:
    """(folder) of the folders of two roll-ups that have files of their own to compare, and how many rows were looked at.

    Level by level, only folders below one that differs are compared.
    """
    a = now.select("folder", "depth", "d1", "d2", "n")
    b = then.select("folder", "depth", F.col("d1").alias("o1"), F.col("d2").alias("o2"), F.col("n").alias("m"))
    both = written(a.join(b, ["folder", "depth"], "full").withColumn("_up", F.when(F.col("depth") == 1, "").otherwise(F.regexp_replace("folder", "/[^/]*$", ""))), "folders")
    open_, looked, found, depth = None, 0, None, 0
    while True:
        level = both.filter(F.col("depth") == depth)
        level = level if open_ is None else level.join(if_small(open_.select(F.col("folder").alias("_up"))), "_up", "left_semi")
        level = written(level, "folder-level")
        n = level.count()
        if not n:
            return found if found is not None else both.select("folder").limit(0), looked
        looked += n
        open_ = level.filter(~(F.col("d1").eqNullSafe(F.col("o1")) & F.col("d2").eqNullSafe(F.col("o2")) & F.col("n").eqNullSafe(F.col("m")))).select("folder")
        found = open_ if found is None else found.unionByName(open_)
        depth += 1


def stale_below(now: DataFrame, then: DataFrame, then_rollup: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(path, status) of the files that are new, changed or gone, and how many folders and files were compared."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("folder")
    open_, looked = changed_folders(rollup(now), rollup(then) if then_rollup is None else then_rollup)
    some = if_small(open_)
    a = now.withColumn("folder", folder).join(some, "folder", "left_semi").select("path", F.struct("mtime_ms", "size").alias("a"))
    b = then.withColumn("folder", folder).join(some, "folder", "left_semi").select("path", F.struct("mtime_ms", "size").alias("b"))
    compared = written(a.join(b, "path", "full"), "compared-files")
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").otherwise("changed")
    return compared.filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", status.alias("status")), looked + compared.count()
