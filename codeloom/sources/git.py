"""Versions of files from a git repository on the driver; what changed in a review is a bounded list."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language


def _git(repo: str, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=60, check=False)


def changed_files(spark: SparkSession, repo: str, base: str, head: str = "HEAD") -> DataFrame:
    """(path, status): files that differ between two references, relative to the repository; renames as both names."""
    said = _git(repo, "diff", "--name-status", "--no-renames", "-z", f"{base}...{head}")
    if said.returncode:
        raise ValueError(said.stderr.decode(errors="replace").strip())
    parts = said.stdout.decode(errors="replace").split("\0")[:-1]
    return spark.createDataFrame(list(zip(parts[1::2], parts[::2], strict=True)), "path string, status string")


def files_at(spark: SparkSession, repo: str, ref: str, paths: list[str]) -> DataFrame:
    """(path, text, lang) of those of the files that the reference has, by one process; names with a line break are passed over."""
    asked = [p for p in paths if "\n" not in p]
    said = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input="".join(f"{ref}:{p}\n" for p in asked).encode(), capture_output=True, timeout=600, check=False)
    found, at = [], 0
    for p in asked:
        end = said.stdout.find(b"\n", at)
        if end < 0:
            raise ValueError(said.stderr.decode(errors="replace").strip())
        # A line of name, kind and size before the content, or of the question and "missing".
        *_, kind, size = [b"", *said.stdout[at:end].split(b" ")]
        at = end + 1
        if size.isdigit():
            if kind == b"blob":
                found.append((p, said.stdout[at : at + int(size)].decode(errors="replace")))
            at += int(size) + 1
    return spark.createDataFrame(found, "path string, text string").withColumn("lang", language(F.col("path")))
