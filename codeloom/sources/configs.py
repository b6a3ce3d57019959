"""Aliases and module roots from configuration files: tsconfig.json, package.json and go.mod.

Such files are few and small, so their texts are read to the driver and become a table of aliases
(scope, alias, target): within the folder ``scope`` the module ``alias``, or what follows it and a slash, stands
for ``target``.  Files that can't be parsed count as absent.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_ignored, normalize_path

NAMES = r"(^|/)(tsconfig[^/]*\.json|jsconfig\.json|package\.json|go\.mod)$"
SCHEMA = "scope string, alias string, target string"


def read_texts(spark: SparkSession, root: str) -> dict[str, str]:
    """The configuration files below root by path, those of ignored folders apart."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("path", normalize_path(F.regexp_replace("path", "^file:", "")))
    kept = found.filter(F.col("path").rlike(NAMES) & ~is_ignored(F.col("path")) & (F.col("length") <= 1 << 20))
    return {r.path: r.text for r in kept.select("path", F.decode("content", "UTF-8").alias("text")).collect()}  # a few small files


def _json(text: str | None) -> dict:
    try:
        found = json.loads(text or "")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _join(folder: str, *parts: str) -> str:
    return posixpath.normpath(posixpath.join(folder, *parts))


def _paths(texts: Mapping[str, str], path: str, seen: frozenset[str] = frozenset()) -> dict[str, str]:
    """Aliases of a tsconfig and, below them in rank, of what it extends."""
    if path in seen or path not in texts:
        return {}
    said, folder = _json(texts[path]), posixpath.dirname(path)
    out: dict[str, str] = {}
    extends = said.get("extends")
    for parent in [extends] if isinstance(extends, str) else extends or []:
        target = _join(folder, parent)
        out |= _paths(texts, target if target in texts else target + ".json", seen | {path})
    options = said.get("compilerOptions") or {}
    for alias, targets in (options.get("paths") or {}).items():
        if targets:
            out[alias.removesuffix("/*")] = _join(folder, options.get("baseUrl") or ".", targets[0].removesuffix("/*"))
    return out


def _target(value) -> str | None:
    """The file of an entry that may depend on conditions: its default, else the first one."""
    if isinstance(value, dict):
        value = value.get("default") or next(iter(value.values()), None)
    return value if isinstance(value, str) else _target(value) if isinstance(value, dict) else None


def aliases(texts: Mapping[str, str]) -> list[tuple[str, str, str]]:
    """(scope, alias, target) of all configuration files, given by path."""
    out: dict[tuple[str, str], str] = {}
    packages = {posixpath.dirname(p): _json(t) for p, t in texts.items() if posixpath.basename(p) == "package.json"}
    for folder, said in packages.items():
        for pattern in (w.get("packages", []) if isinstance(w := said.get("workspaces") or [], dict) else w):
            shape = re.escape(_join(folder, pattern)).replace(r"\*\*", ".*").replace(r"\*", "[^/]*")
            for other, inner in packages.items():
                if inner.get("name") and re.fullmatch(shape, other):
                    out[folder, inner["name"]] = other
        for group in ("dependencies", "devDependencies"):
            for name, place in (said.get(group) or {}).items():
                if isinstance(place, str) and place.startswith("file:"):
                    out[folder, name] = _join(folder, place[5:])
        for name, value in (said.get("imports") or {}).items():
            if target := _target(value):
                out[folder, name.removesuffix("/*")] = _join(folder, target.removesuffix("/*"))
    for path in texts:
        if re.fullmatch(r"(tsconfig|jsconfig)\.json", posixpath.basename(path)):
            out |= {(posixpath.dirname(path), alias): target for alias, target in _paths(texts, path).items()}
    return sorted((scope, alias, target) for (scope, alias), target in out.items())


def alias_table(spark: SparkSession, texts: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(aliases(texts), SCHEMA)


def go_modules(texts: Mapping[str, str]) -> dict[str, str]:
    """Module prefixes of go.mod files with their folders."""
    found = {posixpath.dirname(p): re.search(r"(?m)^\s*module\s+(\S+)", t or "") for p, t in texts.items() if posixpath.basename(p) == "go.mod"}
    return {m[1]: folder for folder, m in found.items() if m}
