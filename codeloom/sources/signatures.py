"""Parameters of functions in source text, for comparing two versions of it.

``name: type = default`` is common to the languages covered (script languages, Python, Rust).  Parameter
lists with brackets of their own in round form (a callback's type, a call as default) are cut at the first
closing bracket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .definitions import blank

_HEAD = r"(?:\bfunction\s*\*?|\bdef|\bfn)\s+(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)"
LANGS = ("typescript", "javascript", "vue", "svelte", "python", "rust")


def signatures(files: DataFrame, version: str) -> DataFrame:
    """(file_path, version, name, position, param, type, is_optional) of files (path, text, lang); own objects are no parameters.

    Of several functions of one name in a file the first counts.
    """
    code = F.when(F.col("lang") == "python", F.regexp_replace("text", r"#[^\n]*", "")).when(F.col("lang") == "rust", blank(F.col("text"), False)).otherwise(blank(F.col("text")))
    source = files.filter(F.col("lang").isin(*LANGS) & F.col("text").isNotNull()).select("path", F.explode(F.array(code)).alias("code"))
    found = source.select("path", F.posexplode(F.arrays_zip(F.regexp_extract_all("code", F.lit(_HEAD), F.lit(1)).alias("name"), F.regexp_extract_all("code", F.lit(_HEAD), F.lit(2)).alias("list"))).alias("at", "f"))
    first = found.groupBy("path", F.col("f.name").alias("name")).agg(F.min_by("f.list", "at").alias("list"))
    parts = F.filter(F.transform(F.split("list", r",(?![^<\[{]*[>\]}])"), lambda p: F.trim(p)), lambda p: ~p.rlike(r"^(|self|cls|&?(?:'\w+\s+)?(?:mut\s+)?self|/|\*)$"))
    each = first.select("path", "name", F.posexplode(parts).alias("position", "said"))
    param = F.regexp_extract("said", r"^(?:mut\s+|\.\.\.|\*{0,2})?\s*(\w+)", 1)
    kind = F.trim(F.regexp_extract("said", r"^[^:=]*:\s*([^=]+)", 1))
    optional = F.col("said").rlike(r"^\w+\?|=|^\.\.\.|^\*")
    return each.select(F.col("path").alias("file_path"), F.lit(version).alias("version"), "name", "position", param.alias("param"), kind.alias("type"), optional.alias("is_optional"))
