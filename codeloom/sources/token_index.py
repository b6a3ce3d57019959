"""An inverted index of tokens that is kept on disk, searched by the beginnings of tokens and updated by file.

Postings (token, id, path) lie in folders by the first characters of the token, sorted by token, so a search for a
beginning reads the folder of its first characters and in it, by the files' own minima and maxima, the part with that
beginning.  A changed file writes its own postings as a new version and its path as one that has gone before; what
older versions hold of it is passed over when postings are read.

Defined results: a name without tokens has no postings; a search without words finds nothing; ids that several
rows have count once; names of any length are taken whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import identifier_tokens
from ..storage import if_small
from ..streaming.store import Versions


class TokenIndex(Versions):
    """``width`` characters of a token name its folder; ``tokens`` makes the tokens of a name."""

    KINDS = ("postings", "gone")

    def __init__(self, spark: SparkSession, folder: str, width: int = 2, tokens=identifier_tokens):
        super().__init__(spark, folder)
        self.width, self.tokens = width, tokens

    def _head(self, token: Column) -> Column:
        """The first characters in hexadecimal digits, as any of them may stand in a token but not in a folder's name."""
        return F.hex(F.left(token, F.lit(self.width)))

    def _enter(self, version: int, rows: DataFrame, paths: DataFrame, base: bool) -> None:
        made = rows.select("id", "path", F.explode(F.array_distinct(self.tokens(F.col("name")))).alias("token")).select("token", "id", "path").distinct()
        made = made.withColumn("head", self._head(F.col("token"))).hint("rebalance", "head").sortWithinPartitions("head", "token", "id")
        made.write.mode("overwrite").partitionBy("head").parquet(f"{self.folder}/postings/version={version}")
        paths.select("path").distinct().write.mode("overwrite").parquet(f"{self.folder}/gone/version={version}")
        self._commit(version, base)

    def build(self, rows: DataFrame) -> None:
        """Indexes all rows (id, name, path)."""
        self._enter(1, rows, rows.select("path").limit(0), True)

    def update(self, version: int, paths: DataFrame, rows: DataFrame) -> bool:
        """Replaces the postings of the files (path) by those of rows (id, name, path); False if that version is there already."""
        if 2 * version <= self.commits()[-1][0]:
            return False
        self._enter(2 * version, rows.join(if_small(paths.select("path").distinct()), "path", "left_semi"), paths, False)
        return True

    def postings(self, beginnings: list[str]) -> DataFrame:
        """(token, id, path) of the tokens with any of these beginnings."""
        fields = [T.StructField(c, T.StringType()) for c in ("token", "id", "path", "head")]
        rows = self._read("postings", T.StructType(fields))
        known = sorted(set(beginnings))
        if not known:
            return rows.limit(0).select("token", "id", "path")
        heads = [w[: self.width].encode().hex().upper() for w in known]
        folders = reduce(Column.__or__, [F.col("head") == h if len(w) >= self.width else F.startswith("head", F.lit(h)) for w, h in zip(known, heads, strict=True)])
        found = rows.filter(folders).filter(reduce(Column.__or__, [F.col("token").startswith(w) for w in known]))
        return found.join(self._last("gone", "path"), "path", "left").filter("_last is null or version >= _last").select("token", "id", "path")

    def scores(self, keywords: list[str], per_keyword: int | None = 50, most: int | None = 20) -> DataFrame:
        """(id, score): how many keywords an id meets, each word of which begins some token of its name."""
        words = sorted({(k, t) for k in keywords for t in k.lower().split()})
        each = sorted({t for _, t in words})
        met = F.filter(F.array(*[F.lit(t) for t in each]) if each else F.array().cast("array<string>"), lambda t: F.startswith("token", t))
        hits = self.postings(each).select("id", F.explode(met).alias("wanted")).distinct()
        wanted = F.broadcast(self.spark.createDataFrame(words or [("", "")], "keyword string, wanted string"))
        need = wanted.groupBy("keyword").agg(F.count("*").alias("_n"))
        full = hits.join(wanted, "wanted").groupBy("keyword", "id").agg(F.count("*").alias("_met")).join(need, "keyword").filter("_met = _n")
        if per_keyword is not None:
            full = full.withColumn("_k", F.row_number().over(W.partitionBy("keyword").orderBy("id"))).filter(F.col("_k") <= per_keyword)
        scored = full.groupBy("id").agg(F.count("*").alias("score"))
        return scored if most is None else scored.orderBy(F.desc("score"), "id").limit(most)
