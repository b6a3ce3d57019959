"""URL filters as a temporal list join, in DataFrame operations alone.

A list holds dated entries (pattern, listed_at, action).  A pattern is a domain, which covers its
subdomains, or a host followed by the first segments of a path.  Actions are ``block``, ``allow`` and
``delist``.  An entry is in force from its date until the next entry for its pattern, which gives validity
intervals.  Every capture (url, fetched_at) meets, in an as-of join, the entries in force when it was
fetched; the most specific pattern decides.

* Only as many host labels and path segments are tried as some pattern has, so long addresses stay cheap.
* Intervals and captures meet by pattern and span of ``SPAN_DAYS`` days, so a pattern with a long history
  is spread over its spans, and a capture is compared with the entries of its own span alone.
* Decisions are made once for each different (url, fetched_at).  Lists are broadcast only if their bytes
  are counted to be few (``BROADCAST_BYTES``); a larger list is met by a shuffled join, whose skewed keys
  Spark splits.

Defined results: a null or unparsable url, or a null fetch date, is not blocked and has no pattern; entries
with a null or empty pattern, date or action are passed over; of entries for a pattern at one date the
strictest counts (block, allow, delist); ties between patterns of equal length go to the greater one;
repeated rows get equal results; empty tables give empty results or no blocks; columns of the captures
named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fields, join_by_key, materialise, packed, small, without

SPAN_DAYS = 64
BROADCAST_BYTES = 8 << 20
ACTIONS = ("delist", "allow", "block")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def _span(day: Column) -> Column:
    return F.floor(F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date")) / SPAN_DAYS).cast("int")


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to, span): a row for every span that an interval touches.

    The next entry is looked up within a span, and else in the first entries of later spans.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.lower("action"))
    # A pattern means the same with a slash at its end.
    dated = entries.select(F.regexp_replace(F.lower("pattern"), "/+$", "").alias("pattern"), F.col("listed_at").alias("valid_from"), rank.alias("rank")).filter("pattern != '' and valid_from is not null and rank > 0")
    dated = dated.groupBy("pattern", "valid_from").agg(F.max("rank").cast("int").alias("rank")).withColumn("span", _span(F.col("valid_from")))
    firsts = dated.groupBy("pattern", "span").agg(F.min("valid_from").alias("first"))
    later = firsts.select("pattern", "span", F.lead("first").over(W.partitionBy("pattern").orderBy("span")).alias("_later"))
    inner = F.lead("valid_from").over(W.partitionBy("pattern", "span").orderBy("valid_from"))
    held = dated.withColumn("_next", inner).join(later, ["pattern", "span"])
    return held.select("pattern", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank")).alias("action"), "valid_from", F.coalesce("_next", "_later").alias("valid_to"), "span")


def _spread(intervals: DataFrame, last: int | None) -> DataFrame:
    """Intervals in every span up to that of the last capture."""
    until = F.least(F.coalesce(_span(F.col("valid_to")), F.lit(last)), F.lit(last)) if last is not None else F.col("span")
    return intervals.filter(F.col("span") <= until).withColumn("span", F.explode(F.sequence("span", until)))


def _candidates(url: Column, labels: list[int], segments: list[int]) -> Column:
    """The patterns that a url can match: its last labels, and its host with its first segments."""
    parts, path = F.split(host(url), r"\."), F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    domains = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    if not segments:
        return domains
    prefixes = F.transform(F.filter(F.array(*map(F.lit, segments)), lambda n: n <= F.size(path)), lambda n: F.concat_ws("/", host(url), F.lower(F.array_join(F.slice(path, F.lit(1), n), "/"))))
    return F.array_distinct(F.concat(domains, prefixes))


def decide(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with ``blocked``, and the deciding ``pattern`` and its ``listed_at``, null if none is in force."""
    captures = without(captures, "blocked", "pattern", "listed_at")
    url, time = F.col(f"`{url_col}`"), F.col(f"`{time_col}`")
    intervals = materialise(validity_intervals(entries), "list-intervals")
    is_path = F.contains("pattern", F.lit("/"))
    shapes = intervals.select(is_path.alias("p"), F.when(is_path, F.size(F.split("pattern", "/")) - 1).otherwise(F.size(F.split("pattern", r"\."))).alias("n")).distinct().collect()  # one row for each depth of pattern
    labels, segments = ([r.n for r in shapes if r.p == p] for p in (False, True))
    last = captures.agg(F.max(_span(time))).first()[0]
    if not shapes or last is None:
        return captures.withColumns({"blocked": F.lit(False), "pattern": F.lit(None).cast("string"), "listed_at": F.lit(None).cast(entries.schema["listed_at"].dataType)})
    spread = _spread(intervals.filter("action != 'delist'"), last)

    asked = captures.filter(url.isNotNull() & time.isNotNull()).select(url.alias("_url"), time.alias("_time")).distinct()
    tried = asked.select(F.xxhash64("_url").alias("_u1"), F.xxhash64(F.lit(1), "_url").alias("_u2"), "_time", _span(F.col("_time")).alias("span"), F.explode(_candidates(F.col("_url"), labels or [0], segments)).alias("pattern"))
    met = tried.join(small(spread, BROADCAST_BYTES, F.octet_length("pattern") + 40), ["pattern", "span"]).filter((F.col("_time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_time") < F.col("valid_to"))))
    best = met.groupBy("_u1", "_u2", "_time").agg(F.max(F.struct(F.length("pattern").alias("length"), "pattern", "action", "valid_from")).alias("best"))
    best = materialise(best.select("_u1", "_u2", "_time", "best.pattern", "best.action", F.col("best.valid_from").alias("listed_at")), "url-decisions")
    rows = packed(captures, F.xxhash64(url).alias("_u1"), F.xxhash64(F.lit(1), url).alias("_u2"), time.alias("_time"))
    joined = join_by_key(rows, best, ["_u1", "_u2", "_time"], "left", most=BROADCAST_BYTES, row_bytes=F.octet_length("pattern") + 60)
    return joined.select(*fields(captures), F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"), "pattern", "listed_at")


def allowed(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The captures that no list entry blocked when they were fetched, with their own columns."""
    marked = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("_row"), F.col(f"`{url_col}`").alias("_url"), F.col(f"`{time_col}`").alias("_at"))
    return decide(marked, entries, "_url", "_at").filter("not blocked").select("_row.*")
