"""Registered streams, each run over what is there now and read back, with the SQL of the same result in one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files, tables
from ..storage import shared_folder
from ..streaming import changes, usage
from .queries import _FOUND, NODES, example, query
from .workspace_tools import _rows

_EVENTS = "e AS (SELECT 'u' || user_id AS path, ts, CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'create' ELSE 'change' END AS event_type FROM events)"


def _events(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "create").otherwise("change")
    return tables.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event_type"))


def _run(spark, stream, schema):
    """All that the stream gives for what is there now, kept as Parquet."""
    out, checkpoint = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-checkpoint")
    run = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not run.awaitTermination(600):
        run.stop()
        raise TimeoutError("the stream did not end")
    return spark.read.schema(schema).parquet(out)


@query(_FOUND["t1_debounce"][1])
def t1_debounce_stream(spark, sf_dir):
    """The bursts of all events as a stream; an event of much later closes the last ones."""
    events, folder = _events(spark, sf_dir), shared_folder(spark, "events")
    later = events.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(F.lit("end").alias("path"), "ts", F.lit("change").alias("event_type"))
    events.unionByName(later).write.parquet(folder)
    found = changes.debounce(spark.readStream.schema(events.schema).parquet(folder), "2 hours", "1 day")
    shown = found.select("path", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "events")
    return _run(spark, shown, shown.schema).filter("path != 'end'")


@query(f"""WITH {_EVENTS}, s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS burst FROM s)
    SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, arg_max(event_type, epoch_us(ts) * 10 + list_position(['create', 'change', 'delete'], event_type)) AS event_type, count(*) AS events FROM g GROUP BY path, burst""")
def t2_last_event_wins(spark, sf_dir):
    return changes.debounce(_events(spark, sf_dir), "2 hours", last_wins=True).select("path", F.date_format(F.col("started"), "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "events")


@query(f"WITH {NODES} SELECT id, path, CAST(CASE WHEN path LIKE '%2.src' THEN start_line + 1 ELSE start_line END AS INTEGER) AS start_line FROM nodes WHERE path NOT LIKE '%1.src'")
def t4_incremental_index(spark, sf_dir):
    """A stream of changes in micro-batches of a file of them each: some files go, some are read again."""
    nodes, folder = tables.part_nodes(spark, sf_dir), shared_folder(spark, "file-changes")
    some = nodes.select("path").distinct().filter("path like '%1.src' or path like '%2.src'").withColumn("event_type", F.when(F.col("path").like("%1.src"), "delete").otherwise("change"))
    some.repartition(3, "path").write.parquet(folder)
    edges = tables.first_followers(spark, sf_dir)
    now = nodes.withColumn("start_line", F.col("start_line") + 1)
    read = lambda paths: (now.join(paths, "path", "left_semi").select(*nodes.columns), edges.limit(0))
    stream = spark.readStream.schema(some.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return changes.follow(stream, nodes, edges, read, shared_folder(spark, "changes-checkpoint"))[0].select("id", "path", "start_line")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS mtime_ms, o_custkey AS size FROM orders WHERE o_custkey % 7 = 0 OR o_orderkey % 5 = 0")
def t5_stale_files(spark, sf_dir):
    """The files to read again, as a look at them now finds new times for some and others that were never indexed."""
    o = tables.table(spark, sf_dir, "orders")
    now = o.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("mtime_ms"), F.col("o_custkey").alias("size"))
    return files.stale(now, now.filter("size % 7 != 0").withColumn("mtime_ms", F.col("mtime_ms") - (F.col("mtime_ms") % 5 == 0).cast("int")))


_ASKED = [("a", "b", 1, None, 0), ("a", "b", 1, True, 1), ("a", "b", 1, None, 2), ("a", "b", 2, None, 3), ("a", "b", 2, None, 4), ("c", "d", 7, False, 0), ("c", "d", 7, None, 23), ("c", "d", 7, None, 26)]
_OUTCOMES = ["absent", "stored", "hit", "changed", "absent", "stored", "hit", "expired"]
_ANSWERS = [None, True, True, None, None, False, False, None]


@example(_rows("source_path VARCHAR, hour INTEGER, used BOOLEAN, outcome VARCHAR", *[(a[0], a[4], used, outcome) for a, used, outcome in zip(_ASKED, _ANSWERS, _OUTCOMES, strict=True)]))
def t7_usage_cache(spark, sf_dir):
    """Questions and answers about usage over 26 hours, by a written list; the SQL has the outcome of each."""
    began = F.lit("2024-01-01 00:00:00").cast("timestamp")
    asked = spark.createDataFrame(_ASKED, "source_path string, target_path string, mtime_ms long, used boolean, hour int")
    asked = asked.select("source_path", "target_path", "mtime_ms", "used", (began + F.make_dt_interval(hours=F.col("hour"))).alias("ts"))
    folder = shared_folder(spark, "usage")
    asked.coalesce(1).write.parquet(folder)
    found = usage.cached(spark.readStream.schema(asked.schema).parquet(folder))
    shown = found.select("source_path", ((F.unix_timestamp("ts") - F.unix_timestamp(began)) / 3600).cast("int").alias("hour"), "used", "outcome")
    return _run(spark, shown, shown.schema)
