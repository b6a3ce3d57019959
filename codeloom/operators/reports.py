"""Roll-ups over a whole workspace: architecture, index state, code maps, wiki articles, diagrams, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import relative_path
from . import relational

COUNTS = ("calls", "jsonTokens", "toonTokens", "savings", "truncations")


def architecture(files: DataFrame, file_edges: DataFrame, root: str) -> DataFrame:
    """Every file below root with its dependencies and dependents; edges out of the root don't count, repeats count once."""
    inside = lambda c: F.startswith(c, F.lit(root.rstrip("/") + "/"))
    edges = file_edges.filter(inside(F.col("target_path")) & inside(F.col("source_path"))).select("source_path", "target_path").distinct()
    paths = files.select("path").filter(inside(F.col("path"))).union(edges.select("source_path")).union(edges.select("target_path")).distinct()
    out = edges.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("dependencies"))
    into = edges.groupBy(F.col("target_path").alias("path")).agg(F.count("*").alias("dependents"))
    return paths.join(out, "path", "left").join(into, "path", "left").fillna(0, ["dependencies", "dependents"]).select(
        "path", relative_path(F.col("path"), root).alias("relative"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("extension"), "dependencies", "dependents"
    )


def index_stats(file_edges: DataFrame) -> DataFrame:
    """One row: indexed files, files that are referred to, references."""
    return file_edges.agg(F.countDistinct("source_path").alias("indexed_files"), F.countDistinct("target_path").alias("targets"), F.count("*").alias("references"))


def staleness(indexed: DataFrame, current: DataFrame, threshold: float = 0.2) -> DataFrame:
    """One row: indexed files, missing and stale ones, their share, and whether the index is still valid."""
    now = current.select("path", F.col("mtime_ms").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_there"))
    both = indexed.join(now, "path", "left")
    missing, same = F.col("_there").isNull(), F.col("mtime_ms").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s"))
    one = both.agg(F.count("*").alias("files"), F.count_if(missing).alias("missing"), F.count_if(~missing & ~same).alias("stale"))
    share = F.when(F.col("files") > 0, (F.col("missing") + F.col("stale")) / F.col("files")).otherwise(0.0)
    return one.withColumn("share", share).withColumn("is_valid", F.col("share") <= threshold)


def by_severity(changes: DataFrame) -> DataFrame:
    """Changes of signatures counted by whether they break callers."""
    return changes.groupBy(F.when(F.col("breaking"), "breaking").otherwise("compatible").alias("severity"), "change").agg(F.count("*").alias("n"))


def codemap(nodes: DataFrame, edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """One row per file: exported and inner symbols, files it depends on and that depend on it, cyclic edges.

    Lists hold what one file defines or refers to.  Dependents are counted and not listed, as a common file
    may have any number of them.
    """
    own = nodes.groupBy("path").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_exported"), F.col("name")))).alias("exports"), F.sort_array(F.collect_list(F.when(~F.col("is_exported"), F.col("name")))).alias("internals")
    )
    across = relational.with_ends(nodes, edges, "path").filter("source_path != target_path").select("source_path", "target_path").distinct()
    uses = across.groupBy(F.col("source_path").alias("path")).agg(F.sort_array(F.collect_list("target_path")).alias("dependencies"))
    used = across.groupBy(F.col("target_path").alias("path")).agg(F.count("*").alias("dependents"))
    rings = relational.with_ends(nodes, cyclic, "path").groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("cyclic_edges"))
    none = F.array().cast("array<string>")
    joined = own.join(uses, "path", "left").join(used, "path", "left").join(rings, "path", "left")
    return joined.select("path", "exports", "internals", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", F.lit(0)).alias("dependents"), F.coalesce("cyclic_edges", F.lit(0)).alias("cyclic_edges"))


def _section(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def articles(nodes: DataFrame, edges: DataFrame, most_callers: int = 20) -> DataFrame:
    """(path, score, article): a Markdown article per file with its symbols, callers and hub score."""
    symbol = F.concat(F.lit("- `"), F.col("name"), F.lit("` ("), F.col("type"), F.lit(", line "), F.col("start_line").cast("string"), F.lit(")"))
    listed = nodes.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "id", symbol.alias("text")))), lambda s: s["text"]).alias("symbols"))
    top = relational.top_callers_by_file(nodes, edges, most_callers)
    called = top.groupBy(F.col("target_path").alias("path")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source_id"))), lambda s: F.concat(F.lit("- `"), s["source_id"], F.lit("`"))).alias("callers"))
    score = relational.inbound_by_file(nodes, edges).select("path", "score")
    joined = listed.join(called, "path", "left").join(score, "path", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    callers = F.coalesce("callers", F.array().cast("array<string>"))
    text = F.concat(F.lit("# "), F.col("path"), F.lit("\n\nHub score: "), F.col("score").cast("string"), F.lit("\n"), _section("Symbols", F.col("symbols")), _section("Callers", callers))
    return joined.select("path", "score", text.alias("article"))


def write_articles(found: DataFrame, path: str) -> None:
    """One Parquet row per article, in folders by score decile, which readers of hubs can prune by."""
    found.withColumn("decile", F.floor(F.col("score") / 10).cast("int")).write.partitionBy("decile").mode("overwrite").parquet(path)


def diagram(file_edges: DataFrame, most_nodes: int = 50, most_edges: int = 40) -> DataFrame:
    """One row with a Mermaid flow chart of the files with most links, and the edges between those.

    The limits are the feature: a chart is for reading.  At most ``most_edges`` lines come together.
    """
    edges = file_edges.filter("source_path != target_path").select("source_path", "target_path").distinct()
    ends = edges.select(F.col("source_path").alias("path")).union(edges.select("target_path"))
    top = ends.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(most_nodes).select("path")
    name = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    shown = edges.join(F.broadcast(top.toDF("source_path")), "source_path", "left_semi").join(F.broadcast(top.toDF("target_path")), "target_path", "left_semi")
    shown = shown.orderBy("source_path", "target_path").limit(most_edges)
    line = F.concat(F.lit("  "), name(F.col("source_path")), F.lit(" --> "), name(F.col("target_path")))
    return shown.agg(F.concat_ws("\n", F.lit("flowchart LR"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_path", "target_path", line.alias("line")))), lambda s: s["line"]), "\n")).alias("diagram"))


def _node_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", "_")


def _joined(rows: DataFrame, order: list[str], line: Column) -> Column:
    """The lines of rows in order, as one text; the rows must be limited, as they come together."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda s: s["line"]), "\n")


def caller_diagram(file_edges: DataFrame, path: str, most: int = 50) -> DataFrame:
    """One row with a Mermaid flow chart of the first ``most`` files that refer to a file."""
    callers = file_edges.filter((F.col("target_path") == path) & (F.col("source_path") != path)).select("source_path").distinct().orderBy("source_path").limit(most)
    line = F.concat(F.lit("  "), _node_name(F.col("source_path")), F.lit(" --> "), _node_name(F.lit(path)))
    return callers.agg(F.concat_ws("\n", F.lit("flowchart LR"), _joined(callers, ["source_path"], line)).alias("diagram"))


def architecture_diagram(found: DataFrame, file_edges: DataFrame, most_nodes: int = 50, most_edges: int = 40) -> DataFrame:
    """One row with a Mermaid chart of the articles (path, score) of the highest scores, and the references between them."""
    hubs = found.select("path", "score").orderBy(F.desc("score"), "path").limit(most_nodes)
    ends = file_edges.filter("source_path != target_path").select("source_path", "target_path").distinct()
    ends = ends.join(F.broadcast(hubs.select(F.col("path").alias("source_path"))), "source_path", "left_semi").join(F.broadcast(hubs.select(F.col("path").alias("target_path"))), "target_path", "left_semi")
    shown = ends.select("source_path", "target_path").orderBy("source_path", "target_path").limit(most_edges)
    label = F.concat(F.lit("  "), _node_name(F.col("path")), F.lit('["'), "path", F.lit(" ("), F.col("score").cast("string"), F.lit(')"]'))
    boxes = hubs.withColumn("_order", -F.col("score")).agg(_joined(hubs, ["_order", "path"], label).alias("boxes"))
    line = F.concat(F.lit("  "), _node_name(F.col("source_path")), F.lit(" --> "), _node_name(F.col("target_path")))
    arrows = shown.agg(_joined(shown, ["source_path", "target_path"], line).alias("arrows"))
    return boxes.crossJoin(arrows).select(F.array_join(F.filter(F.array(F.lit("flowchart TD"), "boxes", "arrows"), lambda t: t != ""), "\n").alias("diagram"))  # one row each


def index_page(found: DataFrame, hubs: int = 10, most: int = 10_000) -> DataFrame:
    """One row with a Markdown page of the top hubs and of the first ``most`` articles (path, score) by path."""
    link = F.concat(F.lit("- ["), "path", F.lit("](articles/"), F.replace("path", F.lit("/"), F.lit("_")), F.lit(".md)"))
    top = found.select("path", "score").orderBy(F.desc("score"), "path").limit(hubs).withColumn("_order", -F.col("score"))
    scored = F.concat(link, F.lit(" ("), F.col("score").cast("string"), F.lit(")"))
    listed = found.select("path").orderBy("path").limit(most)
    both = top.agg(_joined(top, ["_order", "path"], scored).alias("top")).crossJoin(listed.agg(_joined(listed, ["path"], link).alias("files")))  # one row each
    return both.select(F.concat(F.lit("# Index\n\n## Top hubs\n\n"), "top", F.lit("\n\n## Files\n\n"), "files", F.lit("\n")).alias("page"))


def graph_report(nodes: DataFrame, file_edges: DataFrame, title: str, most_nodes: int = 260, most_edges: int = 500, label: int = 120) -> DataFrame:
    """One row with a Markdown list of a graph's files and edges; the limits are the feature, and what is cut shows as dots."""
    short = lambda c: F.when(F.length(c) > label, F.concat(F.left(c, F.lit(label - 3)), F.lit("..."))).otherwise(c)
    some, ends = nodes.select("path").orderBy("path").limit(most_nodes), file_edges.select("source_path", "target_path").orderBy("source_path", "target_path").limit(most_edges)
    total = nodes.agg(F.count("*").alias("n")).crossJoin(file_edges.agg(F.count("*").alias("e")))  # one row each, as are the next two
    lists = some.agg(_joined(some, ["path"], F.concat(F.lit("- "), short(F.col("path")))).alias("nodes")).crossJoin(ends.agg(_joined(ends, ["source_path", "target_path"], F.concat(F.lit("- "), short(F.col("source_path")), F.lit(" -> "), short(F.col("target_path")))).alias("edges")))
    dots = lambda n, most: F.when(F.col(n) > most, "\n- ...").otherwise("")
    text = F.concat(F.lit(f"# {title}\n\n"), F.col("n").cast("string"), F.lit(" nodes, "), F.col("e").cast("string"), F.lit(" edges\n\n"), "nodes", dots("n", most_nodes), F.lit("\n\n"), "edges", dots("e", most_edges), F.lit("\n"))
    return total.crossJoin(lists).select(text.alias("report"))


def session_totals(sessions: DataFrame) -> DataFrame:
    """Sessions of schema version 1 summed by source; real model usage stays apart from estimates."""
    sums = [F.sum(f"totals.{c}").alias(c) for c in COUNTS] + [F.sum("llmUsage.tokensUsed").alias("llmTokensUsed"), F.sum("llmUsage.calls").alias("llmCalls")]
    return sessions.filter("schemaVersion = 1").groupBy("source").agg(F.count("*").alias("sessions"), *sums)


def tool_totals(sessions: DataFrame) -> DataFrame:
    """Sums by tool over all sessions of schema version 1."""
    each = sessions.filter("schemaVersion = 1").select(F.explode("byTool").alias("tool", "t"))
    return each.groupBy("tool").agg(*[F.sum(f"t.{c}").alias(c) for c in COUNTS])


def newest_sessions(sessions: DataFrame, most: int = 50) -> DataFrame:
    """The newest sessions of every source."""
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("startedAt"), "sessionId"))
    return sessions.withColumn("_k", rank).filter(F.col("_k") <= most).drop("_k")


def disambiguated(paths: DataFrame) -> DataFrame:
    """(path, label, same_name): the file name, with its folder where several files are called so."""
    parts = F.split("path", "/")
    base = F.element_at(parts, -1)
    n = F.count("*").over(W.partitionBy("_base"))
    folder = F.try_element_at(parts, F.lit(-2))
    return paths.withColumn("_base", base).withColumn("same_name", n).select(
        "path", F.when((F.col("same_name") > 1) & folder.isNotNull() & (folder != ""), F.concat(folder, F.lit("/"), "_base")).otherwise(F.col("_base")).alias("label"), "same_name"
    )


def compounds(nodes: DataFrame) -> DataFrame:
    """(id, kind, parent): the folders and files around nodes."""
    folders = nodes.select(F.col("folder").alias("id"), F.lit("folder").alias("kind"), F.lit(None).cast("string").alias("parent")).distinct()
    return folders.unionByName(nodes.select(F.col("path").alias("id"), F.lit("file").alias("kind"), F.col("folder").alias("parent")).distinct())


def oldest_files(nodes: DataFrame, share: float = 0.1) -> DataFrame:
    """The paths to evict when an index has grown too large: those not indexed for longest, a share of all, rounded up."""
    files = nodes.groupBy("path").agg(F.min("indexed_at").alias("indexed_at"))
    room = -(-files.count() * round(share * 1000) // 1000)
    return relational.ranked(files, "indexed_at", "path").filter(F.col("rank") <= room).drop("rank")


def review(nodes: DataFrame, edges: DataFrame, changes: DataFrame, paths: DataFrame, unused: DataFrame, tests: DataFrame, depth: int = 3) -> DataFrame:
    """Every node of the changed files (path) with its review score and risk, gravest first.

    ``edges`` carry is_cyclic; ``changes`` are compare_parameters rows; ``unused`` has ids; ``tests`` the paths
    of files with a test.  Dependents are those up to ``depth`` steps away; ``partial`` says that there may be more.
    """
    from ..functions.text import review_score, risk
    from .traverse import review_impact

    changed = nodes.join(paths.select("path").distinct(), "path", "left_semi").select("id", "name", "path")
    broken = changes.filter("breaking").groupBy(F.col("file_path").alias("path"), "name").agg(F.count("*").alias("breaking"))
    used = review_impact(edges, changed, depth)
    ring = edges.filter("is_cyclic").select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().withColumn("cyclic", F.lit(True))
    dead = unused.select("id").distinct().withColumn("unused", F.lit(True))
    tested = tests.select("path").distinct().withColumn("tested", F.lit(True))
    all_of = changed.join(broken, ["path", "name"], "left").join(used, "id", "left").join(ring, "id", "left").join(dead, "id", "left").join(tested, "path", "left")
    all_of = all_of.fillna(0, ["breaking", "dependents"]).fillna(False, ["cyclic", "unused", "tested", "partial"])
    score = review_score(F.col("breaking"), F.col("dependents"), F.col("cyclic"), F.col("unused"), ~F.col("tested"), F.col("partial"))
    return all_of.withColumn("score", score).withColumn("risk", risk(F.col("score"))).select("path", "name", "id", "breaking", "dependents", "cyclic", "unused", "tested", "partial", "score", "risk").orderBy(F.desc("score"), "path", "name")


def tested_files(files: DataFrame) -> DataFrame:
    """(path): files beside which, or in a test folder next to which, a test of their name stands."""
    stem, ext, folder = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), F.regexp_extract("path", r"\.([^./]+)$", 1), F.regexp_replace("path", r"/[^/]*$", "")
    names = [F.concat(stem, F.lit(".test."), ext), F.concat(stem, F.lit(".spec."), ext), F.concat(F.lit("test_"), stem, F.lit("."), ext), F.concat(stem, F.lit("_test."), ext)]
    places = [folder, F.concat(folder, F.lit("/tests")), F.concat(folder, F.lit("/__tests__"))]
    tried = files.select("path", F.explode(F.array(*[F.concat(p, F.lit("/"), n) for p in places for n in names])).alias("_test"))
    return tried.join(files.select(F.col("path").alias("_test")).distinct(), "_test", "left_semi").select("path").distinct()
