"""Small operators over graphs and reports: clusters, references, incremental updates, sessions and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import written
from . import cycles, relational


def hub_percent(nodes: DataFrame, edges: DataFrame, visible: DataFrame) -> DataFrame:
    """(id, score) from 0 to 100 over visible nodes (id): their in-degree against the largest of them."""
    scored = relational.hub_scores(nodes.join(visible.select("id").distinct(), "id", "left_semi"), edges, 9)
    return scored.select("id", F.round(100 * F.col("hub_score")).cast("int").alias("score"))


def top_hubs(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """The files of the highest hub scores, ties by path; ``most`` is the feature."""
    return relational.inbound_by_file(nodes, edges).orderBy(F.desc("score"), "path").limit(most)


def counts(nodes: DataFrame, edges: DataFrame, stub: str) -> DataFrame:
    """One row: files, nodes, edges and edges to stubs."""
    files = nodes.agg(F.countDistinct("path").alias("files"), F.count("*").alias("nodes"))
    return files.crossJoin(edges.agg(F.count("*").alias("edges"), F.count_if(F.startswith("target_id", F.lit(stub))).alias("stubs")))  # one row each


def diagram_ids(paths: DataFrame) -> DataFrame:
    """(path, node_id): the path with all but letters and digits replaced, numbered from 1 where it is taken."""
    base = F.regexp_replace("path", "[^A-Za-z0-9]", "_")
    k = F.row_number().over(W.partitionBy("_base").orderBy("path")) - 1
    numbered = paths.select("path").distinct().withColumn("_base", base).withColumn("_k", k)
    return numbered.select("path", F.when(F.col("_k") > 0, F.concat_ws("_", "_base", F.col("_k").cast("string"))).otherwise(F.col("_base")).alias("node_id"))


def representatives(members: DataFrame) -> DataFrame:
    """(community, id): the smallest node of each community above 0."""
    return members.filter("community > 0").groupBy("community").agg(F.min("id").alias("id"))


def clusters(symbols: DataFrame) -> DataFrame:
    """(id, type, name, namespace, symbol_ids, child_ids): a cluster for each file, and one for each class in it.

    A class's cluster has it and its members; a file's has its symbols without a parent and its classes.  A
    file bounds every list.
    """
    namespace = F.col("file_path")
    classes = symbols.filter("kind = 'class'").select("file_path", F.col("id").alias("class"), F.col("name").alias("class_name"))
    member = symbols.filter("parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("class"), F.col("file_path").alias("_p"), F.col("id").alias("member"))
    held = classes.join(member, (classes["class"] == member["class"]) & (classes["file_path"] == member["_p"]), "left").select(classes["class"], "class_name", "file_path", "member")
    own = held.groupBy("file_path", "class", "class_name").agg(F.array_sort(F.collect_list("member")).alias("members"))
    inner = own.select(F.concat_ws(":", "file_path", "class_name").alias("id"), F.lit("class").alias("type"), F.col("class_name").alias("name"), namespace.alias("namespace"), F.concat(F.array("class"), "members").alias("symbol_ids"), F.array().cast("array<string>").alias("child_ids"))
    top = symbols.groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") != "class") & F.col("parent_symbol_id").isNull(), F.col("id")))).alias("alone"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "class", F.col("id")))).alias("classes"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "class", F.concat_ws(":", "file_path", "name")))).alias("child_ids"),
    )
    outer = top.select(namespace.alias("id"), F.lit("namespace").alias("type"), F.substring_index("file_path", "/", -1).alias("name"), namespace.alias("namespace"), F.concat("alone", "classes").alias("symbol_ids"), "child_ids")
    return outer.unionByName(inner)


def visible_symbols(found: DataFrame, opened: DataFrame) -> DataFrame:
    """(id) of the symbols that show when only the clusters of ``opened`` (id) are open: a closed file shows none.

    An open file shows its own symbols, and an open class in it its members.
    """
    is_open = found.join(opened.select("id").distinct(), "id", "left_semi")
    files = is_open.filter("type = 'namespace'")
    inner = is_open.filter("type = 'class'").join(files.select("namespace"), "namespace", "left_semi")
    return files.select(F.explode("symbol_ids").alias("id")).union(inner.select(F.explode("symbol_ids").alias("id"))).distinct()


def merge_references(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """References (path, line, module) of both tables, one a path: the indexed ones first, then by line."""
    both = indexed.withColumn("_from", F.lit(0)).unionByName(found.withColumn("_from", F.lit(1)))
    rest = [c for c in indexed.columns if c != "path"]
    return both.groupBy("path").agg(F.min(F.struct("_from", *rest)).alias("m")).select("path", *[f"m.{c}" for c in rest])


def referring_only(file_edges: DataFrame, references: DataFrame) -> DataFrame:
    """The edges whose source is among the files (path) that refer to something."""
    return file_edges.join(references.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_semi").select(*file_edges.columns)


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id) of the old nodes that are gone."""
    return old.select("id").join(new.select("id"), "id", "left_anti").distinct()


def mark_some(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """edges with ``is_cyclic`` set anew for the edges of the given sources (id); all others keep theirs."""
    marked = cycles.mark_cycles(edges.drop("is_cyclic")).withColumnRenamed("is_cyclic", "_now")
    key = ["source_id", "target_id", "type_relation"]
    chosen = sources.select(F.col("id").alias("source_id"), F.lit(True).alias("_chosen")).distinct()
    joined = edges.join(marked.select(*key, "_now"), key).join(chosen, "source_id", "left")
    return joined.select(*[F.when(F.col("_chosen").isNotNull(), F.col("_now")).otherwise(F.col("is_cyclic")).alias(c) if c == "is_cyclic" else F.col(c) for c in edges.columns])


def replace_dependencies(file_edges: DataFrame, changed: DataFrame, now: DataFrame) -> DataFrame:
    """The reverse index after files (path) changed or went: their old references go, those of ``now`` come, each once."""
    kept = file_edges.join(changed.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_anti").select(*file_edges.columns)
    return kept.unionByName(now.select(*file_edges.columns)).dropDuplicates(["source_path", "target_path"])


def to_index(files: DataFrame, indexed: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The files (path, lang, mtime_ms) to read again: never indexed, changed since, or indexed before their language's rules.

    ``indexed`` has path, last_modified, indexed_at; ``cutoffs`` lang, cutoff.  Files without a language are left out.
    """
    old = indexed.select("path", "last_modified", "indexed_at")
    joined = files.filter("lang is not null").join(old, "path", "left").join(cutoffs, "lang", "left")
    fresh = (F.col("last_modified") >= F.col("mtime_ms")) & (F.col("indexed_at") >= F.coalesce("cutoff", F.lit(0)))
    return joined.filter(~F.coalesce(fresh, F.lit(False))).select(*files.columns)


def matching_files(paths: DataFrame, wanted: str, relative: Column) -> DataFrame:
    """(path, relative) of the files whose relative path holds the wanted text, in any case of letters."""
    return paths.select("path", relative.alias("relative")).filter(F.contains(F.lower("relative"), F.lit(wanted.lower()))).orderBy("relative")


def complex_functions(functions: DataFrame, least: int = 2) -> DataFrame:
    """Exported functions (path, name, complexity) of at least this complexity, the gravest first in their file."""
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("complexity"), "name"))
    return functions.filter(F.col("complexity") >= least).withColumn("rank", rank)


SESSION = (
    "schemaVersion int, sessionId string, source string, startedAt long, endedAt long, "
    "byTool map<string,struct<calls:long,jsonTokens:long,toonTokens:long,savings:long,truncations:long>>, "
    "totals struct<calls:long,jsonTokens:long,toonTokens:long,savings:long,truncations:long>, llmUsage struct<calls:long,tokensUsed:long>"
)


def save_sessions(sessions: DataFrame, folder: str) -> None:
    """Adds snapshots of sessions below folder; a later write of a session counts in place of earlier ones."""
    sessions.withColumn("_written", F.unix_micros(F.current_timestamp())).write.mode("append").json(folder)


def read_sessions(spark, folder: str, most: int = 50) -> DataFrame:
    """The newest snapshot of every session of schema version 1, the ``most`` newest sessions of each source.

    What is no JSON object with an id is passed over.
    """
    rows = spark.read.schema(SESSION + ", _written long, _corrupt_record string").option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(folder)
    rows = rows.filter("_corrupt_record is null and sessionId is not null and schemaVersion = 1").drop("_corrupt_record")
    newest = F.row_number().over(W.partitionBy("source", "sessionId").orderBy(F.desc("_written")))
    first = F.row_number().over(W.partitionBy("source").orderBy(F.desc("startedAt"), "sessionId"))
    last = rows.withColumn("_k", newest).filter("_k = 1").withColumn("_k", first).filter(F.col("_k") <= most)
    return last.drop("_k", "_written")


def rotate_sessions(spark, folder: str, into: str, most: int = 50) -> DataFrame:
    """Writes what read_sessions keeps into another folder, which then takes the place of the first."""
    kept = read_sessions(spark, folder, most)
    save_sessions(kept, into)
    return kept


def save_reverse_index(file_edges: DataFrame, root: str, folder: str, version: int = 1) -> None:
    """The references by target as JSON lines, beside a manifest with the version and root."""
    spark = file_edges.sparkSession
    spark.createDataFrame([(version, root)], "version int, root string").write.mode("overwrite").json(f"{folder}/manifest")
    by = file_edges.select("target_path", "source_path", *[c for c in file_edges.columns if c not in ("target_path", "source_path")])
    by.repartition("target_path").sortWithinPartitions("target_path").write.mode("overwrite").json(f"{folder}/references")


def load_reverse_index(spark, root: str, folder: str, schema, version: int = 1) -> DataFrame:
    """The references of save_reverse_index; an error if they are of another version or root."""
    said = spark.read.schema("version int, root string").json(f"{folder}/manifest").first()
    if said is None or (said.version, said.root) != (version, root):
        raise ValueError(f"{folder} holds no reverse index of version {version} for {root}")
    return written(spark.read.schema(schema).json(f"{folder}/references"), "references")
