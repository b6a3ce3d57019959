"""Who uses which symbol: callers, dependents, usage checks and the views of one file's symbols.

``symbols`` has id, name, kind, line, is_exported, parent_symbol_id, file_path; ``links`` has
source_symbol_id, target_symbol_id, source_file, target_file, is_type_only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import if_small
from . import traverse

#: Kinds that exist for the type checker alone.
TYPE_KINDS = ("interface", "type", "type_parameter")
#: Languages whose symbols are extracted, so that a usage can be disproved.
PARSED = ("typescript", "javascript", "python", "rust")


def links_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The links of a call graph; USES edges count as type-only."""
    path = nodes.select("id", "path")
    source, target = path.toDF("source_id", "source_file"), path.toDF("target_id", "target_file")
    both = edges.join(source, "source_id").join(target, "target_id")
    return both.select(F.col("source_id").alias("source_symbol_id"), F.col("target_id").alias("target_symbol_id"), "source_file", "target_file", (F.col("type_relation") == "USES").alias("is_type_only"))


def of_kind(links: DataFrame, mode: str = "all") -> DataFrame:
    """Links that matter at run time, those for types only, or all."""
    return {"all": links, "runtime": links.filter(~F.col("is_type_only")), "type": links.filter("is_type_only")}[mode]


def runtime_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.filter(~F.col("kind").isin(*TYPE_KINDS))


def callers(links: DataFrame, targets: DataFrame, mode: str = "all") -> DataFrame:
    """The links into targets (id), each pair of symbols once; a link that is used at run time is not type-only."""
    into = of_kind(links, mode).join(if_small(targets.select(F.col("id").alias("target_symbol_id")).distinct()), "target_symbol_id", "left_semi")
    return into.groupBy("target_symbol_id", "source_symbol_id", "source_file").agg(F.min("is_type_only").alias("is_type_only"))


def caller_counts(links: DataFrame) -> DataFrame:
    """Different callers and calling files of every symbol, and those at run time."""
    run = ~F.col("is_type_only")
    return links.groupBy(F.col("target_symbol_id").alias("id")).agg(
        F.countDistinct("source_symbol_id").alias("callers"), F.countDistinct("source_file").alias("files"), F.countDistinct(F.when(run, F.col("source_symbol_id"))).alias("runtime_callers")
    )


def trace(links: DataFrame, root: DataFrame, depth: int = 10) -> traverse.Reached:
    """What runs when root (id) runs, with depths; ``partial`` says that the depth limit was reached."""
    return traverse.reach(links.select(F.col("source_symbol_id").alias("source_id"), F.col("target_symbol_id").alias("target_id")), root, depth)


def dependents(links: DataFrame, root: DataFrame, depth: int = 3) -> traverse.Reached:
    """What may break when root (id) changes, with depths."""
    return traverse.reach(links.select(F.col("source_symbol_id").alias("source_id"), F.col("target_symbol_id").alias("target_id")), root, depth, "in")


def verify_usage(file_edges: DataFrame, links: DataFrame, langs: DataFrame) -> DataFrame:
    """file_edges with ``used``: whether the source uses any symbol of the target.

    Files (path, lang) of a language whose symbols are not extracted count as using what they import.
    """
    known = langs.filter(F.col("lang").isin(*PARSED)).select(F.col("path").alias("source_path"), F.lit(True).alias("_parsed")).distinct()
    pairs = links.select(F.col("source_file").alias("source_path"), F.col("target_file").alias("target_path"), F.lit(True).alias("_used")).distinct()
    joined = file_edges.join(pairs, ["source_path", "target_path"], "left").join(known, "source_path", "left")
    return joined.select(*file_edges.columns, (F.col("_used").isNotNull() | F.col("_parsed").isNull()).alias("used"))


def neighbours(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(id, depends_on, used_by): sorted ids within the file of every symbol, classes first and then by name.

    The sets hold links of one file alone, whose size the 5 MB limit of a file bounds.
    """
    inner = links.filter("source_file = target_file and source_symbol_id != target_symbol_id")
    on = inner.groupBy(F.col("source_symbol_id").alias("id")).agg(F.sort_array(F.collect_set("target_symbol_id")).alias("depends_on"))
    by = inner.groupBy(F.col("target_symbol_id").alias("id")).agg(F.sort_array(F.collect_set("source_symbol_id")).alias("used_by"))
    none = F.array().cast("array<string>")
    return symbols.select("id").join(on, "id", "left").join(by, "id", "left").select("id", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("used_by", none).alias("used_by"))


def external_by_file(links: DataFrame, with_types: bool = False) -> DataFrame:
    """(id, target_file, symbols): for every symbol, what it uses of each other file."""
    kept = links if with_types else of_kind(links, "runtime")
    return kept.filter("source_file != target_file").groupBy(F.col("source_symbol_id").alias("id"), "target_file").agg(F.sort_array(F.collect_set("target_symbol_id")).alias("symbols"))


def incoming(links: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id, origin): links from other files, and call edges into exported top-level symbols that have none."""
    outer = links.filter("source_file != target_file").select(F.col("source_symbol_id").alias("source_id"), F.col("target_symbol_id").alias("target_id")).distinct()
    top = symbols.filter("is_exported and parent_symbol_id is null").select(F.col("id").alias("target_id"), F.col("file_path").alias("_into"))
    source = symbols.select(F.col("id").alias("source_id"), F.col("file_path").alias("_from"))
    calls = edges.filter("type_relation = 'CALLS'").join(top, "target_id").join(source, "source_id").filter("_from != _into").select("source_id", "target_id").distinct()
    more = calls.join(outer, ["source_id", "target_id"], "left_anti")
    return outer.withColumn("origin", F.lit("symbols")).unionByName(more.withColumn("origin", F.lit("calls")))


def file_view(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(source, target, relation_type) for the symbol view of every file.

    A file contains its top-level symbols, a symbol its members, and symbols depend on others.
    """
    top = symbols.filter("parent_symbol_id is null").select(F.col("file_path").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation_type"))
    member = symbols.filter("parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("source"), F.col("id").alias("target"), F.lit("member").alias("relation_type"))
    uses = links.select(F.col("source_symbol_id").alias("source"), F.col("target_symbol_id").alias("target"), F.lit("depends").alias("relation_type"))
    return top.unionByName(member).unionByName(uses).distinct()


def category(kind: Column) -> Column:
    """The group that a syntax kind belongs to."""
    #: Group and its syntax kinds.
    groups = (
        ("function", ("FunctionDeclaration", "ArrowFunction", "MethodDeclaration", "GetAccessor", "SetAccessor", "function", "method")),
        ("class", ("ClassDeclaration", "class")),
        ("interface", ("InterfaceDeclaration", "interface")),
        ("type", ("TypeAliasDeclaration", "type")),
        ("variable", ("VariableDeclaration", "PropertyDeclaration", "EnumDeclaration", "variable")),
    )
    out = F
    for name, kinds in groups:
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("other")


def lookup(nodes: DataFrame, path: str, name: str) -> DataFrame:
    """The first definition of a name in a file."""
    return nodes.filter((F.col("path") == path) & (F.col("name") == name)).orderBy("start_line", "id").limit(1)


def member_tree(symbols: DataFrame) -> DataFrame:
    """(parent, id, place): every file's symbols and every symbol's members, classes first and then by name."""
    parent = F.coalesce("parent_symbol_id", "file_path").alias("parent")
    order = W.partitionBy("parent").orderBy((F.col("kind") != "class").cast("int"), "name", "id")
    return symbols.select(parent, "id", "kind", "name").withColumn("place", F.row_number().over(order)).select("parent", "id", "place")
