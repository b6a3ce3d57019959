"""One object for a source tree: every tool is a method that returns DataFrames.

    w = Workspace.scan(spark, "/path/to/code")
    w.query_call_graph("/path/to/code/a.ts:main", "callees", 2).show()

Tables are plain DataFrames (files, imports, file_edges, nodes, edges); ``save`` and ``load`` keep them as
Parquet, so an index on a cluster is a folder that all can read.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import identifier_tokens
from .operators import cycles, graphs, relational, reports, symbols, traverse
from .sources import configs, definitions, files, imports, resolve, signatures
from .schema import STUB
from .storage import written

VERSION = 1
TABLES = ("files", "imports", "file_edges", "nodes", "edges")
#: Words of a question that say nothing about code.
STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "have", "not", "how", "does", "what", "where", "why", "when",
    "les", "des", "une", "dans", "pour", "avec", "sur", "par", "qui", "comment", "est", "sont", "fait",
    "src", "dist", "index", "utils", "types", "test", "spec", "impl",
    "function", "class", "method", "interface", "export", "import", "default", "const", "return", "async", "await",
)


@dataclass(frozen=True)
class Workspace:
    root: str
    files: DataFrame
    imports: DataFrame
    file_edges: DataFrame
    nodes: DataFrame
    edges: DataFrame
    options: dict = field(default_factory=dict)

    # Building and keeping -------------------------------------------------------------------------------

    @classmethod
    def scan(cls, spark: SparkSession, root: str, **options) -> Workspace:
        """set_workspace and rebuild_index: reads and indexes all source files below root.

        ``options`` go to module resolution (roots, aliases, go_modules, scoped).  Aliases and Go modules that
        are not given come from the configuration files of the tree.
        """
        texts = configs.read_texts(spark, root)
        options = {"scoped": configs.alias_table(spark, texts), "go_modules": configs.go_modules(texts)} | options
        return cls.of(root, files.source_files(spark, root), **options)

    @classmethod
    def of(cls, root: str, sources: DataFrame, **options) -> Workspace:
        """The index of source files (path, text, lang, mtime_ms, size)."""
        sources = written(sources, "files")
        found = written(imports.imports(sources).join(sources.select("path", "lang"), "path"), "imports")
        nodes, edges = definitions.extract(sources)
        nodes = written(nodes.join(sources.select("path", F.col("mtime_ms").alias("indexed_at")), "path").select(*definitions.NODE_COLUMNS, "indexed_at"), "nodes")
        edges = written(cycles.mark_cycles(written(definitions.resolve_edges(nodes, edges), "edges")), "edges")
        return cls(root.rstrip("/"), sources, found, written(resolve.file_edges(found, sources, **options), "file-edges"), nodes, edges, options)

    def save(self, path: str) -> None:
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.files.sparkSession.createDataFrame([(VERSION, self.root)], "version int, root string").write.mode("overwrite").json(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> Workspace:
        said = spark.read.schema("version int, root string").json(f"{path}/manifest").first()
        if said is None or said.version != VERSION:
            raise ValueError(f"{path} holds no index of version {VERSION}")
        return cls(said.root, *[spark.read.parquet(f"{path}/{name}") for name in TABLES], options)

    def invalidate_files(self, paths: list[str]) -> Workspace:
        """The index without these files."""
        gone = self._paths(*paths)
        nodes, edges = relational.invalidate(self.nodes, self.edges, gone)
        left = self.file_edges.join(gone.toDF("source_path"), "source_path", "left_anti").join(gone.toDF("target_path"), "target_path", "left_anti").select(*self.file_edges.columns)
        rest = lambda t: t.join(gone, "path", "left_anti").select(*t.columns)
        return replace(self, files=rest(self.files), imports=rest(self.imports), file_edges=left, nodes=nodes, edges=edges)

    def refresh(self, current: DataFrame) -> Workspace:
        """The index after a look at the files now (path, text, lang, mtime_ms, size): new and changed ones are read again, gone ones go."""
        changed = written(files.stale(current, self.files), "stale-files")
        gone = written(self.files.select("path").join(current.select("path"), "path", "left_anti").union(changed.select("path")), "replaced-files")
        rest = lambda t: t.join(gone, "path", "left_anti").select(*t.columns)
        kept = rest(self.files).unionByName(changed.select(*self.files.columns))
        found = rest(self.imports).unionByName(imports.imports(changed).join(changed.select("path", "lang"), "path").select(*self.imports.columns))
        fresh, made = definitions.extract(changed)
        fresh = written(fresh.join(changed.select("path", F.col("mtime_ms").alias("indexed_at")), "path").select(*self.nodes.columns), "nodes")
        nodes = written(rest(self.nodes).unionByName(fresh), "nodes")
        lost = graphs.removed(self.nodes, nodes)
        kept_edges = self.edges.drop("is_cyclic").join(self.nodes.join(gone, "path", "left_semi").select(F.col("id").alias("source_id")), "source_id", "left_anti")
        # References to what is gone become stubs of its name again, and may find another definition.
        name = F.concat(F.lit(STUB), F.substring_index("target_id", ":", -1))
        orphaned = kept_edges.join(lost.select(F.col("id").alias("target_id"), F.lit(True).alias("_lost")), "target_id", "left")
        kept_edges = orphaned.withColumn("target_id", F.when(F.col("_lost").isNotNull(), name).otherwise(F.col("target_id"))).drop("_lost")
        edges = written(cycles.mark_cycles(written(definitions.resolve_edges(nodes, kept_edges.unionByName(made.select(*kept_edges.columns))), "edges")), "edges")
        return replace(self, files=written(kept, "files"), imports=written(found, "imports"), file_edges=written(resolve.file_edges(found, kept, **self.options), "file-edges"), nodes=nodes, edges=edges)

    def get_index_status(self, current: DataFrame | None = None) -> DataFrame:
        """Counts of the index, beside its staleness where ``current`` (path, mtime_ms, size) is given."""
        stats = reports.index_stats(self.file_edges)
        return stats if current is None else stats.join(reports.staleness(self.files, current))

    # Files ----------------------------------------------------------------------------------------------

    def _paths(self, *paths: str) -> DataFrame:
        return self.files.sparkSession.createDataFrame([(p,) for p in paths], "path string")

    def _ids(self, *ids: str) -> DataFrame:
        return self.files.sparkSession.createDataFrame([(i,) for i in ids], "id string")

    def _steps(self) -> DataFrame:
        return self.file_edges.select(F.col("source_path").alias("source_id"), F.col("target_path").alias("target_id"))

    def parse_imports(self, path: str) -> DataFrame:
        return self.imports.filter(F.col("path") == path).orderBy("line", "module")

    def analyze_dependencies(self, path: str) -> DataFrame:
        return self.file_edges.filter(F.col("source_path") == path)

    def find_referencing_files(self, path: str) -> DataFrame:
        return self.file_edges.filter(F.col("target_path") == path)

    def resolve_module_path(self, path: str, module: str) -> DataFrame:
        wanted = self.files.filter(F.col("path") == path).select("path", F.lit(module).alias("module"), "lang")
        return resolve.resolve(wanted, self.files, **self.options)

    def verify_dependency_usage(self, source: str | None = None) -> DataFrame:
        """File edges, of one source or all, with whether the import is used."""
        some = self.file_edges if source is None else self.analyze_dependencies(source)
        return symbols.verify_usage(some, self.links(), self.files)

    def crawl_dependency_graph(self, path: str, depth: int = 3) -> tuple[DataFrame, DataFrame]:
        """(id, depth, hub_score, community) of the files reached, and the edges between them with is_cyclic."""
        near = traverse.crawl(self._steps(), self._ids(path), depth)
        between = traverse.induced(self._steps(), near)
        named = near.join(relational.hub_scores(near, between), "id").join(relational.path_communities(near.select(F.col("id").alias("path"))).select(F.col("path").alias("id"), "community"), "id")
        return named, cycles.mark_cycles(between)

    def expand_node(self, path: str, known: DataFrame, depth: int = 10) -> DataFrame:
        """Files reached from path that aren't among ``known`` (id)."""
        return traverse.crawl(self._steps(), self._ids(path), depth).join(known.select("id"), "id", "left_anti")

    def circular_dependencies(self, longest: int = 5) -> DataFrame:
        return cycles.cycle_paths(self._steps(), longest)

    def architecture(self) -> DataFrame:
        return reports.architecture(self.files, self.file_edges, self.root)

    # Symbols --------------------------------------------------------------------------------------------

    def links(self) -> DataFrame:
        return symbols.links_of(self.nodes, self.edges)

    def get_symbol_graph(self, path: str) -> tuple[DataFrame, DataFrame]:
        own = self.nodes.filter(F.col("path") == path).withColumn("category", symbols.category(F.col("type")))
        return own, self.links().filter(F.col("source_file") == path)

    def get_symbol_dependents(self, symbol: str) -> DataFrame:
        return symbols.callers(self.links(), self._ids(symbol))

    def get_symbol_callers(self, symbol: str, mode: str = "all") -> DataFrame:
        return symbols.callers(self.links(), self._ids(symbol), mode)

    def trace_function_execution(self, symbol: str, depth: int = 10) -> traverse.Reached:
        return symbols.trace(self.links(), self._ids(symbol), depth)

    def get_impact_analysis(self, symbol: str, depth: int = 3) -> DataFrame:
        return traverse.impact(traverse.usable(self.edges), self._ids(symbol), depth)

    def _unused(self) -> DataFrame:
        inner = relational.with_ends(self.nodes, self.edges, "path").filter("source_path = target_path").select(*self.edges.columns)
        return relational.unreferenced(self.nodes, self.edges, inner)

    def find_unused_symbols(self, path: str) -> DataFrame:
        return self._unused().filter(F.col("path") == path)

    def scan_dead_code(self) -> DataFrame:
        return relational.dead_code(self.nodes, self._unused())

    def analyze_file_logic(self, path: str) -> tuple[DataFrame, DataFrame]:
        """The calls within a file in order, and its cycles by kind."""
        inner = relational.with_ends(self.nodes, self.edges, "path").filter((F.col("source_path") == path) & (F.col("target_path") == path)).select(*self.edges.columns)
        return relational.call_order(inner), cycles.cycle_types(inner.filter("type_relation = 'CALLS'"))

    def query_call_graph(self, symbol: str, direction: str = "both", depth: int = 2, kinds: list[str] | None = None) -> DataFrame:
        """The relations of a symbol's callers, callees or both, with their depth."""
        ways = {"callees": ["out"], "callers": ["in"], "both": ["out", "in"]}[direction]
        found = [traverse.relations(self.edges, self._ids(symbol), w, depth, kinds).withColumn("direction", F.lit("callees" if w == "out" else "callers")) for w in ways]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def neighbourhood(self, symbol: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        return traverse.neighbourhood(self.nodes, self.edges, symbol, depth)

    def generate_codemap(self, path: str | None = None) -> DataFrame:
        found = reports.codemap(self.nodes, self.edges, self.edges.filter("is_cyclic"))
        return found if path is None else found.filter(F.col("path") == path)

    def query_natural_language(self, question: str, depth: int = 2, most: int = 200, path_like: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(id, depth, score) of symbols that the question's words name and those around, and the edges between.

        ``path_like`` is a SQL LIKE pattern that the files of all of them must meet.
        """
        words = self.files.sparkSession.range(1).select(identifier_tokens(F.lit(question.replace("?", " "))).alias("w")).first().w
        inside = self.nodes if path_like is None else self.nodes.filter(F.col("path").like(path_like))
        seeds = written(relational.keyword_scores(inside, [w for w in dict.fromkeys(words) if w not in STOPWORDS]), "seeds")
        edges = traverse.usable(self.edges)
        edges = edges if path_like is None else traverse.induced(edges, inside)
        near = written(traverse.budgeted(edges, seeds, depth, most), "answers")
        return near.join(seeds, "id", "left").fillna(0, ["score"]), traverse.induced(edges, near)

    def generate_wiki(self, out: str) -> DataFrame:
        found = reports.articles(self.nodes, self.edges)
        reports.write_articles(found, out)
        return found

    # Changes --------------------------------------------------------------------------------------------

    def analyze_breaking_changes(self, older: DataFrame) -> DataFrame:
        """Changed parameters against an older version of files (path, text, lang)."""
        now = self.files.join(older.select("path"), "path", "left_semi")
        return relational.compare_parameters(signatures.signatures(older, "old").unionByName(signatures.signatures(now, "new")))

    def review_pr(self, older: DataFrame) -> DataFrame:
        """The symbols of changed files, given as their older version, by review score; dependents up to three steps away."""
        return reports.review(self.nodes, self.edges, self.analyze_breaking_changes(older), older.select("path"), self._unused(), reports.tested_files(self.files))

    @staticmethod
    def get_session_stats(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Totals by source and by tool."""
        return reports.session_totals(sessions), reports.tool_totals(sessions)
