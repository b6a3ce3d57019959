"""Registered queries of names and paths, views of graphs, incremental updates, resolution and source text, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graphs, relational, traverse
from ..schema import STUB
from ..sources import configs, definitions, imports, resolve, tables
from ..storage import shared_folder, written
from .queries import EDGES, FIRST, NODES, SUPPLIERS, _graph, _suppliers, example, query
from .views import _PER_SESSION, FILE_EDGES, LINKS, SYMBOLS, WITH, _file_edges, _sessions, _symbols

_EXTS = ("ts", "tsx", "mts", "cts", "js", "mjs", "py", "pyi", "rs", "vue", "svelte", "gql", "graphql", "cs", "csproj", "go", "java", "toml", "md", "TS")


def _part(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))


def _pick(*values):
    """One of the values by the part's key, in turn."""
    return F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values])[(F.col("k") % len(values)).cast("int")]


@query(f"""WITH p AS (SELECT '/ws/p' || p_partkey || '.' || {list(_EXTS)}[p_partkey % 20 + 1] AS path, lower({list(_EXTS)}[p_partkey % 20 + 1]) AS e FROM part),
    l AS (SELECT path, e, CASE WHEN e IN ('ts','tsx','mts','cts') THEN 'typescript' WHEN e IN ('js','mjs') THEN 'javascript' WHEN e IN ('py','pyi') THEN 'python' WHEN e = 'rs' THEN 'rust' WHEN e IN ('gql','graphql') THEN 'graphql' WHEN e IN ('cs','csproj') THEN 'csharp' WHEN e IN ('vue','svelte','go','java') THEN e ELSE 'unknown' END AS language FROM p)
    SELECT path, language, CASE WHEN language IN ('vue','svelte') THEN 'typescript' WHEN language NOT IN ('graphql','unknown') THEN language END AS call_graph,
    CASE WHEN e IN ('mts','cts') THEN 'unknown' WHEN language IN ('typescript','javascript','vue','svelte','graphql') THEN 'typescript' WHEN e = 'toml' THEN 'rust' ELSE language END AS parser FROM l""")
def f3_languages(spark, sf_dir):
    path = F.concat(F.lit("/ws/p"), "k", F.lit("."), _pick(*_EXTS))
    return _part(spark, sf_dir).select(path.alias("path")).select("path", T.language(F.col("path")).alias("language"), T.call_graph_language(F.col("path")).alias("call_graph"), T.parser_language(F.col("path")).alias("parser"))


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'C:/ws/x' || p_partkey || '.ts:' || replace(p_name, ' ', '_') WHEN 1 THEN '/ws/x' || p_partkey || '.md:' || replace(p_name, ' ', '_') ELSE '/ws/x' || p_partkey END AS id,
    CASE p_partkey % 3 WHEN 0 THEN 'C:/ws/x' || p_partkey || '.ts' WHEN 1 THEN '/ws/x' || p_partkey || '.md' END AS file_path, CASE WHEN p_partkey % 3 < 2 THEN replace(p_name, ' ', '_') END AS symbol_name,
    CASE p_partkey % 3 WHEN 0 THEN 'C:/ws/x' || p_partkey || '.ts' WHEN 1 THEN '/ws/x' || p_partkey || '.md:' || replace(p_name, ' ', '_') ELSE '/ws/x' || p_partkey END AS file FROM part""")
def f6_symbol_ids(spark, sf_dir):
    ids = _pick(F.concat(F.lit("C:/ws/x"), "k", F.lit(".ts:"), "name"), F.concat(F.lit("/ws/x"), "k", F.lit(".md:"), "name"), F.concat(F.lit("/ws/x"), "k"))
    split = T.split_symbol_id(F.col("id"))
    return _part(spark, sf_dir).select(ids.alias("id")).select("id", split.getField("file_path").alias("file_path"), split.getField("symbol_name").alias("symbol_name"), T.file_of(F.col("id")).alias("file"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '/ws/src/a' || p_partkey || '.ts' WHEN 1 THEN '/ws/b' || p_partkey || '.ts' WHEN 4 THEN '/ws/y' || p_partkey || '.ts' END AS file_path,
    CASE p_partkey % 5 WHEN 0 THEN 'f' WHEN 4 THEN 'C.m' END AS symbol_name FROM part""")
def f7_symbol_refs(spark, sf_dir):
    refs = _pick(F.concat(F.lit("src/a"), "k", F.lit(".ts#f")), F.concat(F.lit("/ws/b"), "k", F.lit(".ts")), "../c.ts#f", "a.ts#", F.concat(F.lit("./x/../y"), "k", F.lit(".ts#C.m")))
    ref = T.symbol_ref(F.col("ref"), "/ws")
    return _part(spark, sf_dir).select("k", refs.alias("ref")).select("k", ref.getField("file_path").alias("file_path"), ref.getField("symbol_name").alias("symbol_name"))


@query(f"WITH {NODES}, n AS (SELECT id, CASE type WHEN 'class' THEN 5 WHEN 'interface' THEN 11 WHEN 'variable' THEN 13 ELSE 12 END AS number FROM nodes) SELECT id, CAST(number AS INTEGER) AS number, CASE number WHEN 12 THEN 'function' WHEN 13 THEN 'variable' ELSE 'class' END AS kind FROM n")
def f19_lsp_kinds(spark, sf_dir):
    numbered = tables.part_nodes(spark, sf_dir).select("id", T.lsp_kind(F.upper("type")).alias("number"))
    return numbered.withColumn("kind", T.kind_of_lsp(F.col("number")))


_AROUND = ("items.map", "onClick", "onHover", "forEach", "p.then", "setTimeout", "Callback", "plain", "every", "useEffect", "errorHandler", "list.sort")
_CALLED = ("map callback", "onClick handler", "onhover handler", "forEach callback", "then callback", "setTimeout callback", "callback function", None, "predicate callback", None, "handler function", "sort comparator")


@query(f"""SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN {[c or '' for c in _CALLED]}[p_partkey % 12 + 1] ELSE '' END AS name FROM part""")
def f20_callback_names(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 == 0, "(Anonymous)").otherwise("named").alias("said"))
    return part.select("k", F.coalesce(T.callback_name(F.col("said"), _pick(*_AROUND)), F.lit("")).alias("name"))


@query(f"WITH {NODES} SELECT DISTINCT path, substr(sha256(path), 1, 12) AS key FROM nodes")
def f26_storage_keys(spark, sf_dir):
    return tables.part_nodes(spark, sf_dir).select("path").distinct().withColumn("key", T.storage_key(F.col("path")))


@query("SELECT p_partkey AS k, p_partkey % 7 IN (0, 4) AS external FROM part")
def p9_external_packages(spark, sf_dir):
    names = _pick(F.concat(F.lit("lodash"), "k"), F.concat(F.lit("./x"), "k"), F.concat(F.lit("a/b"), "k"), F.concat(F.lit("x"), "k", F.lit(".ts")), F.concat(F.lit("node_modules/a/b"), "k"), "", F.concat(F.lit("C:x"), "k"))
    return _part(spark, sf_dir).select("k", T.is_external(names).alias("external"))


@query("""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'src/a' || p_partkey || '.ts' WHEN 1 THEN 'tests/a.ts' WHEN 2 THEN 'src/a.test.ts' WHEN 3 THEN 'lib/x' || p_partkey || '.ts' WHEN 4 THEN 'src/x.d.ts' ELSE 'src' END AS r FROM part)
    SELECT k, (starts_with(r, 'src/') OR r = 'src') AND NOT (ends_with(r, '.test.ts') OR ends_with(r, '.d.ts')) AS usual, NOT (starts_with(r, 'lib/') OR ends_with(r, 'a.test.ts') OR contains(r, 'x.d')) AS chosen FROM p""")
def p10_scope(spark, sf_dir):
    names = _pick(F.concat(F.lit("src/a"), "k", F.lit(".ts")), "tests/a.ts", "src/a.test.ts", F.concat(F.lit("lib/x"), "k", F.lit(".ts")), "src/x.d.ts", "src")
    return _part(spark, sf_dir).select("k", names.alias("r")).select("k", T.in_scope(F.col("r"), "src/").alias("usual"), T.in_scope(F.col("r"), None, ["lib/**", "**/a.test.ts", "x.d"]).alias("chosen"))


@query("""WITH f AS (SELECT o_orderkey AS k, CASE o_custkey % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' END AS lang, o_custkey % 7 <> 0 AS known, o_orderkey % 5 = 0 AS older, o_custkey AS indexed_at FROM orders)
    SELECT CAST(k AS VARCHAR) AS path, lang, k AS mtime_ms FROM f WHERE lang IS NOT NULL AND NOT (known AND NOT older AND indexed_at >= CASE lang WHEN 'typescript' THEN 500 ELSE 0 END)""")
def p14_files_to_index(spark, sf_dir):
    o, path = tables.table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string").alias("path")
    files = o.select(path, F.when(F.col("o_custkey") % 3 == 0, "typescript").when(F.col("o_custkey") % 3 == 1, "python").alias("lang"), F.col("o_orderkey").alias("mtime_ms"))
    indexed = o.filter("o_custkey % 7 != 0").select(path, (F.col("o_orderkey") - (F.col("o_orderkey") % 5 == 0).cast("int")).alias("last_modified"), F.col("o_custkey").alias("indexed_at"))
    return graphs.to_index(files, indexed, spark.createDataFrame([("typescript", 500)], "lang string, cutoff long"))


@query(f"WITH {NODES} SELECT DISTINCT path, path[5:] AS relative FROM nodes WHERE contains(lower(path[5:]), 'b1')")
def p15_search_files(spark, sf_dir):
    return graphs.matching_files(tables.part_nodes(spark, sf_dir).select("path").distinct(), "B1", T.relative_path(F.col("path"), "/ws"))


_KEPT = "SELECT source_file AS source_id, target_file AS target_id FROM fe WHERE source_file IN (FROM kept) AND target_file IN (FROM kept)"


def _file_graph(spark, sf_dir):
    nodes = tables.part_nodes(spark, sf_dir).select(F.col("path").alias("id")).distinct()
    return nodes, written(_file_edges(spark, sf_dir).toDF("source_id", "target_id"), "file-graph")


@query(f"{WITH}, s AS (SELECT min(path) AS p FROM nodes), kept AS (SELECT p AS id FROM s UNION SELECT target_file FROM fe JOIN s ON source_file = p UNION SELECT source_file FROM fe JOIN s ON target_file = p) {_KEPT}")
def p18_around_a_file(spark, sf_dir):
    nodes, edges = _file_graph(spark, sf_dir)
    return traverse.scoped(nodes, edges, nodes.agg(F.min("id")).first()[0])[1]


@query(f"{WITH}, s AS (SELECT min(folder) AS p FROM nodes), kept AS (SELECT DISTINCT path AS id FROM nodes JOIN s ON starts_with(path, p || '/')) {_KEPT}")
def p18_below_a_folder(spark, sf_dir):
    nodes, edges = _file_graph(spark, sf_dir)
    return traverse.scoped(nodes, edges, nodes.agg(F.min(F.regexp_replace("id", r"/[^/]*$", ""))).first()[0])[1]


@query(f"""WITH RECURSIVE {NODES}, {FIRST}, r(root, id, d) AS (SELECT id, id, 0 FROM nodes WHERE is_exported UNION SELECT root, source_id, d + 1 FROM r JOIN edges ON target_id = r.id WHERE d < 3),
    u AS (SELECT root, count(*) AS dependents, max(d) = 3 AS partial FROM (SELECT root, id, min(d) AS d FROM r WHERE d > 0 GROUP BY ALL) GROUP BY root)
    SELECT id, coalesce(dependents, 0) AS dependents, coalesce(partial, false) AS partial FROM nodes LEFT JOIN u ON root = id WHERE is_exported""")
def g16_review_impact(spark, sf_dir):
    nodes, edges = tables.part_nodes(spark, sf_dir), written(tables.first_followers(spark, sf_dir), "edges")
    return traverse.review_impact(edges, nodes.filter("is_exported"))


@query(f"WITH RECURSIVE {SUPPLIERS}, u AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges), r(id) AS (SELECT min(source_id) FROM edges UNION SELECT b FROM r JOIN u ON a = id) SELECT source_id, target_id, type_relation FROM edges WHERE source_id IN (FROM r)")
def g24_connected_edges(spark, sf_dir):
    edges = _suppliers(spark, sf_dir)
    return traverse.connected(edges, edges.agg(F.min("source_id").alias("id")))[1].select("source_id", "target_id", "type_relation")


@query(f"""WITH RECURSIVE {NODES}, {FIRST}, s AS (SELECT min(source_id) AS id FROM edges), o(id) AS (SELECT id FROM s UNION SELECT target_id FROM o JOIN edges ON source_id = o.id JOIN nodes ON nodes.id = target_id AND is_exported)
    SELECT DISTINCT source_id, target_id FROM edges WHERE source_id IN (FROM o) OR target_id IN (FROM s)""")
def g25_visible_edges(spark, sf_dir):
    nodes, edges = tables.part_nodes(spark, sf_dir), written(tables.first_followers(spark, sf_dir), "edges")
    return traverse.visible(edges, edges.agg(F.min("source_id").alias("id")), nodes.filter("is_exported"))[1]


_CLUSTERS = f"""WITH {NODES}, {SYMBOLS}, clusters AS (SELECT path || ':' || name AS id, 'class' AS type, name, path AS namespace, list_concat([id], coalesce((SELECT list(m.id ORDER BY m.id) FROM symbols m WHERE m.parent = c.id), [])) AS symbol_ids, CAST([] AS VARCHAR[]) AS child_ids FROM nodes c WHERE type = 'class'
    UNION ALL SELECT path, 'namespace', split_part(path, '/', -1), path, list_concat(coalesce(list(id ORDER BY id) FILTER (type <> 'class' AND parent IS NULL), []), coalesce(list(id ORDER BY id) FILTER (type = 'class'), [])), coalesce(list(path || ':' || name ORDER BY path || ':' || name) FILTER (type = 'class'), []) FROM symbols GROUP BY path)"""


@query(_CLUSTERS + " SELECT * FROM clusters")
def a18_clusters(spark, sf_dir):
    return graphs.clusters(_symbols(spark, sf_dir))


@query(f"WITH {NODES}, {SYMBOLS} SELECT s.id FROM symbols s LEFT JOIN nodes c ON s.parent = c.id WHERE s.path LIKE '%1.src' AND (s.parent IS NULL OR c.path || ':' || c.name IN (SELECT path || ':' || name FROM nodes WHERE type = 'class' AND name < 'l'))")
def g32_visible_symbols(spark, sf_dir):
    found = written(graphs.clusters(_symbols(spark, sf_dir)), "clusters")
    return graphs.visible_symbols(found, found.filter("(type = 'namespace' and id like '%1.src') or (type = 'class' and name < 'l')"))


@query(f"WITH {NODES}, {EDGES}, d AS (SELECT id, count(target_id) AS n FROM nodes LEFT JOIN edges ON target_id = id WHERE is_exported GROUP BY id) SELECT id, CAST(round(100 * round(n / greatest((SELECT max(n) FROM d), 1), 9)) AS INTEGER) AS score FROM d")
def a5_hub_percent(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graphs.hub_percent(nodes, edges, nodes.filter("is_exported"))


@query(f"WITH {NODES}, {EDGES}, a AS (SELECT target_id FROM edges UNION ALL SELECT '{STUB}' || name FROM nodes WHERE NOT is_exported) SELECT (SELECT count(DISTINCT path) FROM nodes) AS files, (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, count(*) FILTER (starts_with(target_id, '{STUB}')) AS stubs FROM a")
def a15_counts(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    stubs = nodes.filter("not is_exported").select(F.col("id").alias("source_id"), F.concat(F.lit(STUB), "name").alias("target_id"))
    return graphs.counts(nodes, edges.select("source_id", "target_id").unionByName(stubs), STUB)


@query(f"WITH {NODES}, p AS (SELECT DISTINCT path FROM nodes UNION SELECT DISTINCT replace(path, '/b', '-b') FROM nodes), n AS (SELECT path, regexp_replace(path, '[^A-Za-z0-9]', '_', 'g') AS base, row_number() OVER (PARTITION BY regexp_replace(path, '[^A-Za-z0-9]', '_', 'g') ORDER BY path) - 1 AS k FROM p) SELECT path, CASE WHEN k > 0 THEN base || '_' || k ELSE base END AS node_id FROM n")
def w3_diagram_ids(spark, sf_dir):
    paths = tables.part_nodes(spark, sf_dir).select("path")
    return graphs.diagram_ids(paths.union(paths.select(F.replace("path", F.lit("/b"), F.lit("-b")))))


@query(f"WITH {NODES}, d AS (SELECT path, string_split(path, '/')[3] AS domain FROM nodes), k AS (SELECT domain, row_number() OVER (ORDER BY min(path)) AS community FROM d GROUP BY domain) SELECT CAST(community AS INTEGER) AS community, min(path) AS id FROM d JOIN k USING (domain) GROUP BY community")
def w6_representatives(spark, sf_dir):
    found = relational.path_communities(tables.part_nodes(spark, sf_dir).select("path").distinct())
    return graphs.representatives(found.select(F.col("path").alias("id"), "community"))


@query(f"WITH {NODES}, {EDGES}, p AS (SELECT path, count(DISTINCT source_id) AS callers FROM edges JOIN nodes ON target_id = id GROUP BY path) SELECT path, callers, CAST(round(100 * callers / (SELECT max(callers) FROM p)) AS INTEGER) AS score FROM p ORDER BY score DESC, path LIMIT 10")
def o2_top_hubs(spark, sf_dir):
    return graphs.top_hubs(*_graph(spark, sf_dir))


@query(f"{WITH}, a AS (SELECT source_file AS path, 1 AS line, target_file AS module, 0 AS k FROM fe WHERE source_file LIKE '%1.src' UNION ALL SELECT target_file, 2, source_file, 1 FROM fe) SELECT path, CAST(line AS INTEGER) AS line, module FROM a QUALIFY row_number() OVER (PARTITION BY path ORDER BY k, line, module) = 1")
def u3_merge_references(spark, sf_dir):
    edges = written(_file_edges(spark, sf_dir), "file-edges")
    indexed = edges.filter("source_path like '%1.src'").select(F.col("source_path").alias("path"), F.lit(1).alias("line"), F.col("target_path").alias("module"))
    return graphs.merge_references(indexed, edges.select(F.col("target_path").alias("path"), F.lit(2).alias("line"), F.col("source_path").alias("module")))


@query(f"{WITH}, s AS (SELECT min(target_file) AS p FROM fe), r AS (SELECT source_file FROM fe JOIN s ON target_file = p) SELECT source_file AS source_path, target_file AS target_path FROM fe WHERE source_file IN (FROM r)")
def u4_referring_only(spark, sf_dir):
    edges = written(_file_edges(spark, sf_dir), "file-edges")
    first = edges.agg(F.min("target_path").alias("target_path"))
    return graphs.referring_only(edges, edges.join(first, "target_path", "left_semi").select(F.col("source_path").alias("path")))


@query(f"WITH {NODES} SELECT id FROM nodes WHERE is_exported AND start_line >= 2500")
def u6_removed_ids(spark, sf_dir):
    nodes = tables.part_nodes(spark, sf_dir)
    return graphs.removed(nodes.filter("is_exported"), nodes.filter("start_line < 2500"))


@query(f"""WITH RECURSIVE {SUPPLIERS}, e AS (SELECT * FROM edges WHERE type_relation <> 'USES'), r(a, b) AS (SELECT source_id, target_id FROM e UNION SELECT r.a, e.target_id FROM r JOIN e ON r.b = e.source_id), k AS (SELECT source_id FROM edges WHERE type_relation = 'CALLS')
    SELECT source_id, target_id, type_relation, CASE WHEN source_id IN (FROM k) THEN type_relation <> 'USES' AND EXISTS (SELECT 1 FROM r WHERE r.a = edges.target_id AND r.b = edges.source_id) ELSE source_line > 3 END AS is_cyclic FROM edges""")
def g30_mark_some(spark, sf_dir):
    edges = _suppliers(spark, sf_dir).withColumn("is_cyclic", F.col("source_line") > 3)
    return graphs.mark_some(edges, edges.filter("type_relation = 'CALLS'").select(F.col("source_id").alias("id"))).select("source_id", "target_id", "type_relation", "is_cyclic")


@query(f"{WITH} SELECT source_file AS source_path, target_file AS target_path FROM fe WHERE source_file NOT LIKE '%1.src' UNION SELECT source_file, '/ws/new.src' FROM fe WHERE source_file LIKE '%1.src'")
def g31_replace_dependencies(spark, sf_dir):
    edges = written(_file_edges(spark, sf_dir), "file-edges")
    changed = edges.filter("source_path like '%1.src'")
    return graphs.replace_dependencies(edges, changed.select(F.col("source_path").alias("path")), changed.withColumn("target_path", F.lit("/ws/new.src")))


@query(f"{WITH} SELECT source_file AS source_path, target_file AS target_path FROM fe")
def k2_reverse_index(spark, sf_dir):
    edges, folder = _file_edges(spark, sf_dir), shared_folder(spark, "reverse-index")
    graphs.save_reverse_index(edges, "/ws", folder)
    return graphs.load_reverse_index(spark, "/ws", folder, edges.schema)


@query(f"WITH {_PER_SESSION} SELECT source, 's-' || user_id || '-' || source AS \"sessionId\", CAST(n AS BIGINT) AS calls FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY began DESC, 's-' || user_id || '-' || source) <= 50")
def k9_session_files(spark, sf_dir):
    """Sessions written twice, the later snapshot in place of the first, beside a broken file; the newest 50 of each source."""
    sessions, folder = _sessions(spark, sf_dir), shared_folder(spark, "sessions")
    graphs.save_sessions(sessions.withColumn("totals", sessions["totals"].withField("calls", F.lit(0).cast("long"))), folder)
    graphs.save_sessions(sessions, folder)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(folder)
    return graphs.read_sessions(spark, folder).select("source", "sessionId", F.col("totals.calls").alias("calls"))


# Written sources and trees, as the tables hold none; the SQL of these is the list of rows that they must give.

_CODE = {
    "/ws/a.ts": "export function plain() {\n  return 1;\n}\nexport function forked(x?: number) {\n  if (x) {\n    return x ?? 0;\n  } else if (x === 2) {\n    return 3; // if else for\n  }\n  for (const i of []) {}\n  return x?.y ? 'case 1:' : 2;\n}\nfunction hidden(a) {\n  if (a) { while (a) {} }\n}\n",
    "/ws/b.ts": "export const chosen = (k) => {\n  switch (k) {\n    case 1: break;\n    case 2: break;\n    default: break;\n  }\n  try { k(); } catch (e) {} finally {}\n  do { k--; } while (k);\n};\nexport function once(k) {\n  if (k) return 1;\n}\n",
    "/ws/C.vue": "<template><p v-if=\"x\">a</p></template>\n<script setup lang=\"ts\">\nexport function inside(q) {\n  if (q) { q(); } else { q(1); }\n}\n</script>\n",
}
_CODE_LANGS = {"ts": "typescript", "vue": "vue", "py": "python", "gql": "graphql", "java": "java", "rs": "rust", "go": "go"}


def _literal(spark, texts):
    return spark.createDataFrame([(p, t, _CODE_LANGS[p.rsplit(".", 1)[1]]) for p, t in texts.items()], "path string, text string, lang string")


@example("SELECT path, name, CAST(complexity AS INTEGER) AS complexity, CAST(rank AS INTEGER) AS rank FROM (VALUES ('/ws/a.ts', 'forked', 5, 1), ('/ws/b.ts', 'chosen', 6, 1), ('/ws/C.vue', 'inside', 2, 1)) AS t(path, name, complexity, rank)")
def o10_complex_functions(spark, sf_dir):
    return graphs.complex_functions(definitions.function_complexity(_literal(spark, _CODE)))


_IMPORTING = {
    "/ws/a.ts": "import x, { y } from './x';\nimport type { T } from './t';\nexport * from \"./z\";\nconst r = require('r');\nconst d = () => import('./d');\n",
    "/ws/b.vue": "<script>\nimport v from './v';\n</script>\n",
    "/ws/c.py": "import os, sys as s\nfrom . import q\nfrom ..pkg import m\n",
    "/ws/d.rs": "use crate::net::tcp;\nmod io;\n",
    "/ws/e.go": "package e\nimport (\n\t\"fmt\"\n\tf \"ex.com/g/pkg\"\n)\n",
    "/ws/F.java": "import java.util.List;\nimport static com.x.Y;\n",
    "/ws/g.gql": "#import \"./frag.gql\"\n",
}


@example("""SELECT path, module, type, CAST(line AS INTEGER) AS line FROM (VALUES ('/ws/a.ts', './x', 'import', 1), ('/ws/a.ts', './z', 'export', 3), ('/ws/a.ts', 'r', 'require', 4), ('/ws/a.ts', './d', 'dynamic', 5), ('/ws/b.vue', './v', 'import', 2),
    ('/ws/c.py', 'os', 'import', 1), ('/ws/c.py', 'sys', 'import', 1), ('/ws/c.py', '.', 'import', 2), ('/ws/c.py', '..pkg', 'import', 3), ('/ws/d.rs', 'crate::net::tcp', 'import', 1), ('/ws/d.rs', 'io', 'module', 2),
    ('/ws/e.go', 'fmt', 'import', 3), ('/ws/e.go', 'ex.com/g/pkg', 'import', 4), ('/ws/F.java', 'java.util.List', 'import', 1), ('/ws/F.java', 'com.x.Y', 'import', 2), ('/ws/g.gql', './frag.gql', 'import', 1)) AS t(path, module, type, line)""")
def f13_imports(spark, sf_dir):
    return imports.imports(_literal(spark, _IMPORTING)).select("path", "module", "type", "line")


_TREE = ("/w/a.ts", "/w/lib/b.ts", "/w/lib/index.ts", "/w/esm.ts", "/w/p/m.py", "/w/p/__init__.py", "/w/q.py", "/w/src/main.rs", "/w/src/net.rs", "/w/src/net/tcp.rs", "/g/pkg/a.go", "/g/pkg/a_test.go", "/j/com/x/Y.java", "/j/other/com/x/Y.java", "/j/odd/Svc.java", "/c/App/Core.cs")
_WANTED = [
    ("/w/a.ts", "./lib/b", "typescript", "/w/lib/b.ts"), ("/w/a.ts", "./lib", "typescript", "/w/lib/index.ts"), ("/w/a.ts", "./esm.js", "typescript", "/w/esm.ts"), ("/w/a.ts", "react", "typescript", None),
    ("/w/p/m.py", "..q", "python", "/w/q.py"), ("/w/q.py", "p", "python", "/w/p/__init__.py"), ("/w/src/main.rs", "net", "rust", "/w/src/net.rs"), ("/w/src/net.rs", "crate::net::tcp::Conn", "rust", "/w/src/net/tcp.rs"), ("/w/src/main.rs", "std::io", "rust", None),
    ("/g/m.go", "ex.com/g/pkg", "go", "/g/pkg/a.go"), ("/j/Z.java", "com.x.Y", "java", "/j/com/x/Y.java"), ("/j/Z.java", "com.acme.Svc", "java", "/j/odd/Svc.java"), ("/j/Z.java", "java.util.List", "java", None), ("/c/P.cs", "App.Core", "csharp", "/c/App/Core.cs"),
]


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


@example(f"SELECT * FROM (VALUES {_values((p, m, t) for p, m, _, t in _WANTED if t)}) AS t(path, module, target_path)")
def x13_resolve_by_language(spark, sf_dir):
    wanted = spark.createDataFrame([w[:3] for w in _WANTED], "path string, module string, lang string")
    return resolve.resolve(wanted, spark.createDataFrame([(p,) for p in _TREE], "path string"), roots=("/w", "/w/src"), go_modules=configs.go_modules({"/g/go.mod": "module ex.com/g\n\ngo 1.22\n"}))


_CONFIGS = {
    "/m/tsconfig.base.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@base/*": ["base/*"], "@over/*": ["old/*"]}}}',
    "/m/tsconfig.json": '{"extends": "./tsconfig.base", "compilerOptions": {"paths": {"@over/*": ["./new/*"], "@one": ["./src/one.ts"]}}}',
    "/m/package.json": '{"name": "root", "workspaces": ["packages/*"], "dependencies": {"near": "file:./near"}}',
    "/m/packages/core/package.json": '{"name": "@m/core", "imports": {"#in/*": "./src/in/*", "#cfg": {"default": "./src/cfg.ts"}}}',
    "/m/packages/ui/package.json": '{"name": "@m/ui"}',
    "/m/packages/bad/package.json": "{",
}
_ALIASED = ("/m/src/base/x.ts", "/m/src/old/y.ts", "/m/new/y.ts", "/m/src/one.ts", "/m/near/index.ts", "/m/packages/core/src/index.ts", "/m/packages/core/src/in/z.ts", "/m/packages/core/src/cfg.ts", "/m/packages/core/lib/k.ts", "/m/packages/ui/index.tsx")
_BY_ALIAS = [
    ("/m/a.ts", "@base/x", "/m/src/base/x.ts"), ("/m/a.ts", "@over/y", "/m/new/y.ts"), ("/m/a.ts", "@one", "/m/src/one.ts"), ("/m/a.ts", "near", "/m/near/index.ts"), ("/m/a.ts", "@m/core", "/m/packages/core/src/index.ts"),
    ("/m/packages/ui/u.ts", "@m/core/lib/k", "/m/packages/core/lib/k.ts"), ("/m/packages/core/c.ts", "#in/z", "/m/packages/core/src/in/z.ts"), ("/m/packages/core/c.ts", "#cfg", "/m/packages/core/src/cfg.ts"), ("/m/a.ts", "#cfg", None),
    ("/m/packages/core/c.ts", "@m/ui", "/m/packages/ui/index.tsx"), ("/elsewhere/a.ts", "@one", None), ("/m/a.ts", "@base", None), ("/m/a.ts", "@basement/x", None),
]


@example(f"SELECT * FROM (VALUES {_values(r for r in _BY_ALIAS if r[2])}) AS t(path, module, target_path)")
def x14_config_aliases(spark, sf_dir):
    wanted = spark.createDataFrame([(p, m, "typescript") for p, m, _ in _BY_ALIAS], "path string, module string, lang string")
    return resolve.resolve(wanted, spark.createDataFrame([(p,) for p in _ALIASED], "path string"), scoped=configs.alias_table(spark, _CONFIGS))


@query("""WITH o AS (SELECT 'f' || p_partkey AS file_path, 'n' AS name, ['function', 'member', 'alias'][p_partkey % 3 + 1] AS kind, p_brand AS a, CASE WHEN p_size % 4 = 0 THEN p_type ELSE p_brand END AS b, ['public', 'protected', 'private'][p_size % 3 + 1] AS va, ['public', 'protected', 'private'][p_size % 2 + 1] AS vb, p_size % 2 = 0 AS oa, p_size > 25 AS ob, p_partkey % 3 = 1 AND p_size % 5 = 0 AS gone FROM part)
    SELECT file_path, name, CASE WHEN kind = 'member' THEN 'm' ELSE '' END AS subject, kind || CASE kind WHEN 'member' THEN '-type-changed' END AS change, true AS breaking FROM o WHERE kind = 'member' AND NOT gone AND a <> b
    UNION ALL SELECT file_path, name, '', CASE kind WHEN 'function' THEN 'return-type-changed' ELSE 'type-alias-changed' END, true FROM o WHERE kind <> 'member' AND a <> b
    UNION ALL SELECT file_path, name, CASE WHEN kind = 'member' THEN 'm' ELSE '' END, 'visibility-reduced', true FROM o WHERE NOT gone AND list_position(['private', 'protected', 'public'], vb) < list_position(['private', 'protected', 'public'], va)
    UNION ALL SELECT file_path, name, 'm', 'member-removed', true FROM o WHERE gone UNION ALL SELECT file_path, name, 'm', 'member-optional-to-required', true FROM o WHERE kind = 'member' AND NOT gone AND oa AND NOT ob""")
def x15_declaration_changes(spark, sf_dir):
    """Every part declares a function, a member or an alias; another version has other types, visibility and members."""
    p, size = tables.table(spark, sf_dir, "part"), F.col("p_size")
    kind = F.array(*map(F.lit, ("function", "member", "alias")))[(F.col("p_partkey") % 3).cast("int")].alias("kind")
    shown = F.array(*map(F.lit, ("public", "protected", "private")))
    row = lambda version, type_, visibility, optional: (F.concat(F.lit("f"), "p_partkey").alias("file_path"), F.lit(version).alias("version"), F.lit("n").alias("name"), kind, F.when(F.col("p_partkey") % 3 == 1, "m").alias("member"), type_.alias("type"), visibility.alias("visibility"), optional.alias("is_optional"))
    old = p.select(*row("old", F.col("p_brand"), shown[size % 3], size % 2 == 0))
    new = p.filter(~((F.col("p_partkey") % 3 == 1) & (size % 5 == 0))).select(*row("new", F.when(size % 4 == 0, F.col("p_type")).otherwise(F.col("p_brand")), shown[size % 2], size > 25))
    # The owner of a removed member is still there, with another member.
    kept = p.filter((F.col("p_partkey") % 3 == 1) & (size % 5 == 0)).select(*row("new", F.lit("t"), F.lit("public"), F.lit(True))).withColumn("member", F.lit("other"))
    return relational.compare_declarations(old.unionByName(new).unionByName(kept))
