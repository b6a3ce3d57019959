"""Registered queries of symbol usage, workspace reports and compact text, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compact
from ..operators import cycles, relational, reports, symbols
from ..sources import definitions, resolve, tables
from ..storage import written
from .queries import EDGES, FIRST, NODES, SUPPLIERS, _graph, example, query

LINKS = """links AS (SELECT source_id, target_id, s.path AS source_file, t.path AS target_file, type_relation = 'USES' AS is_type_only FROM edges JOIN nodes s ON source_id = s.id JOIN nodes t ON target_id = t.id)"""
FILE_EDGES = "fe AS (SELECT DISTINCT source_file, target_file FROM links WHERE source_file <> target_file)"
#: A symbol's parent: methods belong to the first class of their file.
SYMBOLS = """symbols AS (SELECT n.*, CASE WHEN type = 'method' THEN c.id END AS parent FROM nodes n LEFT JOIN (SELECT path, min(id) AS id FROM nodes WHERE type = 'class' GROUP BY path) c USING (path))"""
WITH = f"WITH {NODES}, {EDGES}, {LINKS}, {FILE_EDGES}, {SYMBOLS}"


def _links(spark, sf_dir):
    return symbols.links_of(*_graph(spark, sf_dir))


def _file_edges(spark, sf_dir):
    return _links(spark, sf_dir).filter("source_file != target_file").select(F.col("source_file").alias("source_path"), F.col("target_file").alias("target_path")).distinct()


def _symbols(spark, sf_dir):
    nodes = tables.part_nodes(spark, sf_dir)
    classes = nodes.filter("type = 'class'").groupBy("path").agg(F.min("id").alias("_class"))
    parent = F.when(F.col("type") == "method", F.col("_class"))
    return nodes.join(classes, "path", "left").select("id", "name", F.col("type").alias("kind"), F.col("start_line").alias("line"), "is_exported", parent.alias("parent_symbol_id"), F.col("path").alias("file_path"))


@query(f"{WITH} SELECT target_id AS id, count(DISTINCT source_id) AS callers, count(DISTINCT source_file) AS files, count(DISTINCT source_id) FILTER (NOT is_type_only) AS runtime_callers FROM links GROUP BY target_id")
def g18_caller_counts(spark, sf_dir):
    return symbols.caller_counts(_links(spark, sf_dir))


@query(f"{WITH} SELECT target_id AS target_symbol_id, source_id AS source_symbol_id, source_file, bool_and(is_type_only) AS is_type_only FROM links JOIN nodes ON target_id = id WHERE is_exported GROUP BY 1, 2, 3")
def g14_dependents(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return symbols.callers(symbols.links_of(nodes, edges), nodes.filter("is_exported"))


@query(f"{WITH} SELECT DISTINCT target_id AS target_symbol_id, source_id AS source_symbol_id, source_file, is_type_only FROM links JOIN nodes ON target_id = id WHERE is_exported AND NOT is_type_only")
def p5_runtime_callers(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return symbols.callers(symbols.links_of(nodes, edges), nodes.filter("is_exported"), "runtime")


@query(f"{WITH.replace('WITH ', 'WITH RECURSIVE ', 1)}, r(id, d) AS (SELECT min(source_id), 0 FROM links UNION SELECT target_id, d + 1 FROM r JOIN links ON source_id = id WHERE d < 4) SELECT id, CAST(min(d) AS INTEGER) AS depth FROM r GROUP BY id")
def g17_trace(spark, sf_dir):
    links = written(_links(spark, sf_dir), "links")
    return symbols.trace(links, links.agg(F.min("source_symbol_id").alias("id")), 4).nodes


@query(f"{WITH}, i AS (SELECT source_file AS source_path, target_file AS target_path FROM fe UNION SELECT target_file, source_file FROM fe), known AS (SELECT DISTINCT path FROM nodes WHERE lang = 'rust') SELECT i.*, EXISTS (SELECT 1 FROM fe WHERE source_file = source_path AND target_file = target_path) OR source_path NOT IN (SELECT path FROM known) AS used FROM i")
def j13_verify_usage(spark, sf_dir):
    links, nodes = _links(spark, sf_dir), tables.part_nodes(spark, sf_dir)
    edges = _file_edges(spark, sf_dir)
    return symbols.verify_usage(edges.union(edges.select("target_path", "source_path")).distinct(), links, nodes.filter("lang = 'rust'").select("path", "lang"))


@query(f"{WITH}, a AS (SELECT DISTINCT source_id, target_id FROM links WHERE split_part(source_file, '/', 3) = split_part(target_file, '/', 3) AND source_id <> target_id) SELECT id, coalesce((SELECT list(target_id ORDER BY target_id) FROM a WHERE source_id = id), []) AS depends_on, coalesce((SELECT list(source_id ORDER BY source_id) FROM a WHERE target_id = id), []) AS used_by FROM nodes")
def g38_neighbours(spark, sf_dir):
    # Folders stand for files, as parts of one file seldom follow each other.
    folder = lambda c: F.split(c, "/")[2]
    links = _links(spark, sf_dir).withColumns({"source_file": folder("source_file"), "target_file": folder("target_file")})
    return symbols.neighbours(_symbols(spark, sf_dir), links)


@query(f"{WITH} SELECT source_id AS id, target_file, list(DISTINCT target_id ORDER BY target_id) AS symbols FROM links WHERE source_file <> target_file AND NOT is_type_only GROUP BY 1, 2")
def g39_external_by_file(spark, sf_dir):
    return symbols.external_by_file(_links(spark, sf_dir))


@query(f"""{WITH}, o AS (SELECT DISTINCT source_id, target_id FROM links WHERE source_file <> target_file AND is_type_only),
    c AS (SELECT DISTINCT l.source_id, l.target_id FROM edges l JOIN symbols s ON l.source_id = s.id JOIN symbols t ON l.target_id = t.id WHERE type_relation = 'CALLS' AND t.is_exported AND t.parent IS NULL AND s.path <> t.path)
    SELECT *, 'symbols' AS origin FROM o UNION ALL SELECT *, 'calls' FROM (SELECT * FROM c EXCEPT SELECT * FROM o)""")
def g37_incoming(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return symbols.incoming(symbols.of_kind(symbols.links_of(nodes, edges), "type"), _symbols(spark, sf_dir), edges)


@query(f"{WITH} SELECT path AS source, id AS target, 'contains' AS relation_type FROM symbols WHERE parent IS NULL UNION SELECT parent, id, 'member' FROM symbols WHERE parent IS NOT NULL UNION SELECT source_id, target_id, 'depends' FROM links")
def g36_file_view(spark, sf_dir):
    return symbols.file_view(_symbols(spark, sf_dir), _links(spark, sf_dir))


@query(f"{WITH} SELECT path, path[5:] AS relative, 'src' AS extension, (SELECT count(*) FROM fe WHERE source_file = path) AS dependencies, (SELECT count(*) FROM fe WHERE target_file = path) AS dependents FROM (SELECT DISTINCT path FROM nodes)")
def a6_architecture(spark, sf_dir):
    edges = _file_edges(spark, sf_dir)
    outer = edges.limit(5).withColumn("target_path", F.lit("/elsewhere/x.ts"))
    return reports.architecture(tables.part_nodes(spark, sf_dir), edges.unionByName(edges).unionByName(outer), "/ws")


@query(f'{WITH} SELECT count(DISTINCT source_file) AS indexed_files, count(DISTINCT target_file) AS targets, count(*) AS "references" FROM fe')
def a7_index_stats(spark, sf_dir):
    return reports.index_stats(_file_edges(spark, sf_dir))


@query("""WITH k AS (SELECT o_custkey % 7 = 0 AS missing, o_orderkey % 5 = 0 AS changed FROM orders), c AS (SELECT count(*) AS files, count(*) FILTER (missing) AS missing, count(*) FILTER (NOT missing AND changed) AS stale FROM k)
    SELECT *, (missing + stale) / files AS share, share <= 0.2 AS is_valid FROM c""")
def a8_staleness(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders")
    indexed = orders.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("mtime_ms"), F.col("o_custkey").alias("size"))
    now = orders.filter("o_custkey % 7 != 0").select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(F.col("o_orderkey")).alias("mtime_ms"), F.col("o_custkey").alias("size"))
    return reports.staleness(indexed, now)


@query(f"""{WITH} SELECT path, coalesce(list(name ORDER BY name) FILTER (is_exported), []) AS exports, coalesce(list(name ORDER BY name) FILTER (NOT is_exported), []) AS internals,
    coalesce((SELECT list(target_file ORDER BY target_file) FROM fe WHERE source_file = path), []) AS dependencies, (SELECT count(*) FROM fe WHERE target_file = path) AS dependents,
    (SELECT count(*) FROM links WHERE source_file = path AND is_type_only) AS cyclic_edges FROM nodes GROUP BY path""")
def g33_codemap(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    # The part graph has no cycles worth the name; its USES edges take the place of cyclic ones.
    return reports.codemap(nodes, edges, edges.filter("type_relation = 'USES'"))


@query(f"""{WITH}, c AS (SELECT target_file AS path, source_id, min(source_line) AS line FROM (SELECT e.*, t.path AS target_file FROM edges e JOIN nodes s ON source_id = s.id JOIN nodes t ON target_id = t.id) GROUP BY 1, 2),
    top AS (SELECT path, source_id, row_number() OVER (PARTITION BY path ORDER BY line, source_id) AS k FROM c QUALIFY k <= 5),
    n AS (SELECT path, count(DISTINCT source_id) AS n FROM (SELECT t.path, source_id FROM edges JOIN nodes t ON target_id = t.id) GROUP BY path),
    s AS (SELECT path, string_agg('- `' || name || '` (' || type || ', line ' || start_line || ')', chr(10) ORDER BY start_line, id) AS listed FROM nodes GROUP BY path),
    scored AS (SELECT s.*, CAST(coalesce(round(100 * n / (SELECT max(n) FROM n)), 0) AS INTEGER) AS score FROM s LEFT JOIN n USING (path))
    SELECT path, score, '# ' || path || chr(10) || chr(10) || 'Hub score: ' || score || chr(10) || chr(10) || '## Symbols' || chr(10) || chr(10) || listed || chr(10) ||
        coalesce((SELECT chr(10) || '## Callers' || chr(10) || chr(10) || string_agg('- `' || source_id || '`', chr(10) ORDER BY k) || chr(10) FROM top WHERE top.path = scored.path), '') AS article FROM scored""")
def k7_articles(spark, sf_dir):
    return reports.articles(*_graph(spark, sf_dir), most_callers=5)


@query(f"""{WITH}, top AS (SELECT path FROM (SELECT source_file AS path FROM fe UNION ALL SELECT target_file FROM fe) GROUP BY path ORDER BY count(*) DESC, path LIMIT 50),
    shown AS (SELECT * FROM fe WHERE source_file IN (FROM top) AND target_file IN (FROM top) ORDER BY 1, 2 LIMIT 40)
    SELECT 'flowchart LR' || chr(10) || string_agg('  ' || regexp_replace(source_file, '[^A-Za-z0-9]', '_', 'g') || ' --> ' || regexp_replace(target_file, '[^A-Za-z0-9]', '_', 'g'), chr(10) ORDER BY source_file, target_file) AS diagram FROM shown""")
def k8_diagram(spark, sf_dir):
    return reports.diagram(_file_edges(spark, sf_dir))


def _sessions(spark, sf_dir):
    """One session per user and event type of the events, with a lookup tool's and a crawl tool's numbers."""
    e = tables.table(spark, sf_dir, "events")
    zero = F.lit(0).cast("long")
    count = lambda c: F.struct(c.alias("calls"), (c * 10).alias("jsonTokens"), (c * 6).alias("toonTokens"), (c * 4).alias("savings"), zero.alias("truncations"))
    n, few = F.count("*"), F.count_if(F.col("value") < 50)
    return e.groupBy("user_id", F.col("event_type").alias("source")).agg(
        F.lit(1).alias("schemaVersion"), F.concat_ws("-", F.lit("s"), "user_id", "event_type").alias("sessionId"), F.min("event_id").alias("startedAt"),
        F.create_map(F.lit("lookup"), count(few), F.lit("crawl"), count(n - few)).alias("byTool"), count(n).alias("totals"), F.struct(few.alias("calls"), (few * 3).alias("tokensUsed")).alias("llmUsage"),
    )


_PER_SESSION = "s AS (SELECT user_id, event_type AS source, count(*) AS n, count(*) FILTER (value < 50) AS few, min(event_id) AS began FROM events GROUP BY ALL)"


@query(f"WITH {_PER_SESSION} SELECT source, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(n) * 10 AS BIGINT) AS jsonTokens, CAST(sum(n) * 6 AS BIGINT) AS toonTokens, CAST(sum(n) * 4 AS BIGINT) AS savings, 0::BIGINT AS truncations, CAST(sum(few) * 3 AS BIGINT) AS llmTokensUsed, CAST(sum(few) AS BIGINT) AS llmCalls FROM s GROUP BY source")
def a12_session_totals(spark, sf_dir):
    return reports.session_totals(_sessions(spark, sf_dir))


@query(f"WITH {_PER_SESSION}, t AS (SELECT 'lookup' AS tool, few AS c FROM s UNION ALL SELECT 'crawl', n - few FROM s) SELECT tool, CAST(sum(c) AS BIGINT) AS calls, CAST(sum(c) * 10 AS BIGINT) AS jsonTokens, CAST(sum(c) * 6 AS BIGINT) AS toonTokens, CAST(sum(c) * 4 AS BIGINT) AS savings, 0::BIGINT AS truncations FROM t GROUP BY tool")
def a12_tool_totals(spark, sf_dir):
    return reports.tool_totals(_sessions(spark, sf_dir))


@query(f"WITH {_PER_SESSION} SELECT source, 's-' || user_id || '-' || source AS sessionId FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY began DESC, sessionId) <= 50")
def w5_newest_sessions(spark, sf_dir):
    return reports.newest_sessions(_sessions(spark, sf_dir)).select("source", "sessionId")


@query(f"WITH {NODES}, p AS (SELECT DISTINCT path, split_part(path, '/', -1) AS base, split_part(path, '/', -2) AS up FROM nodes), n AS (SELECT *, count(*) OVER (PARTITION BY base) AS same_name FROM p) SELECT path, CASE WHEN same_name > 1 THEN up || '/' || base ELSE base END AS label, same_name FROM n")
def w4_labels(spark, sf_dir):
    return reports.disambiguated(tables.part_nodes(spark, sf_dir).select("path").distinct())


@query(f"WITH {NODES} SELECT DISTINCT folder AS id, 'folder' AS kind, NULL AS parent FROM nodes UNION ALL SELECT DISTINCT path, 'file', folder FROM nodes")
def a19_compounds(spark, sf_dir):
    return reports.compounds(tables.part_nodes(spark, sf_dir))


@query(f"WITH {NODES}, f AS (SELECT path, min(indexed_at) AS indexed_at FROM nodes GROUP BY path) SELECT path, indexed_at FROM f QUALIFY row_number() OVER (ORDER BY indexed_at, path) <= ceil((SELECT count(*) FROM f) / 10.0)")
def o6_oldest_files(spark, sf_dir):
    return reports.oldest_files(tables.part_nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT '[' || id || ',' || replace(replace(name, '_', '\\,'), 'x', '\\|') || ',' || replace(name, '_', '|') || ',' || start_line || ',' || is_exported || ']' AS line FROM nodes")
def k3_compact_lines(spark, sf_dir):
    odd = F.translate("name", "_x", ",|").alias("name")
    return compact.encode(tables.part_nodes(spark, sf_dir).select("id", odd, F.split("name", "_").alias("words"), "start_line", "is_exported"))


@query(f"WITH {NODES} SELECT id, translate(name, '_x', ',|') AS name, string_split(name, '_') AS words, start_line, is_exported FROM nodes")
def k3_compact_round_trip(spark, sf_dir):
    odd = F.translate("name", "_x", ",|").alias("name")
    rows = tables.part_nodes(spark, sf_dir).select("id", odd, F.split("name", "_").alias("words"), "start_line", "is_exported")
    return compact.decode(compact.encode(rows), rows.schema)


@query(f"WITH {NODES} SELECT id, CASE type WHEN 'method' THEN 'function' ELSE type END AS category FROM nodes WHERE type <> 'interface'")
def f18_categories(spark, sf_dir):
    return symbols.runtime_symbols(_symbols(spark, sf_dir)).select("id", symbols.category(F.col("kind")).alias("category"))


def _supplier_pairs(spark, sf_dir):
    """The ends alone, so that no relation is carried through the shuffles of all lines."""
    return written(tables.usual_followers(spark, sf_dir).select("source_id", "target_id"), "suppliers")


@query(f"""WITH RECURSIVE {SUPPLIERS}, e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges),
    walk(head, tail, way) AS (SELECT a, b, CASE WHEN a = b THEN [a] ELSE [a, b] END FROM e WHERE a <= b
        UNION ALL SELECT head, e.b, CASE WHEN e.b = head THEN way ELSE list_append(way, e.b) END FROM walk JOIN e ON e.a = tail WHERE tail <> head AND (e.b = head OR (e.b > head AND len(way) < 3 AND NOT list_contains(way, e.b))))
    SELECT list_append(way, head) AS cycle, len(way) AS size FROM walk WHERE tail = head""")
def g11_cycle_paths(spark, sf_dir):
    return cycles.cycle_paths(_supplier_pairs(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE {SUPPLIERS}, e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges),
    walk(head, tail, way) AS (SELECT a, b, CASE WHEN a = b THEN [a] ELSE [a, b] END FROM e WHERE a <= b
        UNION ALL SELECT head, e.b, CASE WHEN e.b = head THEN way ELSE list_append(way, e.b) END FROM walk JOIN e ON e.a = tail WHERE tail <> head AND (e.b = head OR (e.b > head AND len(way) < 8 AND NOT list_contains(way, e.b))))
    SELECT list_append(way, head) AS cycle, len(way) AS size FROM walk WHERE tail = head""")
def g11_long_cycles(spark, sf_dir):
    return cycles.cycle_paths(_supplier_pairs(spark, sf_dir), 8)


_SOURCES = {
    "/ws/a.ts": "import { help } from './b';\nexport function main() {\n  help();\n  const s = 'no()'; // no()\n}\nexport class Dog extends Animal {\n  bark() {\n    this.wag();\n  }\n  wag() { main(); }\n}\n",
    "/ws/b.ts": "export const help = (x) => {\n  return x;\n};\nexport class Animal {\n}\n",
    "/ws/c.py": "class A:\n    def m(self):\n        self.n()\n    def n(self):\n        free()\ndef free():\n    pass\n",
    "/ws/d.rs": "pub struct Cat {}\nimpl Pet for Cat {\n    fn speak(&self) { help(); }\n}\nfn help() {}\ntrait Pet {}\n",
}


@example("""SELECT * FROM (VALUES ('/ws/a.ts:main', '/ws/b.ts:help', 'CALLS', 3), ('/ws/a.ts:Dog', '/ws/b.ts:Animal', 'INHERITS', 6), ('/ws/a.ts:bark', '/ws/a.ts:wag', 'CALLS', 8), ('/ws/a.ts:wag', '/ws/a.ts:main', 'CALLS', 10),
    ('/ws/c.py:m', '/ws/c.py:n', 'CALLS', 3), ('/ws/c.py:n', '/ws/c.py:free', 'CALLS', 5), ('/ws/d.rs:speak', '/ws/d.rs:help', 'CALLS', 3), ('/ws/d.rs:Cat', '/ws/d.rs:Pet', 'IMPLEMENTS', 1)) AS t(source_id, target_id, type_relation, source_line)""")
def x7_call_graph(spark, sf_dir):
    """Written sources, as the tables hold none; the SQL is the list of edges that they must give."""
    langs = {"ts": "typescript", "py": "python", "rs": "rust"}
    files = spark.createDataFrame([(p, t, langs[p.rsplit(".", 1)[1]]) for p, t in _SOURCES.items()], "path string, text string, lang string")
    nodes, edges = definitions.extract(files)
    return definitions.resolve_edges(nodes, edges)


@query(f"""WITH RECURSIVE {NODES}, {FIRST}, o AS (SELECT id, name, path FROM nodes WHERE folder LIKE '/ws/small%'), r(root, id, d) AS (SELECT id, id, 0 FROM o UNION SELECT root, source_id, d + 1 FROM r JOIN edges ON target_id = r.id WHERE d < 3),
    u AS (SELECT root AS id, count(*) AS dependents, max(d) = 3 AS partial FROM (SELECT root, id, min(d) AS d FROM r WHERE d > 0 GROUP BY ALL) GROUP BY root),
    c AS (SELECT source_id AS id FROM edges WHERE type_relation = 'USES' UNION SELECT target_id FROM edges WHERE type_relation = 'USES'), d AS (SELECT id FROM nodes WHERE is_exported AND start_line < 1000),
    f AS (SELECT o.path, o.name, o.id, 0 AS breaking, coalesce(dependents, 0) AS dependents, o.id IN (FROM c) AS cyclic, o.id IN (FROM d) AS unused, o.path LIKE '%1.src' AS tested, coalesce(partial, false) AS partial FROM o LEFT JOIN u USING (id)),
    s AS (SELECT *, CAST(least(100, 5 * dependents + 20 * cyclic::INT + 10 * unused::INT + 10 * (NOT tested)::INT + 10 * partial::INT) AS INTEGER) AS score FROM f)
    SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS risk FROM s""")
def g16_review(spark, sf_dir):
    nodes, edges = tables.part_nodes(spark, sf_dir), written(tables.first_followers(spark, sf_dir), "edges")
    none = spark.createDataFrame([], "file_path string, name string, subject string, change string, breaking boolean")
    return reports.review(
        nodes, edges.withColumn("is_cyclic", F.col("type_relation") == "USES"), none, nodes.filter("folder like '/ws/small%'").select("path"), nodes.filter("is_exported and start_line < 1000"), nodes.filter("path like '%1.src'").select("path")
    )


@query(f"""WITH {NODES}, p AS (SELECT DISTINCT path AS source, '../' || split_part(path, '/', 3) || '/' || replace(split_part(path, '/', -1), '.src', '') AS module, path FROM nodes)
    SELECT '/ws/x/main.ts' AS path, module, replace(path, '.src', '.ts') AS target_path FROM p""")
def x13_resolve_modules(spark, sf_dir):
    """One script that imports every file of the part graph by a relative path."""
    paths = tables.part_nodes(spark, sf_dir).select("path").distinct()
    name = F.regexp_extract("path", r"/ws/(.*)\.src$", 1)
    wanted = paths.select(F.lit("/ws/x/main.ts").alias("path"), F.concat(F.lit("../"), name).alias("module"), F.lit("typescript").alias("lang"))
    return resolve.resolve(wanted, paths.select(F.concat(F.lit("/ws/"), name, F.lit(".ts")).alias("path")))
