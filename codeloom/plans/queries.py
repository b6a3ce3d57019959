"""The registered queries of the engine's own operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cycles, relational, traverse
from ..sources import tables
from ..streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def _steps_sql(column: str) -> str:
    return f"""(SELECT * FROM (SELECT {column} AS a, lead({column}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS b,
        CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'USES' ELSE 'INHERITS' END AS type_relation, CAST(l_linenumber AS INTEGER) AS line, l_orderkey * 100 + l_linenumber AS place FROM lineitem) WHERE b IS NOT NULL)"""


NODES = """nodes AS (SELECT 'n' || p_partkey AS id, replace(p_name, ' ', '_') AS name, ['function','method','class','interface','variable'][p_size % 5 + 1] AS type,
    ['typescript','python','rust'][p_size % 3 + 1] AS lang, '/ws/' || lower(p_type) || '/' || replace(p_brand, 'Brand#', 'b') || '.src' AS path, '/ws/' || lower(p_type) AS folder,
    CAST(p_partkey % 500 * 10 AS INTEGER) AS start_line, CAST(p_partkey % 500 * 10 + p_size AS INTEGER) AS end_line, p_size % 2 = 0 AS is_exported, p_partkey * 7 % 1000 AS indexed_at FROM part)"""
EDGES = f"edges AS MATERIALIZED (SELECT 'n' || a AS source_id, 'n' || b AS target_id, type_relation, min(line) AS source_line FROM {_steps_sql('l_partkey')} GROUP BY ALL)"
FIRST = f"edges AS MATERIALIZED (SELECT 'n' || a AS source_id, 'n' || b AS target_id, type_relation, line AS source_line FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY place, b, type_relation, line) AS k FROM {_steps_sql('l_partkey')}) WHERE k = 1)"
SUPPLIERS = f"""edges AS MATERIALIZED (SELECT 's' || a AS source_id, 's' || b AS target_id, f.type_relation, f.line AS source_line FROM (SELECT a, b, count(*) AS n, min({{'place': place, 'type_relation': type_relation, 'line': line}}) AS f FROM {_steps_sql('l_suppkey')} GROUP BY a, b) QUALIFY n = max(n) OVER (PARTITION BY a))"""
TRADES = "edges AS MATERIALIZED (SELECT DISTINCT 'c' || o_custkey AS source_id, 's' || l_suppkey AS target_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
BOTH = "u AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges)"


def query(sql: str | None):
    def register(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return register


_EXAMPLES: dict[str, tuple[Query, str]] = {}


def example(sql: str):
    """For an operator over a written tree or list, with the rows to be given: a test's case, and no registered query."""

    def register(f: Query) -> Query:
        _EXAMPLES[f.__name__] = (f, sql)
        return f

    return register


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tables.part_nodes(spark, sf_dir), tables.followers(spark, sf_dir)


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The trade graph and its smallest customer."""
    edges = traverse.written(tables.trades(spark, sf_dir), "trades")
    return edges, edges.agg(F.min("source_id").alias("id"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.written(tables.usual_followers(spark, sf_dir), "suppliers")


def _bfs(edge_view: str, walk: str, depth: int) -> str:
    """WITH clause: nodes within ``depth`` of the smallest source."""
    return f"""WITH RECURSIVE {edge_view}, {BOTH}, r(id, d) AS (SELECT min(source_id), 0 FROM edges UNION SELECT w.b, d + 1 FROM r JOIN {walk} w ON w.a = r.id WHERE d < {depth}),
        near AS (SELECT id, CAST(min(d) AS INTEGER) AS depth FROM r GROUP BY id)"""


_OUT, _IN = "(SELECT source_id AS a, target_id AS b FROM edges)", "(SELECT target_id AS a, source_id AS b FROM edges)"


@query(_bfs(TRADES, "u", 3) + " SELECT id, depth FROM near")
def g1_neighbourhood(spark, sf_dir):
    edges, root = _trade(spark, sf_dir)
    return traverse.reach(edges, root, 3, "both").nodes


@query(_bfs(TRADES, "u", 2) + " SELECT source_id, target_id FROM edges JOIN near x ON source_id = x.id JOIN near y ON target_id = y.id")
def j6_induced_edges(spark, sf_dir):
    edges, root = _trade(spark, sf_dir)
    return traverse.induced(edges, traverse.reach(edges, root, 2, "both").nodes).select("source_id", "target_id")


@query(_bfs(EDGES, _OUT, 2) + " SELECT source_id, target_id, type_relation, source_line, depth + 1 AS depth FROM edges JOIN near ON source_id = id")
def g4_callees(spark, sf_dir):
    edges = traverse.written(_graph(spark, sf_dir)[1], "edges")
    return traverse.relations(edges, edges.agg(F.min("source_id").alias("id")), "out", 3)


@query(_bfs(EDGES, _IN, 2) + " SELECT source_id, target_id, type_relation, source_line, depth + 1 AS depth FROM edges JOIN near ON target_id = id")
def g4_callers(spark, sf_dir):
    edges = traverse.written(_graph(spark, sf_dir)[1], "edges")
    return traverse.relations(edges, edges.agg(F.min("source_id").alias("id")), "in", 3)


@query(_bfs(EDGES, _OUT, 4) + " SELECT id, depth FROM near")
def g5_crawl(spark, sf_dir):
    edges = traverse.written(_graph(spark, sf_dir)[1], "edges")
    return traverse.crawl(edges, edges.agg(F.min("source_id").alias("id")), 3)


@query(f"WITH RECURSIVE {TRADES}, {BOTH}, seeds AS (SELECT DISTINCT source_id AS id FROM edges ORDER BY 1 LIMIT 5), r(id, d) AS (SELECT id, 0 FROM seeds UNION SELECT u.b, d + 1 FROM r JOIN u ON u.a = r.id WHERE d < 4), near AS (SELECT id, CAST(min(d) AS INTEGER) AS depth FROM r GROUP BY id) SELECT id, depth FROM near ORDER BY depth, id LIMIT 50")
def g3_seeded_budget(spark, sf_dir):
    edges, _ = _trade(spark, sf_dir)
    return traverse.budgeted(edges, edges.select(F.col("source_id").alias("id")).distinct().orderBy("id").limit(5), 4, 50)


@query(_bfs(EDGES, _IN, 3) + """, s AS (SELECT min(source_id) AS id FROM edges), k AS (SELECT count(*) FILTER (type_relation <> 'USES') AS runtime, count(*) FILTER (type_relation = 'USES') AS type_only FROM edges JOIN s ON target_id = s.id),
    n AS (SELECT count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, count(*) AS total FROM near WHERE depth > 0)
    SELECT n.*, k.*, CASE WHEN total > 20 OR direct > 10 THEN 'high' WHEN total > 5 OR direct > 3 THEN 'medium' ELSE 'low' END AS level,
    EXISTS (SELECT 1 FROM edges JOIN near ON target_id = near.id AND depth = 3 WHERE source_id NOT IN (SELECT id FROM near)) AS partial FROM n, k""")
def g15_impact(spark, sf_dir):
    edges = traverse.written(_graph(spark, sf_dir)[1], "edges")
    return traverse.impact(edges, edges.agg(F.min("source_id").alias("id")), 3)


_CLOSURE = "r(a, b) AS (SELECT source_id, target_id FROM e UNION SELECT r.a, e.target_id FROM r JOIN e ON r.b = e.source_id)"


@query(f"WITH RECURSIVE {SUPPLIERS}, e AS (SELECT * FROM edges WHERE type_relation <> 'USES'), {_CLOSURE} SELECT source_id, target_id, type_relation, type_relation <> 'USES' AND EXISTS (SELECT 1 FROM r WHERE r.a = edges.target_id AND r.b = edges.source_id) AS is_cyclic FROM edges")
def g9_cycle_edges(spark, sf_dir):
    return cycles.mark_cycles(_suppliers(spark, sf_dir)).select("source_id", "target_id", "type_relation", "is_cyclic")


@query(f"""WITH RECURSIVE {SUPPLIERS}, e AS (SELECT DISTINCT source_id, target_id FROM edges), {_CLOSURE}, m AS (SELECT x.a AS id, max(x.b) AS component, count(*) AS size FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
    SELECT DISTINCT component, size, CASE WHEN size = 1 THEN 'self' WHEN size = 2 THEN 'mutual' ELSE 'complex' END AS kind FROM m""")
def g13_cycle_types(spark, sf_dir):
    return cycles.cycle_types(_suppliers(spark, sf_dir))


@query(f"WITH {NODES}, {EDGES} SELECT id, (SELECT count(*) FROM edges WHERE source_id = id) AS out_degree, (SELECT count(*) FROM edges WHERE target_id = id) AS in_degree FROM nodes")
def a1_degrees(spark, sf_dir):
    return relational.degrees(*_graph(spark, sf_dir))


@query(f"WITH {NODES}, {EDGES}, d AS (SELECT id, count(target_id) AS n FROM nodes LEFT JOIN edges ON target_id = id GROUP BY id) SELECT id, round(n / greatest((SELECT max(n) FROM d), 1), 3) AS hub_score FROM d")
def a4_hub_scores(spark, sf_dir):
    return relational.hub_scores(*_graph(spark, sf_dir))


@query(f"WITH {NODES}, {EDGES}, p AS (SELECT path, count(DISTINCT source_id) AS callers FROM edges JOIN nodes ON target_id = id GROUP BY path) SELECT path, callers, CAST(round(100 * callers / (SELECT max(callers) FROM p)) AS INTEGER) AS score FROM p")
def a3_inbound_by_file(spark, sf_dir):
    return relational.inbound_by_file(*_graph(spark, sf_dir))


_ENDS = "edges JOIN nodes s ON source_id = s.id JOIN nodes t ON target_id = t.id"


@query(f"WITH {NODES}, {EDGES} SELECT source_id, target_id, type_relation, s.name AS caller, t.path AS called_path FROM {_ENDS} WHERE s.path <> t.path AND t.type <> 'method'")
def j2_external_callers(spark, sf_dir):
    return relational.external_callers(*_graph(spark, sf_dir)).select("source_id", "target_id", "type_relation", F.col("source_name").alias("caller"), F.col("target_path").alias("called_path"))


@query(f"WITH {NODES}, {EDGES}, c AS (SELECT t.path AS target_path, source_id, min(source_line) AS line FROM {_ENDS} GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY target_path ORDER BY line, source_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 3")
def j3_top_callers(spark, sf_dir):
    return relational.top_callers_by_file(*_graph(spark, sf_dir), most=3)


@query(f"WITH {EDGES} SELECT source_id, target_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY source_line, target_id) AS INTEGER) AS call_order FROM edges WHERE type_relation = 'CALLS'")
def w1_call_order(spark, sf_dir):
    return relational.call_order(_graph(spark, sf_dir)[1]).select("source_id", "target_id", "call_order")


@query(f"WITH {NODES}, {EDGES} SELECT source_id, target_id, type_relation FROM edges WHERE target_id NOT IN (SELECT id FROM nodes WHERE is_exported)")
def j7_dangling(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return relational.dangling(edges, nodes.filter("is_exported")).select("source_id", "target_id", "type_relation")


_DEAD = f"""WITH RECURSIVE {NODES}, {FIRST}, f AS (SELECT edges.*, s.path AS sp, t.path AS tp FROM {_ENDS}), alive(id) AS (SELECT DISTINCT target_id FROM f WHERE sp <> tp UNION SELECT target_id FROM alive JOIN f ON source_id = alive.id AND sp = tp),
    dead AS (SELECT id, path FROM nodes WHERE is_exported AND id NOT IN (SELECT id FROM alive))"""


def _dead(spark, sf_dir):
    nodes, edges = tables.part_nodes(spark, sf_dir), traverse.written(tables.first_followers(spark, sf_dir), "edges")
    inner = relational.with_ends(nodes, edges, "path").filter("source_path = target_path").select(*edges.columns)
    return nodes, relational.unreferenced(nodes, edges, inner)


@query(_DEAD + " SELECT id FROM dead")
def g19_unused_exports(spark, sf_dir):
    return _dead(spark, sf_dir)[1].select("id")


@query(_DEAD + " SELECT n.path, count(*) AS exported, count(dead.id) AS unused, CAST(round(100 * count(dead.id) / count(*)) AS INTEGER) AS percent FROM nodes n LEFT JOIN dead ON n.id = dead.id WHERE is_exported GROUP BY n.path")
def g20_dead_code(spark, sf_dir):
    return relational.dead_code(*_dead(spark, sf_dir))


@query(f"""WITH {NODES}, stubs AS (SELECT DISTINCT path AS source_path, lang, name FROM nodes WHERE NOT is_exported), c AS (SELECT s.*, n.id, n.is_exported, n.indexed_at,
    CASE WHEN s.source_path[:len(folder) + 1] = folder || '/' THEN 3 ELSE 2 END AS similarity FROM stubs s JOIN nodes n ON s.lang = n.lang AND s.name = n.name)
    SELECT source_path, lang, name, id, CAST(similarity AS INTEGER) AS similarity FROM c QUALIFY row_number() OVER (PARTITION BY source_path, lang, name ORDER BY similarity DESC, is_exported DESC, indexed_at DESC, id DESC) = 1""")
def j8_best_match(spark, sf_dir):
    nodes = tables.part_nodes(spark, sf_dir)
    return relational.resolve_stubs(nodes.filter("not is_exported").select(F.col("path").alias("source_path"), "lang", "name").distinct(), nodes)


_STEM = "regexp_replace(path, '\\.src$', '')"


@query(f"""WITH {NODES}, {EDGES}, files AS (SELECT DISTINCT {_STEM} || ['.ts', '/index.ts', '.py', '.js', ''][start_line // 10 % 5 + 1] AS path FROM nodes),
    i AS (SELECT DISTINCT s.path AS source_path, regexp_replace(t.path, '\\.src$', '') AS base FROM edges JOIN nodes s ON source_id = s.id JOIN nodes t ON target_id = t.id),
    e(rank, suffix) AS (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.py'), (5, '/index.ts'), (6, '/index.tsx'), (7, '/index.js'), (8, '/index.py'))
    SELECT source_path, base, min_by(path, rank) AS target_path, CAST(min(rank) AS INTEGER) AS rank FROM i, e JOIN files ON path = base || suffix GROUP BY ALL""")
def j9_module_resolution(spark, sf_dir):
    """Every file imports the files that its parts lead to; each of those exists in one or more of five forms."""
    nodes, edges = _graph(spark, sf_dir)
    stem = lambda c: F.regexp_replace(c, r"\.src$", "")
    endings = F.array(*map(F.lit, (".ts", "/index.ts", ".py", ".js", "")))
    files = nodes.select(F.concat(stem("path"), endings[(F.col("start_line") / 10).cast("int") % 5]).alias("path"))
    imports = relational.with_ends(nodes, edges, "path").select(F.col("source_path"), stem("target_path").alias("base")).distinct()
    return relational.resolve_modules(imports, files)


@query(f"""WITH {NODES}, p AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT path FROM nodes)),
    c AS (SELECT e.event_id AS cursor, p.path, CAST(e.event_id % 5000 AS INTEGER) AS line FROM events e JOIN p ON e.event_id % n = k)
    SELECT cursor, c.path, line, id, start_line FROM c JOIN nodes ON c.path = nodes.path AND start_line <= line AND line <= end_line QUALIFY row_number() OVER (PARTITION BY cursor ORDER BY start_line DESC, id DESC) = 1""")
def j10_definition_at(spark, sf_dir):
    """A cursor for every event, dealt to all files in turn."""
    nodes = tables.part_nodes(spark, sf_dir)
    paths = relational.ranked(nodes.select("path").distinct(), "path").withColumn("k", F.col("rank") - 1)
    n = paths.count()
    cursors = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("cursor"), (F.col("event_id") % 5000).cast("int").alias("line"), (F.col("event_id") % max(n, 1)).alias("k")).join(paths, "k")
    return relational.definition_at(cursors.select("cursor", "path", "line"), nodes)


@query(f"""WITH {NODES}, t AS (SELECT DISTINCT id, unnest(string_split(name, '_')) AS token FROM nodes), k(keyword, wanted) AS (VALUES ('red', 'red'), ('wid', 'wid'), ('blue bo', 'blue'), ('blue bo', 'bo')),
    h AS (SELECT keyword, id FROM t JOIN k ON starts_with(token, wanted) GROUP BY keyword, id HAVING count(DISTINCT wanted) = (SELECT count(*) FROM k x WHERE x.keyword = k.keyword)),
    f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY id) <= 50)
    SELECT id, count(*) AS score FROM f GROUP BY id ORDER BY score DESC, id LIMIT 20""")
def g27_keyword_seeds(spark, sf_dir):
    return relational.keyword_scores(tables.part_nodes(spark, sf_dir), ["red", "wid", "blue bo"])


@query(f"WITH {NODES} SELECT id, name, CAST(sum(length(name) + 1) OVER (ORDER BY id) AS BIGINT) AS used FROM nodes QUALIFY used <= 400")
def o8_token_budget(spark, sf_dir):
    return relational.within_budget(tables.part_nodes(spark, sf_dir).select("id", "name"), F.length("name"), 400, ["id"], 200).select("id", "name", F.col("used").cast("long").alias("used"))


@query(f"WITH {NODES} SELECT id, path FROM nodes ORDER BY path, id LIMIT 25 OFFSET 10")
def o1_page(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return relational.page(nodes, edges, ["path", "id"], 10, 25)[0].select("id", "path")


@query(f"WITH {NODES}, {EDGES}, p AS (SELECT id FROM nodes ORDER BY path, id LIMIT 400 OFFSET 10) SELECT source_id, target_id, type_relation, source_line FROM edges WHERE source_id IN (FROM p) AND target_id IN (FROM p)")
def o1_page_edges(spark, sf_dir):
    return relational.page(*_graph(spark, sf_dir), ["path", "id"], 10, 400)[1]


@query(f"WITH {EDGES}, s AS (SELECT source_id, target_id, type_relation, source_line + 100 AS source_line FROM edges WHERE source_line <= 2 UNION ALL SELECT target_id, source_id, type_relation, 7 FROM edges WHERE source_line > 5), a AS (SELECT *, 0 AS k FROM edges UNION ALL SELECT *, 1 FROM s) SELECT source_id, target_id, type_relation, CAST(source_line AS INTEGER) AS source_line FROM a QUALIFY row_number() OVER (PARTITION BY source_id, target_id, type_relation ORDER BY k, source_line) = 1")
def u1_merge(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    other = edges.filter("source_line <= 2").withColumn("source_line", F.col("source_line") + 100).unionByName(edges.filter("source_line > 5").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "type_relation", F.lit(7).alias("source_line")))
    return relational.merge_edges(edges, other)


_UPSERT = f"WITH {NODES}, {EDGES}, p AS (SELECT * FROM nodes WHERE folder = '/ws/small'), fresh AS (SELECT * FROM p WHERE is_exported), now AS (SELECT * FROM nodes WHERE folder <> '/ws/small' OR is_exported)"


def _upserted(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    fresh = nodes.filter("folder = '/ws/small' and is_exported")
    made = fresh.select(F.col("id").alias("source_id"), F.lit("n0").alias("target_id"), F.lit("CALLS").alias("type_relation"), "start_line").withColumnRenamed("start_line", "source_line")
    # Files of the folder without an exported symbol are replaced by nothing.
    nodes, edges = relational.invalidate(nodes, edges, nodes.filter("folder = '/ws/small'").select("path").join(fresh.select("path"), "path", "left_anti").distinct())
    return relational.upsert_files(nodes, edges, fresh, made)


@query(_UPSERT + """, old AS (SELECT edges.* FROM edges WHERE source_id NOT IN (SELECT id FROM p)), made AS (SELECT id AS source_id, 'n0' AS target_id, 'CALLS' AS type_relation, start_line AS source_line FROM fresh)
    SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM made) WHERE target_id IN (SELECT id FROM now)""")
def g28_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir)[1]


@query(f"WITH {NODES}, {EDGES}, p AS (SELECT id FROM nodes WHERE folder = '/ws/promo') SELECT source_id, target_id, type_relation FROM edges WHERE source_id NOT IN (SELECT id FROM p) AND target_id NOT IN (SELECT id FROM p)")
def g29_invalidate(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return relational.invalidate(nodes, edges, nodes.filter("folder = '/ws/promo'").select("path").distinct())[1].select("source_id", "target_id", "type_relation")


@query(f"WITH {NODES}, d AS (SELECT DISTINCT path, string_split(path, '/')[3] AS domain FROM nodes), k AS (SELECT domain, row_number() OVER (ORDER BY min(path)) AS community FROM d GROUP BY domain) SELECT path, domain, CAST(community AS INTEGER) AS community FROM d JOIN k USING (domain)")
def g22_path_communities(spark, sf_dir):
    return relational.path_communities(tables.part_nodes(spark, sf_dir).select("path").distinct())


@query(None)
def g23_label_communities(spark, sf_dir):
    return relational.label_communities(_trade(spark, sf_dir)[0])


_LINES = "l AS (SELECT 'l' || l_orderkey || '-' || l_linenumber AS id, l_orderkey AS o FROM lineitem)"


@query(f"WITH {_LINES}, g AS (SELECT o, min(id) AS first, count(DISTINCT id) AS n FROM l GROUP BY o), c AS (SELECT o, row_number() OVER (ORDER BY first) AS k FROM g WHERE n > 1) SELECT DISTINCT id, CAST(coalesce(k, 0) AS INTEGER) AS community FROM l LEFT JOIN c USING (o)")
def g23_communities(spark, sf_dir):
    """Lines of all orders, each linked with the other lines of its order: every order of several lines is a community."""
    # By orders, so that lines are told apart and joined where they are.
    numbers = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").repartition("l_orderkey").distinct()
    line = numbers.select(F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), "l_orderkey")
    edges = line.withColumnRenamed("id", "source_id").join(line.withColumnRenamed("id", "target_id"), "l_orderkey").filter("source_id < target_id")
    return relational.communities(line.select("id"), edges)


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def f13_links(spark, sf_dir):
    return tables.links(spark, sf_dir)


@query(f"WITH {NODES} SELECT id, CASE lang WHEN 'rust' THEN 'c:/ws' || path[4:] ELSE path END AS path, CAST(ceil(length(name) / 4.0) AS BIGINT) AS tokens, list_filter(string_split(lower(name), '_'), lambda t: length(t) > 1) AS words FROM nodes")
def f1_text_functions(spark, sf_dir):
    messy = F.when(F.col("lang") == "rust", F.concat(F.lit("C:\\"), F.replace(F.replace("path", F.lit("/ws"), F.lit("ws")), F.lit("/"), F.lit("\\\\")), F.lit("\\"))).otherwise(F.concat("path", F.lit("/")))
    return tables.part_nodes(spark, sf_dir).select("id", T.normalize_path(messy).alias("path"), T.token_estimate(F.col("name")).alias("tokens"), T.identifier_tokens(F.col("name")).alias("words"))


@query(f"WITH {NODES} SELECT id, CAST(least(100, 50 * (start_line % 2) + 5 * (end_line % 9) + CASE WHEN is_exported THEN 20 ELSE 0 END + CASE WHEN lang = 'rust' THEN 10 ELSE 0 END + CASE WHEN type = 'class' THEN 10 ELSE 0 END + CASE WHEN type = 'method' THEN 10 ELSE 0 END) AS INTEGER) AS score FROM nodes")
def a14_review_score(spark, sf_dir):
    c = F.col
    return tables.part_nodes(spark, sf_dir).select("id", T.review_score(c("start_line") % 2, c("end_line") % 9, c("is_exported"), c("lang") == "rust", c("type") == "class", c("type") == "method").alias("score"))


_OLD = "SELECT 'o' || l_orderkey AS file_path, 'old' AS version, 'f' AS name, CAST(l_linenumber AS INTEGER) AS position, 'p' || l_partkey || '-' || l_linenumber AS param, l_returnflag AS type, l_quantity > 25 AS is_optional FROM lineitem"
_NEW = """SELECT 'o' || l_orderkey, 'new', 'f', CAST(CASE WHEN l_linenumber = 1 AND l_tax < 0.03 THEN 9 ELSE l_linenumber END AS INTEGER), 'p' || l_partkey || '-' || l_linenumber, CASE WHEN l_tax > 0.06 THEN l_linestatus ELSE l_returnflag END, l_quantity > 25 AND l_tax < 0.04 FROM lineitem WHERE l_discount > 0.02
    UNION ALL SELECT 'o' || l_orderkey, 'new', 'f', CAST(l_linenumber + 10 AS INTEGER), 'q' || l_linenumber, 'int', l_quantity > 40 FROM lineitem WHERE l_discount = 0.05"""


@query(f"""WITH s AS ({_OLD} UNION ALL {_NEW}), r AS (SELECT *, row_number() OVER (PARTITION BY file_path, version, name ORDER BY position, param) - 1 AS place FROM s),
    o AS (SELECT * FROM r WHERE version = 'old'), n AS (SELECT * FROM r WHERE version = 'new'), k AS (SELECT file_path, name FROM o INTERSECT SELECT file_path, name FROM n),
    j AS (SELECT coalesce(o.file_path, n.file_path) AS file_path, 'f' AS name, coalesce(o.param, n.param) AS subject, o.type AS a, n.type AS b, o.param IS NULL AS added, n.param IS NULL AS gone, o.is_optional AS oo, n.is_optional AS nn FROM o FULL JOIN n ON o.file_path = n.file_path AND o.param = n.param),
    c AS (SELECT file_path, name, subject, 'parameter-removed' AS change, true AS breaking FROM j WHERE gone UNION ALL SELECT file_path, name, subject, 'parameter-added-required', true FROM j WHERE added AND NOT nn
        UNION ALL SELECT file_path, name, subject, 'parameter-added-optional', false FROM j WHERE added AND nn UNION ALL SELECT file_path, name, subject, 'parameter-type-changed', true FROM j WHERE NOT added AND NOT gone AND a <> b
        UNION ALL SELECT file_path, name, subject, 'parameter-optional-to-required', true FROM j WHERE NOT added AND NOT gone AND oo AND NOT nn
        UNION ALL SELECT o.file_path, o.name, CAST(o.place AS VARCHAR), 'parameter-order-changed', false FROM o JOIN n USING (file_path, name, place) WHERE o.param <> n.param)
    SELECT c.* FROM c SEMI JOIN k USING (file_path, name)""")
def x15_signature_changes(spark, sf_dir):
    """Every order is a function whose lines are parameters; another version changes lines by their discount and tax."""
    line = tables.table(spark, sf_dir, "lineitem")
    file, at, name = F.concat(F.lit("o"), "l_orderkey").alias("file_path"), F.col("l_linenumber"), F.concat(F.lit("p"), "l_partkey", F.lit("-"), "l_linenumber").alias("param")
    row = lambda version, position, param, type_, optional: (file, F.lit(version).alias("version"), F.lit("f").alias("name"), position.cast("int").alias("position"), param, type_.alias("type"), optional.alias("is_optional"))
    old = line.select(*row("old", at, name, F.col("l_returnflag"), F.col("l_quantity") > 25))
    moved = F.when((at == 1) & (F.col("l_tax") < 0.03), 9).otherwise(at)
    new = line.filter("l_discount > 0.02").select(*row("new", moved, name, F.when(F.col("l_tax") > 0.06, F.col("l_linestatus")).otherwise(F.col("l_returnflag")), (F.col("l_quantity") > 25) & (F.col("l_tax") < 0.04)))
    more = line.filter("l_discount = 0.05").select(*row("new", at + 10, F.concat(F.lit("q"), "l_linenumber").alias("param"), F.lit("int"), F.col("l_quantity") > 40))
    return relational.compare_parameters(old.unionByName(new).unionByName(more))


@query("""WITH e AS (SELECT 'u' || user_id AS path, ts, CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'create' ELSE 'change' END AS event_type FROM events),
    s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS burst FROM s)
    SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, CASE max(CASE event_type WHEN 'create' THEN 1 WHEN 'change' THEN 2 ELSE 3 END) WHEN 1 THEN 'create' WHEN 2 THEN 'change' ELSE 'delete' END AS event_type, count(*) AS events FROM g GROUP BY path, burst""")
def t1_debounce(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "create").otherwise("change")
    events = tables.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event_type"))
    return changes.debounce(events, "2 hours").select("path", F.date_format(F.col("started"), "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "events")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


def examples() -> dict[str, tuple[Query, str]]:
    return dict(_EXAMPLES)
