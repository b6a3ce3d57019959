"""Registered queries over kept structures: the token index, the graph store, blocks of lines, and the whole graph's cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintain, relational, traverse
from ..operators.adjacency import Adjacency
from ..sources import rollup, tables
from ..sources.token_index import TokenIndex
from ..storage import shared_folder, written
from ..streaming.store import GraphStore
from .queries import _IN, _OUT, EDGES, NODES, TRADES, _bfs, query

_RENAMED = "CASE WHEN path LIKE '%2.src' THEN 'green_' || name ELSE name END"


@query(f"""WITH {NODES}, t AS (SELECT DISTINCT id, unnest(string_split({_RENAMED}, '_')) AS token FROM nodes WHERE path NOT LIKE '%1.src'), k(keyword, wanted) AS (VALUES ('g', 'g'), ('wid', 'wid'), ('blue bo', 'blue'), ('blue bo', 'bo')),
    h AS (SELECT keyword, id FROM t JOIN k ON starts_with(token, wanted) WHERE length(token) > 1 GROUP BY keyword, id HAVING count(DISTINCT wanted) = (SELECT count(*) FROM k x WHERE x.keyword = k.keyword))
    SELECT id, count(*) AS score FROM h GROUP BY id""")
def j4_token_index(spark, sf_dir):
    """All parts that meet a keyword, by an index in which some files were read again under other names and some went."""
    nodes = tables.part_nodes(spark, sf_dir)
    index = TokenIndex(spark, shared_folder(spark, "token-index"))
    index.build(nodes)
    changed = nodes.select("path").filter("path like '%1.src' or path like '%2.src'").distinct()
    index.update(1, changed, nodes.filter("path like '%2.src'").withColumn("name", F.concat(F.lit("green_"), "name")))
    return index.scores(["g", "wid", "blue bo"], None, None)


@query("""WITH t AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id, unnest(string_split_regex(lower(text), '[ \\n\\t]+')) AS token FROM documents), k(keyword, wanted) AS (VALUES ('th in', 'th'), ('th in', 'in'), ('passwor', 'passwor'), ('ei', 'ei')),
    h AS (SELECT keyword, id FROM t JOIN k ON starts_with(token, wanted) WHERE length(token) > 1 GROUP BY keyword, id HAVING count(DISTINCT wanted) = (SELECT count(*) FROM k x WHERE x.keyword = k.keyword))
    SELECT id, count(*) AS score FROM h GROUP BY id""")
def f12_document_words(spark, sf_dir):
    """All documents that meet a keyword, by an index of their words."""
    words = lambda text: F.filter(F.split(F.lower(text), r"[ \n\t]+"), lambda t: F.length(t) > 1)
    index = TokenIndex(spark, shared_folder(spark, "word-index"), 1, words)
    docs = tables.table(spark, sf_dir, "documents")
    index.build(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("name"), F.col("source").alias("path")))
    return index.scores(["th in", "passwor", "ei"], None, None)


_STORED = f"""WITH {NODES}, {EDGES}, p AS (SELECT id FROM nodes WHERE path LIKE '%1.src'), q AS (SELECT * FROM nodes WHERE path LIKE '%2.src'),
    now AS (SELECT id FROM nodes WHERE path NOT LIKE '%1.src' AND (path NOT LIKE '%2.src' OR is_exported)), made AS (SELECT id AS source_id, 'n' || (CAST(substr(id, 2) AS BIGINT) + 1) AS target_id, 'CALLS' AS type_relation, start_line AS source_line FROM q WHERE is_exported)"""


@query(_STORED + """SELECT * FROM (SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM p) AND source_id NOT IN (SELECT id FROM q) UNION ALL SELECT * FROM made) WHERE target_id IN (SELECT id FROM now)""")
def g28_merge_on_read(spark, sf_dir):
    """The edges of a kept graph after some files went, others were read again, and the whole was compacted in between."""
    nodes, edges = tables.part_nodes(spark, sf_dir), tables.followers(spark, sf_dir)
    store = GraphStore(spark, shared_folder(spark, "graph-store"))
    store.create(nodes, edges)
    store.apply(1, nodes.filter("path like '%1.src'").select("path"), nodes.limit(0), edges.limit(0))
    store.compact()
    fresh = nodes.filter("path like '%2.src' and is_exported")
    made = fresh.select(F.col("id").alias("source_id"), F.concat(F.lit("n"), F.expr("cast(substr(id, 2) as bigint) + 1")).alias("target_id"), F.lit("CALLS").alias("type_relation"), F.col("start_line").alias("source_line"))
    store.apply(2, nodes.filter("path like '%2.src'").select("path"), fresh, made)
    return store.edges()


@query("""WITH n AS (SELECT 'n' || p_partkey AS id, CAST(p_partkey * 37 % 60000 AS INTEGER) AS start_line, CAST(p_partkey * 37 % 60000 + p_size * p_size AS INTEGER) AS end_line FROM part), c AS (SELECT event_id AS cursor, CAST(event_id * 7 % 70000 AS INTEGER) AS line FROM events),
    b AS (SELECT cursor, line, id, start_line FROM c JOIN n ON start_line <= line AND line <= end_line QUALIFY row_number() OVER (PARTITION BY cursor ORDER BY start_line DESC, id DESC) = 1), f AS (SELECT id, start_line FROM n ORDER BY start_line, id LIMIT 1)
    SELECT c.cursor, '/ws/all.src' AS path, c.line, coalesce(b.id, f.id) AS id, coalesce(b.start_line, f.start_line) AS start_line FROM c LEFT JOIN b USING (cursor), f""")
def j10_one_large_file(spark, sf_dir):
    """A cursor for every event and a definition for every part, all in one file; the first definition where there is none around."""
    start = (F.col("p_partkey") * 37 % 60000).cast("int")
    path = F.lit("/ws/all.src").alias("path")
    nodes = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("n"), "p_partkey").alias("id"), path, start.alias("start_line"), (start + F.col("p_size") * F.col("p_size")).cast("int").alias("end_line"))
    cursors = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("cursor"), path, (F.col("event_id") * 7 % 70000).cast("int").alias("line"))
    return relational.definition_at(cursors, nodes, first_else=True)


_WALK = "SELECT source_id AS a, target_id AS b FROM edges WHERE source_id <> target_id"


@query(f"""WITH RECURSIVE {EDGES}, e AS MATERIALIZED (SELECT DISTINCT a, b FROM ({_WALK})), d AS (SELECT id FROM (SELECT a AS id FROM e INTERSECT SELECT b FROM e)), top AS (SELECT max(id) AS id FROM d),
    f(id) AS (SELECT id FROM top UNION SELECT e.b FROM f JOIN e ON e.a = f.id), g(id) AS (SELECT id FROM top UNION SELECT e.a FROM g JOIN e ON e.b = g.id)
    SELECT id, (SELECT id FROM top) AS component FROM (SELECT id FROM f INTERSECT SELECT id FROM g)""")
def g9_largest_component(spark, sf_dir):
    """The strongly connected parts among all followers; every order leads into the one large component."""
    from ..operators import cycles

    member = cycles.components(tables.followers(spark, sf_dir))
    size = member.groupBy("component").agg(F.count("*").alias("n"))
    return member.join(F.broadcast(size.orderBy(F.desc("n"), F.desc("component")).limit(1)), "component").select("id", "component")


@query(_bfs(TRADES, "u", 3) + " SELECT id, depth FROM near")
def g1_bucketed(spark, sf_dir):
    """The neighbourhood of g1 over edges that are kept bucketed by either end."""
    edges = tables.trades(spark, sf_dir)
    return traverse.reach(Adjacency.build(edges), edges.agg(F.min("source_id").alias("id")), 3, "both").nodes


@query(_bfs(EDGES, _OUT, 3) + ", " + _bfs(EDGES, _IN, 3).split("UNION SELECT target_id, source_id FROM edges), ")[1].replace("r(id", "q(id").replace("FROM r", "FROM q").replace("= r.id", "= q.id").replace("near AS", "back AS") + " SELECT id, depth, 'out' AS way FROM near UNION ALL SELECT id, depth, 'in' FROM back")
def g3_bucketed_ways(spark, sf_dir):
    """Callees and callers over the whole graph of followers, by two walks over edges that are kept once."""
    edges = tables.followers(spark, sf_dir)
    kept, root = Adjacency.build(edges), edges.agg(F.min("source_id").alias("id"))
    ways = [traverse.reach(kept, root, 3, way).nodes.withColumn("way", F.lit(way)) for way in ("out", "in")]
    return ways[0].unionByName(ways[1])


@query("""SELECT 'o/' || o_custkey % 100 || '/' || o_custkey || '/' || o_orderkey AS path, CASE WHEN o_custkey % 97 = 0 THEN 'new' ELSE 'changed' END AS status FROM orders WHERE o_custkey % 97 = 0 OR o_orderkey % 500 = 0
    UNION ALL SELECT 'gone/' || o_orderkey, 'gone' FROM orders WHERE o_orderkey % 1000 = 0""")
def t5_stale_below(spark, sf_dir):
    """Every order as a file below its customer's folder: what is new, changed or gone, by digests of folders."""
    o = tables.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("o/"), F.col("o_custkey") % 100, F.lit("/"), "o_custkey", F.lit("/"), "o_orderkey")
    now = o.select(path.alias("path"), F.col("o_orderkey").alias("mtime_ms"), F.col("o_custkey").alias("size"))
    gone = o.filter("o_orderkey % 1000 = 0").select(F.concat(F.lit("gone/"), "o_orderkey").alias("path"), F.lit(1).cast("long").alias("mtime_ms"), F.lit(1).cast("long").alias("size"))
    then = now.filter("size % 97 != 0").withColumn("mtime_ms", F.col("mtime_ms") - (F.col("mtime_ms") % 500 == 0).cast("int")).unionByName(gone)
    return rollup.stale_below(now, then)[0]


@query(f"WITH RECURSIVE {NODES}, {EDGES}, e AS (SELECT source_id, target_id FROM edges WHERE source_line >= 6 AND NOT (type_relation = 'INHERITS' AND target_id LIKE '%3')), r(id) AS (SELECT id FROM nodes WHERE type = 'class' AND is_exported UNION SELECT target_id FROM r JOIN e ON source_id = r.id) SELECT id FROM r")
def g31_maintained_alive(spark, sf_dir):
    """What exported classes lead to along the last steps of orders, kept up to date after some edges went and others came."""
    nodes, edges = tables.part_nodes(spark, sf_dir), written(tables.followers(spark, sf_dir).filter("source_line >= 6"), "last-steps")
    roots, is_gone = nodes.filter("type = 'class' and is_exported"), "type_relation = 'INHERITS' and target_id like '%3'"
    before = maintain.alive(edges.filter("type_relation != 'USES'"), roots)
    return maintain.maintain(before, edges.filter(f"not ({is_gone})"), roots, edges.filter(is_gone), edges.filter("type_relation = 'USES'")).alive
