"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, media, mixing, ngram_lm, odd_sketch, prefix_trie, quality, secrets, simhash, spelling, toxicity, url_filters
from .common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(text: Column, start: int = 1) -> Column:
    """A number below 2 ** 28 from a text's MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), start, 7), 16, 10).cast("long")


def _day(number: Column) -> Column:
    return F.date_add(F.lit("2020-01-01").cast("date"), number.cast("int"))


def url_lists(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of all pages, as the tables hold none.

    A third of the hosts are blocked on some day, half of those are delisted later, their parent domains
    are blocked for a while, and a fifth of all hosts have one path allowed.
    """
    hosts = pages.select(url_filters.host(F.col("url")).alias("h")).filter("h != ''").distinct().withColumn("n", _number(F.col("h")))
    parent = F.regexp_replace("h", r"^[^.]+\.", "")
    rows = [
        (F.col("n") % 3 == 0, F.col("h"), F.floor(F.col("n") / 3) % 900, "block"),
        (F.col("n") % 6 == 0, F.col("h"), 900 + F.floor(F.col("n") / 3) % 400, "delist"),
        (F.col("n") % 7 == 0, parent, F.floor(F.col("n") / 7) % 700, "block"),
        (F.col("n") % 14 == 0, parent, 800 + F.floor(F.col("n") / 14) % 300, "delist"),
        (F.col("n") % 5 == 0, F.concat("h", F.lit("/en")), F.floor(F.col("n") / 5) % 1000, "allow"),
    ]
    made = F.array(*[F.when(used, F.struct(pattern.alias("pattern"), _day(day).alias("listed_at"), F.lit(action).alias("action"))) for used, pattern, day, action in rows])
    return hosts.select(F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("e.*")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list in force on the day it was fetched, a day made from its url."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _day(_number(F.coalesce("url", F.lit(""))) % 1500))
    return url_filters.decide(captures, url_lists(pages))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_held_out(_table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 7) == 2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = decontaminate.find_matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(matched).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mixture with sources weighted by the square root of their size."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_wav(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.spectral_landmarks(stored)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.vocabulary(_table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.number_turns(_table(spark, sf_dir, "conversations"))))


def op13_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_ngram_lm, op3_toxicity, op4_secrets, op5_decontaminate, op6_mixing, op7_simhash, op8_line_dedup, op9_quality, op10_media, op11_spelling, op12_prefix_trie, op13_odd_sketch)}


URL_FILTERS_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2020-01-01' + CAST(CAST('0x' || substr(md5(coalesce(url, '')), 1, 7) AS BIGINT) % 1500 AS INTEGER) AS fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS h,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#/]*)', 1) AS seg FROM pages),
hosts AS (SELECT h, CAST('0x' || substr(md5(h), 1, 7) AS BIGINT) AS n, regexp_replace(h, '^[^.]+\.', '') AS up FROM (SELECT DISTINCT h FROM p WHERE h <> '')),
entries AS (
    SELECT h AS pattern, n // 3 % 900 AS day, 3 AS rank FROM hosts WHERE n % 3 = 0
    UNION ALL SELECT h, 900 + n // 3 % 400, 1 FROM hosts WHERE n % 6 = 0
    UNION ALL SELECT up, n // 7 % 700, 3 FROM hosts WHERE n % 7 = 0
    UNION ALL SELECT up, 800 + n // 14 % 300, 1 FROM hosts WHERE n % 14 = 0
    UNION ALL SELECT h || '/en', n // 5 % 1000, 2 FROM hosts WHERE n % 5 = 0),
dated AS (SELECT pattern, DATE '2020-01-01' + CAST(day AS INTEGER) AS since, max(rank) AS rank FROM entries GROUP BY ALL),
intervals AS (SELECT pattern, since, rank, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM dated),
met AS (SELECT p.page_id, p.url, p.fetched_at, i.pattern, i.since, i.rank,
        row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(i.pattern) DESC, i.pattern DESC) AS k
    FROM p JOIN intervals i ON (h = i.pattern OR ends_with(h, '.' || i.pattern) OR lower(h || '/' || seg) = i.pattern)
        AND fetched_at >= since AND (until IS NULL OR fetched_at < until) AND rank > 1)
SELECT p.page_id, p.url, p.fetched_at, coalesce(m.rank = 3, false) AS blocked, m.pattern, m.since AS listed_at
FROM p LEFT JOIN met m ON p.page_id = m.page_id AND p.url = m.url AND m.k = 1
"""


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents), b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS said
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 13) AS n FROM b WHERE len(w) > 0))),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
met AS (SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, said)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(named, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LINE_DEDUP_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
w AS (SELECT doc_id, n, line, list_filter(string_split(replace(line, chr(9), ' '), ' '), lambda x: x <> '') AS ws, row_number() OVER (ORDER BY doc_id, n) AS r FROM l),
f AS (SELECT ws, min(r) AS r FROM w WHERE len(ws) >= 1 GROUP BY ws),
halves AS (SELECT r, ws, unnest([0, 1]) AS more FROM f WHERE len(ws) >= 5),
keys AS (SELECT r, ws, len(ws) + more AS n, 'first' AS side, ws[1:(len(ws) + more - 1) // 2] AS half FROM halves
    UNION ALL SELECT r, ws, len(ws) + more, 'last', ws[len(ws) - (len(ws) + more - 1) // 2 + 1:] FROM halves),
pairs AS (SELECT DISTINCT a.r, a.ws AS x, b.ws AS y, least(len(a.ws), len(b.ws)) AS low, greatest(len(a.ws), len(b.ws)) AS high FROM keys a JOIN keys b USING (n, side, half) WHERE b.r < a.r),
agree AS (SELECT r, low, high, coalesce(list_position(list_transform(range(1, low + 1), lambda i: x[i] <> y[i]), true) - 1, low) AS head,
    coalesce(list_position(list_transform(range(1, low + 1), lambda i: x[-i] <> y[-i]), true) - 1, low) AS tail FROM pairs),
near AS (SELECT DISTINCT r FROM agree WHERE high - low <= 1 AND least(head + tail, low) >= high - 1),
judged AS (SELECT w.*, f.r IS NOT NULL AND (w.r <> f.r OR near.r IS NOT NULL) AS gone FROM w LEFT JOIN f ON w.ws = f.ws LEFT JOIN near ON near.r = f.r),
rest AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS lines_removed FROM judged GROUP BY doc_id)
SELECT d.doc_id, rest.text, coalesce(lines_removed, 0) AS lines_removed FROM documents d LEFT JOIN rest USING (doc_id)
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32_sql(text: str) -> str:
    """CRC32 of a text of code points up to U+00FF, four bits at a time."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    bits = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c) & 15, unicode(c) >> 4] ELSE [3, 12, (unicode(c) - 64) & 15, (unicode(c) - 64) >> 4] END))".format(text)
    return f"xor(list_reduce({bits}::BIGINT[], lambda a, b: xor(a >> 4, CAST({table} AS BIGINT[])[xor(a & 15, b) + 1]), 4294967295), 4294967295)"


_RUNS = r"unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}'))"
SPELLING_SQL = rf"""
WITH RECURSIVE runs AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_LOWER.format(_RUNS)} AS run FROM documents),
k AS (SELECT id, run, count(*) AS k FROM runs GROUP BY ALL), h AS (SELECT run, k, {_crc32_sql("id || ':' || run")} AS h FROM k),
said AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
    UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON rest = w.word UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON rest = w.word),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
judged AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word AND place = 1),
chain AS (SELECT word, word AS root FROM judged UNION ALL SELECT chain.word, form FROM chain JOIN judged ON root = judged.word WHERE form IS NOT NULL)
SELECT judged.*, root FROM judged JOIN chain USING (word) WHERE NOT EXISTS (SELECT 1 FROM judged up WHERE up.word = root AND up.form IS NOT NULL)
"""

PREFIX_TRIE_SQL = f"""
WITH t AS (SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (SELECT c.conv_id, 0 AS part, p, said, bytes FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND p <= h UNION ALL SELECT c.conv_id, 1, p, said, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
s AS (SELECT conv_id, said, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d FROM rebuilt),
pre AS MATERIALIZED (SELECT conv_id, d, bytes, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS MATERIALIZED (SELECT d, k, min(conv_id) AS owner, count(*) AS n, max(bytes) AS bytes FROM pre GROUP BY d, k),
o AS MATERIALIZED (SELECT pre.conv_id, d, owner FROM pre JOIN m USING (d, k)),
tree AS MATERIALIZED (SELECT m.owner, m.d, n, bytes, above.owner AS up, (SELECT count(*) FROM m x JOIN o y ON y.conv_id = x.owner AND y.d = x.d - 1 WHERE y.owner = m.owner AND y.d = m.d) AS kids
    FROM m LEFT JOIN o above ON above.conv_id = m.owner AND above.d = m.d - 1),
sums AS (SELECT o.owner, o.d, sum((n - 1) * bytes) AS saved, count(*) FILTER (kids = 0) AS leaves FROM tree JOIN o ON o.conv_id = tree.owner AND o.d <= tree.d GROUP BY ALL),
ends AS (SELECT owner, d, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM o QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY ALL)
SELECT tree.owner AS conv_id, tree.d AS depth, up AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM tree JOIN sums USING (owner, d) LEFT JOIN ends USING (owner, d)
"""

ODD_SKETCH_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^ 	-
]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": URL_FILTERS_SQL, "op5_decontaminate": DECONTAMINATE_SQL, "op8_line_dedup": LINE_DEDUP_SQL,
        "op11_spelling": SPELLING_SQL, "op12_prefix_trie": PREFIX_TRIE_SQL, "op13_odd_sketch": ODD_SKETCH_SQL,
    }
