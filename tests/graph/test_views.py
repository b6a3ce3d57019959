from codeloom.functions import compact
from codeloom.operators import cycles, relational, reports, symbols
from codeloom.sources import tables
from pyspark.sql import functions as F


def test_compact_lines_round_trip(spark):
    rows = [("a,b|[c]\\", 1, 1.5, True, ["x,y", "p|q", "\\"]), (None, None, None, None, []), ("\\,", -2, 0.0, False, ["one"])]
    df = spark.createDataFrame(rows, "s string, n long, d double, b boolean, l array<string>")
    lines = compact.encode(df)
    assert {r.line for r in lines.collect()} == {r"[a\,b\|\[c\]\\,1,1.5,true,x\,y|p\|q|\\]", "[,,,,]", r"[\\\,,-2,0.0,false,one]"}
    back = {(r.s, r.n, r.d, r.b, tuple(r.l)) for r in compact.decode(lines, df.schema).collect()}
    assert back == {(s or "", n, d, b, tuple(x)) for s, n, d, b, x in rows}
    assert compact.header(df, "rows") == "rows(s,n,d,b,l)"
    assert spark.range(1).select(compact.saving(F.lit("x" * 125), F.lit("y" * 48)).alias("v")).first().v == 62.5


def test_cycle_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("x", "a"), ("c", "b")], "source_id string, target_id string")
    got = {tuple(r.cycle) for r in cycles.cycle_paths(e, 3).collect()}
    assert got == {("a", "b", "a"), ("b", "c", "b"), ("a", "b", "c", "a"), ("d", "d")}
    assert {r.size for r in cycles.cycles_through(e, "c", 3).collect()} == {2, 3}
    assert cycles.cycle_paths(e.limit(0), 4).count() == 0


def test_cycle_paths_of_ranks_by_either_way_of_names(spark):
    """Half paths hold numbers and no ids; cycles get their ids by a broadcast or a join, in the ids' own order."""
    from unittest import mock

    ids = [f"s{n}" for n in (1, 10, 2, 30, 4, 500, 6)]
    pairs = [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if (i * 3 + j * 5) % 4 < 2] + [("x", "s1"), ("s4", "y")]
    want = set()

    def walk(way):
        for a, b in pairs:
            if a == way[-1] and b == way[0]:
                want.add((*way, b))
            elif a == way[-1] and b > way[0] and b not in way and len(way) < 5:
                walk([*way, b])

    for i in ids:
        walk([i])
    e = spark.createDataFrame(pairs, "source_id string, target_id string")
    types = {}

    def keep(df, name, written=cycles.written):
        types[name] = df.schema
        return written(df, name)

    for most in (100, 0):
        with mock.patch.object(cycles, "BROADCAST_ROWS", most), mock.patch.object(cycles, "written", keep):
            rows = cycles.cycle_paths(e, 5).collect()
        assert len(rows) == len(want) and {tuple(r.cycle) for r in rows} == want and all(len(r.cycle) == r.size + 1 for r in rows)
        assert all(f.dataType.simpleString() in ("int", "array<int>") for f in types["half-paths"])
    assert [r.size for r in cycles.cycle_paths(e, 1).collect()] == [1] * sum(a == b for a, b in pairs)


def test_usage_defaults_to_used(spark):
    e = spark.createDataFrame([("a.py", "b.py"), ("a.py", "c.py"), ("x.go", "y.go")], "source_path string, target_path string")
    links = spark.createDataFrame([("a.py:f", "b.py:g", "a.py", "b.py", False)], "source_symbol_id string, target_symbol_id string, source_file string, target_file string, is_type_only boolean")
    langs = spark.createDataFrame([("a.py", "python"), ("x.go", "go")], "path string, lang string")
    assert {(r.target_path, r.used) for r in symbols.verify_usage(e, links, langs).collect()} == {("b.py", True), ("c.py", False), ("y.go", True)}


def test_staleness_and_empty_index(spark):
    schema = "path string, mtime_ms long, size long"
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", None, 1), ("d", 4, 4)], schema)
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", None, 1)], schema)
    r = reports.staleness(old, new).first()
    assert (r.files, r.missing, r.stale, r.share, r.is_valid) == (4, 1, 1, 0.5, False)
    r = reports.staleness(old.limit(0), new).first()
    assert (r.files, r.share, r.is_valid) == (0, 0.0, True)


def test_ranks_follow_a_global_order(spark):
    got = relational.ranked(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7), "v").collect()
    assert all(r["rank"] == r.v + 1 for r in got) and len(got) == 1000


def test_usual_followers_read_lines_once(spark, tmp_path):
    """Ties of a supplier's commonest followers are kept, and lines are neither read nor shuffled again for their largest count."""
    rows = [(o, n, s, s, "2024-01-01", "A") for o, line in enumerate([(1, 2, 1), (1, 2), (1, 3, 2), (1, 3), (4,)]) for n, s in enumerate(line)]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_returnflag string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    usual = tables.usual_followers(spark, str(tmp_path))
    assert {(r.source_id, r.target_id) for r in usual.collect()} == {("s1", "s2"), ("s1", "s3"), ("s2", "s1"), ("s3", "s2")}
    assert usual._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") == 1
