"""The token index against a plain look through all names; what a search reads and what an update writes."""

import os
import tempfile

from codeloom.sources.token_index import TokenIndex

NAMES = [("1", "readFile", "a"), ("2", "read_all-files", "a"), ("3", "Writer", "b"), ("4", "reader", "b"), ("5", "x", "c"), ("6", None, "c"), ("7", "éclat_ère", "d"), ("8", "reads/%2=odd", "d")]


def rows(spark, names):
    return spark.createDataFrame(names, "id string, name string, path string")


def scores(index, *keywords):
    return {r.id: r.score for r in index.scores(list(keywords), None, None).collect()}


def files_of(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_searches_updates_and_what_they_touch(spark):
    folder = tempfile.mkdtemp()
    index = TokenIndex(spark, folder)
    index.build(rows(spark, NAMES))
    assert scores(index, "read") == {"1": 1, "2": 1, "4": 1, "8": 1}
    assert scores(index, "read fil", "wri", "é") == {"1": 1, "2": 1, "3": 1, "7": 1}
    assert scores(index, "r") == {"1": 1, "2": 1, "4": 1, "8": 1}
    assert scores(index) == {} and scores(index, "") == {}
    assert [(r.id, r.score) for r in index.scores(["read", "file"], 50, 1).collect()] == [("1", 2)]
    plan = index.postings(["read"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "StringStartsWith(token,read)" in plan
    assert {f.rsplit("/", 2)[1] for f in map(str, index.postings(["read"]).inputFiles()) if "postings" in f} >= {"head=7265"}

    before = files_of(folder)
    path = spark.createDataFrame([("b",)], "path string")
    assert index.update(1, path, rows(spark, [("3", "lister", "b"), ("9", "other", "elsewhere")]))
    assert not index.update(1, path, rows(spark, []))
    assert scores(index, "read", "writ", "list", "other") == {"1": 1, "2": 1, "3": 1, "8": 1}
    after = files_of(folder)
    assert all(after[f] == t for f, t in before.items())
    new = [f for f in after if f not in before and "/postings/" in f]
    assert len(new) == 1 and "head=6C69" in new[0]


def test_an_empty_table(spark):
    index = TokenIndex(spark, tempfile.mkdtemp())
    index.build(rows(spark, []))
    assert scores(index, "a") == {}
