"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from codeloom.plans import queries, stores, streams, tools, views, workspace_tools

FOLDER = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()
MODULES = (stores, tools, streams, views, workspace_tools)
NAMES = [n for n in SQL if any(hasattr(m, n) and getattr(m, n).__module__ == m.__name__ for m in MODULES)] + ["g1_neighbourhood", "g9_cycle_edges", "g19_unused_exports", "g23_communities", "j8_best_match", "j9_module_resolution", "x15_signature_changes", "o1_page_edges"]


CASES = queries.examples()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("the tables are not here")
    db = duckdb.connect()
    for name in os.listdir(FOLDER):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return db


@pytest.mark.parametrize("name", [*NAMES, *CASES])
def test_rows_equal_those_of_sql(spark, duck, name):
    query, sql = CASES[name] if name in CASES else (queries.queries()[name], SQL[name])
    found, want = query(spark, FOLDER), duck.sql(sql)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    assert mine == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
