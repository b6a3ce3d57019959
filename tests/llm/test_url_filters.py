import datetime as dt
import random
import re

from codeloom.llm import url_filters
from pyspark.sql import functions as F

RANK = {"delist": 1, "allow": 2, "block": 3}


def brute(url, at, entries):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)[^/?#]*(?:/([^?#]*))?", url or "")
    if not m or at is None:
        return False, None
    host, path = m[1].lower(), [s.lower() for s in (m[2] or "").split("/") if s]
    best = None
    for p in {e[0].lower() for e in entries if e[0] and e[1] and e[2]}:
        if "/" in p:
            head, *rest = p.split("/")
            met = head == host and path[: len(rest)] == rest
        else:
            met = host == p or host.endswith("." + p)
        past = [(d, RANK[a.lower()]) for q, d, a in entries if q and q.lower() == p and d and a and d <= at]
        if met and past and max(past)[1] > 1 and (best is None or (len(p), p) > best[:2]):
            best = (len(p), p, max(past)[1])
    return (best[2] == 3, best[1]) if best else (False, None)


def check(spark, captures, entries):
    got = url_filters.decide(spark.createDataFrame(captures, "id long, url string, fetched_at date, blocked string"), spark.createDataFrame(entries, "pattern string, listed_at date, action string")).collect()
    assert len(got) == len(captures)
    want = sorted(((i, *brute(u, t, entries)) for i, u, t, _ in captures), key=repr)
    assert sorted(((r.id, r.blocked, r.pattern) for r in got), key=repr) == want


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(700))
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org", "com"]
    entries = [(rng.choice([*hosts, "a.com/p", "b.a.com/p/q", "A.com"]), day(), rng.choice(list(RANK))) for _ in range(40)] + [(None, day(), "block"), ("", day(), "block"), ("x.org", None, "block"), ("x.org", day(), None)]
    captures = [(i, rng.choice(["http://", "https://u:p@"]) + rng.choice(hosts) + rng.choice(["", "/", ":80/p", "/P/q/r?x#y", "//p"]), day(), "k") for i in range(120)]
    check(spark, captures + captures[:3], entries)
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", 0)
    check(spark, captures, entries)


def test_edge_cases(spark):
    t = dt.date(2021, 5, 5)
    captures = [(1, None, t, None), (2, "", t, None), (3, "no url", t, None), (4, "http://a.com", None, None), (5, "http://a.com/" + "x/" * 20_000, t, None), (None, "http://a.com", t, None)]
    check(spark, captures, [("a.com", t, "block"), ("a.com", t, "allow")])
    check(spark, captures, [])
    check(spark, [], [("a.com", t, "block")])


def test_allowed_keeps_columns(spark):
    df = spark.createDataFrame([(1, "http://a.com", "k"), (2, "http://b.com", "k")], "id int, url string, pattern string").withColumn("fetched_at", F.lit("2021-01-01").cast("date"))
    kept = url_filters.allowed(df, spark.createDataFrame([("a.com", dt.date(2020, 1, 1), "block")], "pattern string, listed_at date, action string"))
    assert kept.columns == df.columns and [r.id for r in kept.collect()] == [2]


def test_a_slash_at_the_end_of_a_pattern_means_nothing(spark):
    entries = [("a.com/en/", dt.date(2020, 1, 1), "block"), ("b.com//", dt.date(2020, 1, 1), "block"), ("/", dt.date(2020, 1, 1), "block")]
    captures = [(1, "http://a.com/en/x", dt.date(2021, 1, 1), ""), (2, "http://b.com/y", dt.date(2021, 1, 1), ""), (3, "http://c.com/", dt.date(2021, 1, 1), "")]
    got = url_filters.decide(spark.createDataFrame(captures, "id long, url string, fetched_at date, text string"), spark.createDataFrame(entries, "pattern string, listed_at date, action string"))
    assert {r.id: (r.blocked, r.pattern) for r in got.collect()} == {1: (True, "a.com/en"), 2: (True, "b.com"), 3: (False, None)}
