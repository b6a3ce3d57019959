import random

from codeloom.llm.components import connected_components, merged


def _plain(links):
    least = {}
    for a, b in links:
        low, ends = min(least.get(a, a), least.get(b, b)), (least.get(a, a), least.get(b, b))
        least |= {a: low, b: low} | {k: low for k, v in least.items() if v in ends}
    return least


def _labels(df):
    rows = df.select("id", "component").collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["component"] for r in rows}


def test_links_added_later_give_the_components_of_all_links(spark):
    draw = random.Random(5)
    # Chains, a hub, and links that tie earlier components, repeat, are loops or join new ends.
    first = [(i, i + 1) for i in range(10, 40) if i % 6] + [(100, i) for i in range(101, 160)]
    later = [tuple(sorted((draw.randrange(10, 40), draw.randrange(10, 40)))) for _ in range(4)] + [(15, 100), (15, 100), (7, 8), (3, 160), (20, 20)]
    later = [(a, b) for a, b in later if a != b] + [(7, 7)]
    frame = lambda links: spark.createDataFrame(links, "src long, dst long")
    before = connected_components(frame(first))
    assert _labels(before) == _plain(first)
    assert _labels(merged(before, frame(later))) == _plain([*first, *later])


def test_nothing_added_and_nothing_before(spark):
    none = spark.createDataFrame([], "src long, dst long")
    labels = connected_components(none)
    assert _labels(labels) == {}
    assert _labels(merged(labels, spark.createDataFrame([(2, 1)], "src long, dst long"))) == {1: 1, 2: 1}
    assert _labels(merged(connected_components(spark.createDataFrame([(2, 1)], "src long, dst long")), none)) == {1: 1, 2: 1}
