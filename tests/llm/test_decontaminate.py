import hashlib
import random
import re

from codeloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    w, hit, met = split(text), set(), set()
    for i, t in items:
        v = split(t)
        for s in range(max(1, len(v) - window + 1) if v else 0):
            part = v[s : s + window]
            for at in range(len(w) - len(part) + 1):
                if w[at : at + len(part)] == part:
                    hit.update(range(at, at + len(part)))
                    met.add(str(i))
    return len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def compare(spark, docs, items, **options):
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = d.contamination(d.find_matches(df, bench, **options)).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(texts[r.doc_id], items), r


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 12, 13, 14, 30]))) for i in range(30)] + [(None, ""), (5, None), (40, "lone")]
    docs = []
    for i in range(80):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [", ".join(w[a : a + rng.randint(5, 30)]).upper(), text(rng.randint(0, 5))]
        docs.append((i, "\n".join(parts)))
    compare(spark, docs, items)
    compare(spark, docs, items, block_words=60)


def test_edge_cases(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = [(1, None), (2, ""), (3, "!?"), (4, item), (5, "z " * 50_000 + item), (6, item), (6, item), (7, item.replace("t6", "u")), (8, (item + " ") * 3)]
    compare(spark, docs, [(1, item), (1, item), (2, "only two")])
    compare(spark, docs, [])
    assert d.find_matches(spark.createDataFrame([], "doc_id long, text string, matches int"), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0


def test_proximity(spark):
    item = " ".join(f"t{i}" for i in range(13))
    swapped = item.replace("t4 t5", "t5 t4")
    docs = [(1, "a b " + swapped + " c"), (2, item), (3, " ".join(f"t{i}" for i in range(6)))]
    got = d.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"), slop=1)
    kinds = {r.doc_id: {m.kind for m in r.matches} for r in got.collect()}
    assert kinds == {1: {"proximity"}, 2: {"phrase", "proximity"}, 3: set()}


def brute_places(text, items, slop, window=13):
    w, found = split(text), set()
    for i, t in items:
        v = split(t)
        for s in range(max(1, len(v) - window + 1) if v else 0):
            part = v[s : s + window]
            for at in range(-len(part), len(w) + 1):
                near = sum(any(0 <= at + k + x < len(w) and w[at + k + x] == word for x in range(-slop, slop + 1)) for k, word in enumerate(part))
                ends = (max(0, at), min(len(w), at + len(part)), str(i))
                if 10 * near >= 8 * len(part):
                    found.add((*ends, "proximity"))
                if w[max(0, at) : at + len(part)] == part and at >= 0:
                    found.add((*ends, "phrase"))
    return found


def test_proximity_matches_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(n))) for i, n in enumerate([13, 13, 16, 20, 5, 3])]
    items += [(10, "rare1 " + " ".join(f"c{i}" for i in range(12))), (11, "rare2 rare3 " + " ".join(f"e{i}" for i in range(11)))]
    docs = [(0, items[6][1].replace("rare1", "other")), (1, items[7][1].replace("rare2", "x").replace("rare3", "y")), (2, "rare2 z z rare3")]
    for i in range(3, 60):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 4)):
            kind, at = rng.randrange(3), rng.randrange(len(w))
            w[at : at + 1] = [["new"], [], [w[at], "more"]][kind]
            w = w or ["none"]
        docs.append((i, " ".join([f"w{rng.randrange(30)}" for _ in range(rng.randrange(5))] + w)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slop in (1, 2):
        got = {r.doc_id: {tuple(m) for m in r.matches} for r in d.find_matches(df, bench, slop=slop).collect()}
        assert got == {i: brute_places(t, items, slop) for i, t in docs}
        assert got[0] and got[1]


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    item = " ".join(f"t{i}" for i in range(13))
    docs = spark.createDataFrame([(1, item, 1), (2, "clean text", 2), (None, None, 3)], "doc_id long, text string, n_words int")
    kept = d.decontaminate(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.n_words for r in kept.collect()) == [2, 3]
