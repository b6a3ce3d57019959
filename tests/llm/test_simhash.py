import random

import xxhash
from codeloom.llm import odd_sketch, simhash


def fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "\x00").split() if text else []
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def corpus(rng):
    text = lambda n: [f"w{rng.randrange(30)}" for _ in range(n)]
    docs = [text(rng.choice([1, 2, 3, 200, 400])) for _ in range(30)]
    out = [" ".join(d) for d in docs]
    for d in docs:
        near = list(d)
        near[rng.randrange(len(near))] = "new"
        out += [" ".join(near), " ".join(d).upper()]
    return [*out, None, "", " \n"]


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_matches_brute_force(spark):
    texts = corpus(random.Random(6))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [fingerprint(t) for t in texts]
    want = {i: (f"{fps[i]:016x}", c) for i, c in enumerate(groups(fps))}
    for crowd in (1, 32):
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, crowd=crowd).collect()} == want


def edited(rng, words, share):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = f"e{rng.randrange(10**6)}"
    return out


def test_keep_one_matches_brute_force_similarity(spark, monkeypatch):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (4, 60, 300, 300, 800)]
    texts = [" ".join(edited(rng, b, share)) for b in base for share in (0, 0, 0.01, 0.01, 0.015, 0.02, 0.2)]
    # A large group around one text, most members of which are less alike among themselves.
    texts += [" ".join(edited(rng, base[3], rng.choice([0.01, 0.02, 0.025]))) for _ in range(60)] + [None, "", " ", "W1 w2", "w1  w2"]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {find(i) for i in range(len(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs, bands=24).collect()} == want
    assert len({r.doc_id for r in simhash.keep_one(docs).collect()} ^ want) <= 2


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from codeloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k, i) for k in range(9) for i in range(2 * k)], "k int, i int")
    side = spark.createDataFrame([(k, f"s{k}") for k in range(1, 8)], "k int, s string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = common.join_by_key(rows, side, ["k"], how, most=-1)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(side, "k", how).collect()))


def test_a_hundred_thousand_fingerprints_on_one_key(spark):
    from pyspark.sql import functions as F

    # All agree on their upper half, and every thousandth has a neighbour two bits away.
    fps = spark.range(100_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("_fp"))
    fps = fps.union(fps.filter("_fp % 1000 = 0").select(F.col("_fp").bitwiseXOR(F.lit(3 << 20)))).distinct()
    got = {frozenset(r) for r in simhash.fingerprint_links(fps).collect()}
    all_ = [r[0] for r in fps.collect()]
    known = set(all_)
    masks = [1 << i for i in range(32)] + [1 << i | 1 << j for i in range(32) for j in range(i)]
    want = {frozenset((f, f ^ m)) for f in all_ for m in masks if f ^ m in known}
    assert got == want


def test_links_of_close_fingerprints(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r._fp: r._class for r in simhash.classes(spark.createDataFrame([(f,) for f in signed], "_fp long"), crowd=4).collect()}
    mine = groups(fps)
    pairs = {}
    for f, g in zip(signed, mine, strict=True):
        assert pairs.setdefault(g, got[f]) == got[f]
    assert len(set(got.values())) == len(set(mine))


def test_edge_cases(spark):
    schema = "doc_id long, text string, fingerprint int, `odd name` string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b", 1, "k"), (1, "a b", 1, "k"), (None, "a b", 1, "k"), (None, "zz", 1, "k"), (5, "x " * 50_000, 1, "k")]
    df = spark.createDataFrame(rows, schema)
    assert simhash.near_duplicates(df).count() == 5
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "None"]


def components(texts):
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return {top(i) for i in range(len(texts))}


def kept(spark, texts):
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_keep_one_finds_pairs_without_a_common_band(spark):
    # Pairs of 60 shingles whose similarity is 54 / 66: ten bands of four minima miss one in some 400 on average.
    rng, texts = random.Random(11), []
    for _ in range(700):
        w = [f"w{rng.randrange(10**6)}" for _ in range(70)]
        texts += [" ".join(w[:64]), " ".join(w[6:])]
    assert kept(spark, texts) == {2 * i for i in range(700)}


def test_keep_one_links_texts_that_resemble_no_hub_of_a_crowded_band(spark):
    # All share the least shingles by far, so bands are crowded, but link along a chain: no hub is like more than a few.
    rng = random.Random(12)
    w = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    texts = [" ".join(w[at : at + 204]) for at in range(0, 480, 2) if at % 96 < 80]
    texts += [t for t in texts for t in (t + " z", "y " + t)]
    rng.shuffle(texts)
    assert kept(spark, texts) == components(texts)


def test_keep_one_counts_repeated_shingles_once(spark):
    # Equal sets, though one shingle is repeated so often that it alone decides the majority of all.
    w = " ".join(f"w{i}" for i in range(30))
    assert kept(spark, [w + " a b a b a b a b", w + " a b a b a b a b" + " a b" * 200, "p q r", "P  q\tr"]) == {0, 2}


def test_keep_one_joins_the_sets_of_asked_pairs_alone(spark, monkeypatch):
    asked, own = [], odd_sketch.join_by_key

    def counted(rows, side, keys, *args, **named):
        if "_a" in side.columns and keys == ["src"]:
            asked.append(side.count())
        return own(rows, side, keys, *args, **named)

    def two_rounds(texts, marked, sets, share):
        t = [r._t for r in texts.collect()]
        for pairs in ([t[0:2], t[2:4], t[4:6]], [t[1:3]]):
            sets.confirm(spark.createDataFrame([tuple(p) for p in pairs], "src binary, dst binary"), 80.0)
        return spark.createDataFrame([], "id binary, component binary")

    monkeypatch.setattr(odd_sketch, "join_by_key", counted)
    monkeypatch.setattr(simhash, "similar_components", two_rounds)
    assert len(kept(spark, [f"text number{i} of six" for i in range(6)])) == 6
    assert asked == [6, 2]


def test_a_passage_of_many_long_texts_locates_no_pairs(spark, monkeypatch):
    # Long texts that share a passage and no more, too long for their parities to tell them apart; a few have a near copy.
    rng, met, own = random.Random(14), [], simhash._met
    passage = [f"p{i}" for i in range(60)]
    base = [[f"w{rng.randrange(10**6)}" for _ in range(1500)] + passage for _ in range(60)]
    texts = [" ".join(w) for w in base] + [" ".join(w[40 * i :] + ["z"]) for i, w in enumerate(base[:9])]

    def counted(*args):
        found = own(*args)
        met.append(found.select("src", "dst").distinct().count())
        return found

    monkeypatch.setattr(simhash, "_met", counted)
    assert kept(spark, texts) == components(texts)
    assert sum(met) < len(texts)


def test_frequent_keys_left_out_lose_no_pair(spark, monkeypatch):
    # Texts of every size up to where several keys can be spared, alike at 0.8 or just below it, whose common parts are the most frequent.
    rng, texts = random.Random(15), []
    for n in (6, 30, 45, 55, 90, 130, 250):
        core = [f"c{n}.{rng.randrange(10**6)}" for _ in range(n)]
        for share in (0.05, 0.1, 0.11, 0.12, 0.125):
            a, b = ([f"w{rng.randrange(10**6)}" for _ in range(round(n * share))] for _ in range(2))
            texts += [" ".join(core + a), " ".join(b + core)]
    rng.shuffle(texts)
    # Without hubs, so that every link is found by prefixes.
    monkeypatch.setattr(simhash, "_hub_pairs", lambda texts, share: spark.createDataFrame([], "src binary, dst binary"))
    assert kept(spark, texts) == components(texts)
