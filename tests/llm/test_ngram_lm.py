import math
import random
from collections import Counter

import numpy as np
from codeloom.llm import ngram_lm
from codeloom.llm.common import mix, unmix
from pyspark.sql import functions as F


def tokens(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (text or "").split()] + [None]


def discounts(n):
    if min(n[1], n[2]) <= 0:
        return [0, 0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
    return [0, *[min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]]


def brute(train, texts):
    """Plain dictionaries; None is the end, and the context of a first word."""
    count, pair = Counter(), Counter()
    for t in train:
        last = None
        for w in tokens(t):
            count[w] += 1
            pair[last, w] += 1
            last = w
    before = Counter(w for _, w in pair)
    d, e = discounts(Counter(pair.values())), discounts(Counter(before.values()))
    total, size = sum(before.values()), len(count) + 1
    share = sum(e[min(c, 3)] for c in before.values()) / total if total else 1.0
    followers = Counter()
    for (c, _), n in pair.items():
        followers[c] += d[min(n, 3)]
    out = []
    for t in texts:
        base = score = 0.0
        last, w = None, tokens(t)
        for x in w:
            base += math.log10((count[x] + 1) / (sum(count.values()) + size))
            low = max(before[x] - e[min(before[x], 3)], 0) / max(total, 1) + share / size
            score += math.log10((max(pair[last, x] - d[min(pair[last, x], 3)], 0) + followers[last] * low) / count[last] if count[last] else low)
            last = x
        out.append((len(w), sum(count[x] > 0 for x in w), sum(count.values()), base, score))
    return out


def compare(spark, docs, held):
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    got = ngram_lm.score_held_out(df, F.coalesce(F.col("doc_id"), F.lit(1)) % 7 == held).collect()
    assert len(got) == len(docs)
    want = brute([t for i, t, _ in docs if (1 if i is None else i) % 7 != held], [t for _, t, _ in docs])
    key = lambda r: [round(x, 6) for x in r]
    assert sorted(key((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got) == sorted(map(key, want))


def test_matches_dictionaries(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(50)] + ["Été", "THE", "the", "it's"]
    docs = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(vocabulary[: rng.randint(3, 54)]) for _ in range(rng.randint(0, 60))), 0) for i in range(90)]
    compare(spark, docs, 2)
    monkeypatch.setattr(ngram_lm, "RANGE_BYTES", 900)  # many ranges
    monkeypatch.setattr(ngram_lm, "HELD_KEYS", 20)
    compare(spark, docs, 2)


def test_edge_cases(spark):
    compare(spark, [(1, None, 0), (2, "", 0), (3, "a", 0), (3, "a", 0), (None, "b \x0b c", 0), (4, "x" * 100_000 + " y" * 50_000, 0)], 2)
    compare(spark, [(2, "only held out", 0), (9, None, 0)], 2)
    assert ngram_lm.score_held_out(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([("a b a c a b",), ("b b c",), ("a c",)], "text string")
    model = ngram_lm.train(docs)
    words = ["a", "b", "c", "zz"]
    one = {r.text: r.score for r in ngram_lm.score_texts(spark.createDataFrame([(w, w) for w in words], "k string, text string").withColumnRenamed("k", "t2"), model).withColumnRenamed("t2", "text").collect()}
    scorer = ngram_lm.Scorer(model)
    raw = b"aabaczza"
    offsets = np.array([0, 1, 3, 5, 8])
    assert len(one) == 4 and len(scorer.score(np.frombuffer(raw, np.uint8), offsets)["score"]) == 4
    # After "a": the words b, c, a, the end, and the share of the unknown word.
    base = 10 ** scorer.score(np.frombuffer(b"a", np.uint8), np.array([0, 1]))["score"][0]
    first = {}
    for w in (b"a", b"b", b"c", b"zz"):
        text = b"a " + w
        data = np.frombuffer(text, np.uint8)
        end = 10 ** scorer.score(np.frombuffer(w, np.uint8), np.array([0, len(w)]))["score"][0]
        first[w] = 10 ** scorer.score(data, np.array([0, len(text)]))["score"][0] / end
    assert base > 0 and all(v > 0 for v in first.values())


def test_unmix_inverts_mix():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert (unmix(mix(x)) == x).all()
