import hashlib
import random
import zlib

import numpy as np
from codeloom.llm import media, quality, toxicity
from codeloom.llm.common import text_bytes


def labelled(spark, good, bad, n=240):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        y = i % 2
        docs.append((i, " ".join((good if y else bad)(rng) for _ in range(40)), "x"))
        labels.append((i, y, y))
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, "word", "x"), (0, docs[0][1], "x"), (n + 2, "long " * 60_000, "x")]
    labels += [(None, 1, 1), (n, None, None), (1, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def check_scores(spark, module, docs, labels):
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in got)
    held = {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id < 240 and r.held_out}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % module.MODULUS == module.HELD_OUT) for r in got if r.doc_id is not None)
    assert np.mean([i % 2 == p for i, p in held.items()]) > 0.95
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    none = module.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert module.classify(docs.limit(0), labels).count() == 0


def test_quality_separates_held_out_rows(spark):
    docs, labels = labelled(spark, lambda r: f"plain{r.randrange(90)}", lambda r: r.choice(["BUY!!!", "$$$", "1234"]))
    check_scores(spark, quality, docs, labels)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_toxicity_separates_held_out_rows(spark):
    check_scores(spark, toxicity, *labelled(spark, lambda r: r.choice(["vile", "hateful", f"w{r.randrange(50)}"]), lambda r: f"w{r.randrange(50)}"))


def test_trees_match_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    trees = quality.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), n_trees=9, depth=3)
    for row, score in zip(x[:40], quality.predict(trees, x[:40]), strict=True):
        margin = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            margin += float(leaf[node - 7])
        assert abs(1 / (1 + np.exp(-margin)) - score) < 1e-9


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 100_000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "'k' AS feature")
    stored = media.encode_wav(docs)
    payloads = {r.doc_id: media.from_wav(bytes(r.media)) for r in stored.collect()}
    got = {r.doc_id: r for r in media.spectral_landmarks(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert payloads[i] == padded and (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.landmarks == sorted(r.landmarks)
    assert got[2].feature == got[6].feature and got[0].feature == got[1].feature
    assert media.spectral_landmarks(media.encode_wav(docs.limit(0))).count() == 0


def test_the_last_block_is_in_a_frame():
    rng = np.random.default_rng(2)
    for blocks in range(1, 14):
        payload = rng.integers(0, 256, 64 * blocks, np.uint8).tobytes()
        frames = media.frames_of(payload)
        put = np.zeros(128 * len(frames) + 128, np.float32)
        for i, f in enumerate(frames):
            put[128 * i : 128 * i + 256] = f
        assert np.array_equal(put[: len(payload)], np.frombuffer(payload, np.uint8).astype(np.float32) - 128) and not put[len(payload) :].any()
        assert len(frames) == max(1, -(-(len(payload) - 128) // 128))
    tone = lambda cycles: (128 + 100 * np.sin(2 * np.pi * cycles * np.arange(64) / 64)).astype(np.uint8).tobytes()
    for blocks in range(4, 10):
        silence = bytes([128]) * 64 * blocks
        assert media.landmarks(silence + tone(16)).tolist() != media.landmarks(silence + tone(24)).tolist()


def test_statistics_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["One two TWO!", "", "a b a b", "x" * 10]
    whole = quality.statistics(*text_bytes(pa.array(texts)))
    assert all(np.array_equal(whole[i : i + 1], quality.statistics(*text_bytes(pa.array([t])))) for i, t in enumerate(texts))
