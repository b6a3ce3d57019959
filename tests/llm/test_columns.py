"""Names of the operators' own columns as further columns of the input: none may clash, and all come out as they went in."""

import glob
import os
import re

import pytest
from codeloom.llm import common, decontaminate, line_dedup, media, mixing, ngram_lm, odd_sketch, prefix_trie, quality, secrets, simhash, spelling, toxicity, url_filters
from pyspark.sql import functions as F

FOLDER = os.path.dirname(common.__file__)
#: Every quoted name with an underscore in front, and plain names that are used as internal columns.
NAMES = sorted(
    {n for p in glob.glob(f"{FOLDER}/*.py") for n in re.findall(r"""["'](_[a-z][a-z0-9_]*)["']""", open(p).read())}
    | {"action", "kinds", "key", "rank", "at", "n", "u", "v", "m", "span", "places", "matches_", "number", "slot", "units", "weight", "hubs", "src", "dst", "trigram", "kind", "size", "term", "any", "full", "w", "least", "id", "line", "status"}
)
TEXTS = ["one two three four five\nsix seven eight nine ten\npassword = abcdefgh12", "one two three four five\nsix seven eight nine ten", None, "", "zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t, "en", "ab"[i % 2], i) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")


def intact(found, kept=None):
    assert set(NAMES) <= set(found.columns)
    rows = found.select("doc_id", *NAMES).collect()
    assert (len(rows) == 10 if kept is None else kept(len(rows))) and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in NAMES)


def test_operators(spark, docs, labels):
    test = spark.createDataFrame([(1, TEXTS[4])], "item_id long, text string")
    entries = spark.createDataFrame([("a.com", "2020-01-01", "block")], "pattern string, listed_at string, action string").withColumn("listed_at", F.to_date("listed_at"))
    captures = docs.withColumns({"url": F.concat(F.lit("http://a.com/"), "doc_id"), "fetched_at": F.lit("2021-01-01").cast("date")})
    blocked = url_filters.decide(captures, entries)
    intact(blocked)
    assert blocked.filter("blocked").count() == 10 and url_filters.allowed(captures, entries).count() == 0
    intact(ngram_lm.score_held_out(docs, F.col("doc_id") % 3 == 0))
    intact(toxicity.score_toxicity(docs, toxicity.train(docs, labels)))
    intact(secrets.scan(docs))
    intact(decontaminate.find_matches(docs, test))
    intact(mixing.mix_sources(docs))
    intact(simhash.near_duplicates(docs))
    intact(odd_sketch.near_duplicates(docs))
    assert spelling.group_variants(spelling.vocabulary(docs, least_count=1)).count() > 5
    turns = docs.withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(1), "role": F.lit("user")})
    assert prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.number_turns(turns))).count() > 1
    intact(line_dedup.dedup_lines(docs, min_words=1))
    intact(quality.score_quality(docs, quality.train(docs, labels)))
    intact(media.spectral_landmarks(media.encode_wav(docs)))


def test_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, TEXTS[4])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        intact(found, lambda n: 0 < n <= 10)
        if stage is not corpus_pipeline.mix:
            assert found.columns == docs.columns, name


def test_a_long_text_is_hashed_in_blocks(monkeypatch):
    import numpy as np

    texts = [b"abc de f", b"x" * 50, b"", b"longer words that cross the blocks of bytes"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    w = common.words(data, offsets, common.NOT_SPACE)
    whole = common.word_hashes(data, w)
    monkeypatch.setattr(common, "CHUNK_BYTES", 7)
    common._powers.cache_clear()
    assert np.array_equal(common.word_hashes(data, w), whole)
    monkeypatch.undo()
    common._powers.cache_clear()


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from codeloom import storage

    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, name, default=None):
            return self.values.get(name, default)

        def set(self, name, value):
            self.values[name] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    with pytest.raises(ValueError):
        storage.shared_folder(Session("spark://host:7077"), "x")
    assert storage.shared_folder(Session("local[2]"), "x").startswith("/")
