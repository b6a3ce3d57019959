import corpus_pipeline
import pytest
from codeloom.llm import decontaminate, line_dedup, mixing, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        frames.append(out)
        now = out
    good, lined, single, clean, mixed = frames
    verdict = quality.score_quality(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(good) == ids(verdict.filter("predicted = 1"))
    assert ids(lined) == ids(good) and line_dedup.losers(lined).count() == 0
    marked = simhash.near_duplicates(lined.select("doc_id", "text"))
    assert ids(single) == sorted({r.component_id for r in marked.collect()})
    hit = decontaminate.contamination(decontaminate.find_matches(single.select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert ids(clean) == ids(hit.filter("not contaminated"))
    assert ids(mixed) == ids(clean) and set(mixing.ADDED) < set(mixed.columns)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "s", 0), (1, "", "en", "s", 0)]])
def test_stages_on_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows)


def test_short_and_unspaced_lines_are_deduped(spark):
    docs = spark.createDataFrame([(1, "Home\n\nhttps://a.example/x\n这是一个很长的句子", "en", "s", 0), (2, "这是一个很长的句子\n\nHome\nAway\nhttps://a.example/x", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert got == {1: docs.filter("doc_id = 1").first().text, 2: "\nAway"}


def test_batches_to_python_are_bounded(spark, tmp_path, monkeypatch):
    bound, key = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"
    seen = str(tmp_path)

    def watched(batches, at, own=decontaminate.pieces):
        def each():
            for batch in batches:
                with open(f"{seen}/{batch.nbytes}", "w"):
                    yield batch

        return own(each(), at)

    for module in (quality, simhash, decontaminate):
        monkeypatch.setattr(module, "pieces", watched)
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 8000) as text", "'en' as lang", "'s' as source", "0L as n_chars").coalesce(1)
    for stage in (corpus_pipeline.drop_low_quality, corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated):
        spark.conf.unset(key)
        stage(spark, docs, SF).write.format("noop").mode("overwrite").save()
        sizes = [int(p.name) for p in tmp_path.iterdir()]
        assert max(sizes) < 2 * bound, stage
        for p in tmp_path.iterdir():
            p.unlink()
    spark.conf.set(key, "1000000")
    quality.keep_good(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert spark.conf.get(key) == "1000000"
    spark.conf.unset(key)
