from helpers import DOCS, awkward, labels, prose

import corpus_pipeline


def test_stages_shrink_and_keep_columns(spark, tmp_path):
    w = lambda i: prose(i, 90)
    rows = [(100 + i, w(100 + i), "en", f"s{i % 4}", 1) for i in range(60)] + [(300, w(100), "en", "s0", 1), (301, w(101) + " more", "en", "s0", 1), (302, "too short", "en", "s0", 1)]
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, DOCS))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).filter("1 = 0").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        if i < 4:
            assert at.columns == docs.columns
        at.write.parquet(str(tmp_path / str(i)))
        at = spark.read.parquet(str(tmp_path / str(i)))
        if name.startswith("n-gram"):
            ids = {r["doc_id"] for r in at.collect()}
            assert {300, 301, 302, 24, 25, 20, 21, 22}.isdisjoint(ids) and {100, 101, 3} <= ids
            assert at.groupBy("doc_id").count().filter("count > 1").count() == 0
    assert at.agg({"length": "max"}).collect()[0][0] <= 2048 and at.count() > 0


def test_toxicity_stage_sends_each_text_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i), "en", "s", 1, 0.5) for i in range(30)] + [(None, None, None, None, None, None)], f"{DOCS}, score double")
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    sent, real = [], corpus_pipeline.toxicity
    monkeypatch.setattr(corpus_pipeline, "toxicity", lambda rows, marks: sent.append(rows.schema.simpleString()) or real(rows, marks))
    got = corpus_pipeline.toxicity_filter(spark, docs, str(tmp_path))
    assert sent[0].count("text:") == 1
    assert got.schema.simpleString() == docs.schema.simpleString() and set(got.collect()) <= set(docs.collect())
    assert corpus_pipeline.toxicity_filter(spark, docs.select("text", "doc_id"), str(tmp_path)).columns == ["text", "doc_id"]


def test_a_cleared_cache_is_given_back(monkeypatch):
    from chiweave.llm import common

    back, emptied = [], []
    monkeypatch.setattr(common, "_clear", {})
    monkeypatch.setattr(common, "give_back", lambda: back.append(list(emptied)))
    for owner in ("a", "a", "b"):
        common.only_cache(owner, lambda owner=owner: emptied.append(owner))
    assert back == [["a"]]


def test_run_gives_the_last_stage(spark):
    from pathlib import Path

    import pytest

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables here")
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
