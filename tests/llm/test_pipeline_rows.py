"""Stages on odd tables, and whatever the plan: scans split anew, lists too large to broadcast, long texts."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from cubeloom.llm import decontamination, simhash

DATA, SPLITS = "/root/testdata/sf0.1", "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def splits(spark):
    yield lambda n: spark.conf.set(SPLITS, n)
    spark.conf.unset(SPLITS)


@pytest.mark.parametrize(("stage", "module", "name"), [(corpus_pipeline.one_of_near_duplicates, simhash, "component_of"), (corpus_pipeline.decontaminated, decontamination, "contamination")])
def test_rows_keep_their_numbers_when_scans_split_anew(spark, splits, monkeypatch, stage, module, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.substring("text", 1, 4000).alias("text"))
    ids = lambda: sorted(r["doc_id"] for r in stage(spark, docs, DATA).select("doc_id").collect())
    splits(2)
    want, run = ids(), getattr(module, name)

    def later(*args, **kw):
        splits(64)  # as if executors came between the scans
        return run(*args, **kw)

    monkeypatch.setattr(module, name, later)
    splits(2)
    assert ids() == want


def test_dropped_rows_too_many_to_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key = lambda out: sorted(r["doc_id"] for r in out.collect())
    for stage in (corpus_pipeline.one_of_near_duplicates, corpus_pipeline.decontaminated):
        want = key(stage(spark, docs, "/root/testdata/sf0.001"))
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", 0)
        assert key(stage(spark, docs, "/root/testdata/sf0.001")) == want
        monkeypatch.undo()


def test_the_last_stage_on_odd_tables(spark):
    _, last = corpus_pipeline.STAGES[-1]
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "two words", "x"), (None, "null id", "x")], "doc_id long, text string, ids string")
    out = {(r["doc_id"], r["n_tokens"] > 0) for r in last(spark, docs, DATA).collect()}
    assert out == {(1, False), (2, False), (2, True), (None, True)}
    assert last(spark, docs.limit(0), DATA).collect() == []


def test_long_texts_in_stages(spark):
    passage = " ".join(f"p{i}" for i in range(3000))
    long = lambda k: " ".join(f"{k}w{i % 9973}" for i in range(60_000))
    rows = [(1, f"{long(1)} {passage}"), (2, f"{long(2)} {passage} tail"), (3, long(1) + " " + passage), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, None, None, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = {r["doc_id"]: r for r in stage(spark, docs, "/root/testdata/sf0.001").collect()}
        if name == "simhash_dedup":
            assert sorted(out) == [1, 2, 4]
        else:
            assert sorted(out) == [1, 2, 3, 4, 5]
        if name == "substring_dedup":
            assert out[2]["text"] == f"{long(2)} tail" and out[2]["n_chars"] == len(out[2]["text"]) and out[3]["text"] == "" and out[1]["text"] == rows[0][1]
