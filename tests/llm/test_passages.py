"""Removed passages: the automata decide, and rows without an id of their own are dealt out."""

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cubeloom.llm import blocks, substring_dedup

DATA = "/root/testdata/sf0.001"


def test_without_the_automatons_hits_nothing_is_removed(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    removed = lambda: substring_dedup.recurring_passages_removed(docs).agg(F.sum("n_removed")).first()[0]
    assert removed() > 0
    monkeypatch.setattr(substring_dedup, "_occurrences", lambda automaton, numbers, length: np.zeros(0, np.int64))
    cloudpickle.register_pickle_by_value(substring_dedup)  # workers get the module as it is patched here
    try:
        assert removed() == 0
    finally:
        cloudpickle.unregister_pickle_by_value(substring_dedup)


def test_rows_with_one_id_or_none_are_dealt_out(spark):
    rows = [(None if i % 3 else 7, f"text {i}") for i in range(3000)]
    df = blocks.with_blocks(spark.createDataFrame(rows, "doc_id long, text string"), 10, "doc_id", "text")
    n = [r["count"] for r in df.groupBy(blocks.BLOCK).count().collect()]
    assert len(n) == 10 and max(n) < 400
