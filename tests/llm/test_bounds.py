"""What is collected and what one file gets, where a third of all rows share an id or have none."""

import pytest

from cubeloom.llm import tagging, token_files
from cubeloom.llm.queries import tokenizer_file


def rows_with_a_hot_id(n, hot):
    return [(hot if i % 3 == 0 else i, f"text number {i} of many words" if i % 2 else "the same text", "ab"[i % 2]) for i in range(n)]


def test_a_repeated_id_is_one_document_of_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame(rows_with_a_hot_id(9000, -7), "doc_id long, text string, cls string")
    fetched = []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: fetched.append(out := collect(self)) or out)
    for max_rows in (60, 600):
        fetched.clear()
        got = tagging.sample(docs, docs, max_rows, 1_000_000)
        assert 0 < len(got) <= max_rows and max(map(len, fetched)) <= 3 * max_rows + 100


def test_a_sample_of_unique_ids_is_whole(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "x") for i in range(50)], "doc_id long, text string, cls string")
    assert sorted(tagging.sample(docs, docs, 100, 10_000)) == sorted(("x", f"t{i}") for i in range(50))


@pytest.mark.parametrize("hot", [None, 5])
def test_rows_of_one_id_are_dealt_to_many_files(spark, tmp_path, hot):
    rows = [(i, t) for i, t, _ in rows_with_a_hot_id(20_000, hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n_bytes = sum(len(t) for _, t in rows)
    path = token_files.write_tokens(docs, tokenizer_file("word_bpe_49k.json"), f"{tmp_path}/t", file_text_bytes=n_bytes // 10)
    files = spark.read.parquet(path)
    per_file = sorted(r["count"] for r in files.groupBy("part").count().collect())
    assert sum(per_file) == len(rows) and per_file[-1] < 2 * len(rows) / 10
    found = files.select("part", "doc_id", "pos").orderBy("part", "pos").collect()
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
