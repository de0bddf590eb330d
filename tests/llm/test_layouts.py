"""Split keys, positions and selective reads of token files, and an index that several chunks share."""

import itertools

import numpy as np
import pytest

from cubeloom.llm import decontamination, simhash, token_files
from cubeloom.llm.queries import tokenizer_file

DATA = "/root/testdata/sf0.001"


def test_split_keys_miss_no_link(spark):
    rng = np.random.default_rng(12)
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    fps = sorted({b ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(0, 4)), replace=False)) for b in base for _ in range(60)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = {}
    for most in (3, simhash.LIST):
        found = simhash.components(simhash.links(df, most=most)).collect()
        roots[most] = {r["u"]: r["v"] for r in found}
    root = {f: f for (f,) in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a,), (b,) in itertools.combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {f: find(f) for (f,) in signed if find(f) != f}
    assert roots[3] == roots[simhash.LIST] == want


def test_equal_and_null_ids_have_their_own_starts(spark):
    rows = [(5, "one two"), (5, "one"), (5, None), (None, "x"), (None, "y z"), (7, "one two"), (1, "")] * 3
    path = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_file("word_bpe_49k.json"))
    files = spark.read.parquet(path)
    key = lambda r: (r["start"], r["n_tokens"])
    digests, starts = sorted(token_files.read_digests(files).collect(), key=key), sorted(token_files.starts(files).collect(), key=key)
    at = 0
    for d, s in zip(digests, starts, strict=True):
        assert d["start"] == s["start"] == at and d["n_tokens"] == s["n_tokens"] and d["doc_id"] == s["doc_id"]
        at += d["n_tokens"]
    in_order = sorted(files.collect(), key=lambda r: (r["part"], r["pos"]))
    assert [len(r["tokens"]) for r in in_order] == [r["n_tokens"] for r in starts]
    assert [r["doc_id"] for r in in_order][:6] == [None] * 6


def test_a_range_of_documents_reads_few_rows(spark):
    import pyarrow.parquet as pq

    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat_ws(' ', id, id * 7, id * 13, id * 17) AS text")
    path = token_files.write_tokens(docs, tokenizer_file("word_bpe_49k.json"), row_group_bytes=64 << 10, page_bytes=8 << 10)
    files = spark.read.parquet(path)
    meta = pq.ParquetFile(files.inputFiles()[0].removeprefix("file://")).metadata
    assert meta.num_row_groups > 3 and all(meta.row_group(0).column(i).has_column_index for i in range(4))
    some = token_files.documents(files, 7000, 7009)
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(7000, 7010))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,7000), LessThanOrEqual(doc_id,7009)]" in some._jdf.queryExecution().toString()
    assert scanned(some) < 0.2 * 20_000
    assert "tokens:array" not in token_files.starts(files)._jdf.queryExecution().executedPlan().toString()
    assert token_files.documents(files, 5, 4).collect() == []


def scanned(df):
    """Rows that the scans of a plan gave out when it ran."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    todo, n = [plan], 0
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan"):
            n += p.metrics().apply("numOutputRows").value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return n


@pytest.mark.parametrize("held", [0, 16])
def test_chunks_share_one_index(spark, monkeypatch, held):
    monkeypatch.setattr(decontamination, "HELD_CHUNKS", held)
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    bench = bench.unionByName(bench)  # repeated items
    want = sorted(map(tuple, decontamination.contamination(docs, bench).collect()))
    assert sorted(map(tuple, decontamination.contamination(docs, bench, chunk_bytes=3000).collect())) == want
    assert any(r[3] for r in want)
