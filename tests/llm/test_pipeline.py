"""The pipeline against plain versions of its stages, and the queries' results."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cubeloom.llm import queries, simhash

DATA = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, twin = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in twin.fetchall())


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.orderBy("doc_id").limit(2).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    docs = docs.unionByName(extra)
    docs.write.mode("overwrite").parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    n = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        path = f"{tmp_path}/stage-{k}"
        out.write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path).collect()
        n[name] = (len(before), len(after))
        if name == "simhash_dedup":
            check_one_of_each(before, after)
        if name == "decontamination":
            check_clean(spark, before, after)
        docs = spark.read.parquet(path)
    assert n["toxicity"][1] < n["toxicity"][0]
    assert n["substring_dedup"][0] == n["substring_dedup"][1]
    assert n["sentencepiece"][0] == n["sentencepiece"][1] == docs.where(F.col("round_trip")).count()


def test_clashing_columns_keep_their_values(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    odd = docs.withColumns({c: F.lit("own") for c in ("n_words", "kept_text", "score", "PREDICTED", "spans", "fp", "hits")})
    odd.write.mode("overwrite").parquet(f"{tmp_path}/clash")
    odd = spark.read.parquet(f"{tmp_path}/clash")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, DATA)
        assert out.columns == odd.columns
        assert all(r[c] == "own" for r in out.collect() for c in ("n_words", "kept_text", "score", "PREDICTED", "spans", "fp", "hits"))
        assert stage(spark, odd.limit(0), DATA).collect() == []


def check_one_of_each(before, after):
    rows = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in before]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc is None, doc or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == sorted(min(g) for g in groups.values())


def check_clean(spark, before, after):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower() if (t or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = split(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    holds = lambda t: any(tuple(w[i : i + n]) in windows for w in [split(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    assert sorted(map(key, after)) == sorted(key(r) for r in before if not holds(r["text"]))
