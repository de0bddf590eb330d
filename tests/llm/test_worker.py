"""Memory that workers keep between tasks."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from cubeloom.llm import crf, storage, tagging, toxicity

PROGRAM = """
import re
import numpy as np
from cubeloom.llm.worker import released

def mb():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

before = mb()
for _ in range(2):
    held = [np.ones(100_000) for _ in range(400)]
    last = held[-1]
    del held
kept = mb() - before
released()
print(kept, mb() - before, last[0])
"""


def test_freed_memory_goes_back_between_tasks():
    """Nothing is held by an operator, yet freed arrays below a living one are given back."""
    ran = subprocess.run([sys.executable, "-c", PROGRAM], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=120, check=True)
    kept, after, _ = map(float, ran.stdout.split())
    assert kept > 150  # the C library keeps it
    assert after < 50


def test_a_sample_starts_no_workers_of_another_kind(spark, monkeypatch):
    """Rows that the driver broadcasts don't pass an RDD's Python workers, which would stay beside the operator's."""
    sent, broadcast = [], tagging.F.broadcast
    monkeypatch.setattr(tagging.F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('t', id) AS text", "id % 2 AS cls")
    got = tagging.sample(docs, docs, 100, 10_000)
    assert sorted(got) == sorted((i % 2, f"t{i}") for i in range(50))
    assert len(sent) == 3
    for df in sent:
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["bigint", "tinyint", "string", "double", "decimal(12,3)", "date", "boolean", "binary", "timestamp", "array<int>"])
def test_local_rows_keep_their_values(spark, kind):
    first = {"date": "'2024-02-29'", "timestamp": "'2024-02-29 01:02:03'", "array<int>": "array(1, 2)", "boolean": "true", "binary": "'7'"}.get(kind, "7")
    df = spark.sql(f"SELECT * FROM VALUES (CAST({first} AS {kind}), 1), (NULL, 2) AS t(x, n)")
    for rows in ([tuple(r) for r in df.collect()], []):
        made = storage.local(spark, rows, df.schema)
        assert [f.dataType for f in made.schema] == [f.dataType for f in df.schema]
        assert [tuple(r) for r in made.collect()] == rows


def test_a_tagger_gets_few_texts_at_once(spark, monkeypatch):
    """A batch of many texts is tagged in parts; a longer text is tagged whole, and each row's result is that of the row alone."""
    toxic, clean = [[f"vile{i % 3}", "and", "more"] * 4 for i in range(40)], [["fine", f"x{i % 7}", "more"] * 4 for i in range(40)]
    model = toxicity.learned(toxic, clean)
    runs: list = []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    docs = storage.local(spark, [(1, "a")], schema)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    toxicity.scored(docs, model)
    sizes, tag = [], crf.Tagger.tag
    monkeypatch.setattr(crf.Tagger, "tag", lambda self, texts: sizes.append(sum(len(w) + 1 for t in texts for w in t)) or tag(self, texts))
    texts = [("fine more " * 9_000 + ("vile1 " if i % 2 else "")).strip() for i in range(30)] + ["fine " * 200_000, None, ""]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], names=["doc_id", "text"])
    score = [x for b in runs[0](iter([batch(texts)])) for x in b.column("score").to_pylist()]
    assert len(score) == len(texts)
    assert sorted(sizes)[-1] >= 1_000_000  # the long one
    assert sorted(sizes)[-2] <= 600_000
    for i in (0, 1, 29, 30, 31, 32):
        alone = [x for b in runs[0](iter([batch([texts[i]])])) for x in b.column("score").to_pylist()]
        assert alone == pytest.approx([score[i]], abs=1e-9)
