"""Orders, sums, draws and components give the same whatever the number of ranges and the size of a volume."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.operators import graph, monitor, sampling
from cubeloom.sources import tables


@pytest.mark.parametrize("rows", [7, 100, 10_000])
def test_numbers_and_sums_by_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(tables, "QUANTILES", 8)
    keys = sorted({int(x) for x in np.random.default_rng(1).integers(0, 1 << 40, 900)} | set(range(100)))
    df = spark.createDataFrame([(k, float(i % 5)) for i, k in enumerate(keys)], "k long, v double").repartition(5)
    assert [r["i"] for r in tables.indexed(df, "k", "i", rows).orderBy("k").collect()] == list(range(len(keys)))
    assert [r["s"] for r in tables.running_sum(df, "k", "v", "s", rows).orderBy("k").collect()] == np.cumsum([i % 5 for i in range(len(keys))]).tolist()


def test_ranks_in_many_buckets(spark):
    df = spark.range(500).withColumns({"g": F.col("id") % 3, "u": (F.col("id") * 37 % 500) / 500.0})
    want = sampling.ranked(df, "u", ["id"], ["g"], 1).orderBy("id").collect()
    assert sampling.ranked(df, "u", ["id"], ["g"], 40).select(want[0].__fields__).orderBy("id").collect() == want


def test_draws_by_parts(spark):
    rng = np.random.default_rng(2)
    prio = [0, 5, 0, 0, 1, 90, 3, 0, 1]
    cdf = sampling.priority_cdf(spark.createDataFrame(list(enumerate(prio)), "k long, p long"), "k", "p")
    u = [0.0, 0.05, 0.06, 0.999999, *rng.random(60).tolist()]
    edges = np.cumsum(prio) / sum(prio)
    got = {r["d"]: r["k"] for r in sampling.drawn_from(spark.createDataFrame(list(enumerate(u)), "d long, u double"), cdf).collect()}
    assert got == {d: int(np.searchsorted(edges, x, side="right")) for d, x in enumerate(u)}


def test_average_of_a_long_sequence(spark):
    x = np.random.default_rng(3).random(30_000)
    ema = 0.65
    for v in x:
        ema = 0.995 * ema + 0.005 * v
    seq = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k long, t long, value double")
    assert abs(monitor.last_ema(seq, "k", 0.995, 0.65).first()["ema"] - ema) < 1e-9


def test_volumes_of_any_size(spark):
    rng = np.random.default_rng(4)
    edges = [(k, int(a), int(b)) for k in range(4) for a, b in rng.integers(0, 60, (45, 2)) if a != b]
    edges += [(9, i, i + 1) for i in range(199)][::-1]  # one long path
    nodes = [(k, n) for k in range(4) for n in range(60)] + [(9, n) for n in range(200)] + [(7, 5)]
    e, n = spark.createDataFrame(edges, "k long, a long, b long"), spark.createDataFrame(nodes, "k long, node long")
    one = lambda most: sorted(map(tuple, graph.components(e, n, "k", 2, most).select("k", "node", "comp").collect()))
    want = one(10_000)
    assert one(100) == want and one(0) == want
    assert {c for k, _, c in want if k == 9} == {0} and (7, 5, -1) in want


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    assert tables.shared_dir(Session(spark_master="spark://a:7077", spark_checkpoint_dir="/shared/x/")) == "/shared/x"
    with pytest.raises(RuntimeError):
        tables.shared_dir(Session(spark_master="spark://a:7077"))


def test_partitions_follow_the_rows(spark):
    from cubeloom.sources.tables import RANGE_ROWS, task_parts

    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert task_parts(spark, 0) == task_parts(spark, own * RANGE_ROWS) == own and task_parts(spark, 10 * own * RANGE_ROWS) == 10 * own
