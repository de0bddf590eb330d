"""Known sizes, and properties that tie operators to each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.functions.keyed import uniform
from cubeloom.operators import augment, graph, inference, layers, optimise, reshape, sampling
from cubeloom.plans import architecture as arch
from cubeloom.sources.tables import indexed


def test_digit_network_sizes():
    net = arch.chain((3, 3), (2, 2))
    assert arch.extents(26, net) == [(24, 12), (10, 5)]
    assert arch.fields(net) == [4, 10]
    assert arch.strides(net) == [2, 4]


def test_cube_network_sizes():
    net = arch.chain((4, 3, 3, 3, 2), (2, 1, 1, 1, 1))
    assert [p for _, p in arch.extents(127, net)] == [62, 60, 58, 56, 55]
    assert arch.choose([18, 22, 26], 20) == 18 and arch.choose([18, 22], 4) == 18 and arch.choose([18, 22], None) == 22


def test_solver_equals_fold(spark):
    net = arch.chain((6, 5, 4), (2, 2, 2), (True, True, False))
    got = {r["input"]: r["out"] for r in arch.valid_inputs(spark, net, 300).collect()}
    assert got == {n: e[-1][1] for n in range(2, 300) if (e := arch.extents(n, net))}


def grid_frame(spark, n_images, side, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, x, y, float(round(v, 4))) for i in range(n_images) for (x, y), v in np.ndenumerate(rng.normal(size=(side, side)))]
    return spark.createDataFrame(rows, "vec_id long, x long, y long, value double")


def test_fragments_equal_strided_and_sliding_max(spark):
    df = grid_frame(spark, 3, 7)
    a = {tuple(r[:3]): r[3] for r in inference.fragmented(df, ["vec_id"], 2, 7, "value").select("vec_id", "x", "y", "value").collect()}
    b = {tuple(r[:3]): r[3] for r in inference.strided(df, ["vec_id"], 2, 7, "value").select("vec_id", "x", "y", "value").collect()}
    v = {tuple(r[:3]): r[3] for r in df.collect()}
    want = {(i, x, y): max(v[i, x + p, y + q] for p in (0, 1) for q in (0, 1)) for i in range(3) for x in range(6) for y in range(6)}
    assert a == b == want


def test_identity_warp(spark):
    df = grid_frame(spark, 2, 8)
    p = df.select("vec_id").distinct().select("vec_id", *(F.lit(v).alias(c) for c, v in (("rot", 0.0), ("shear", 0.0), ("scale_0", 1.0), ("scale_1", 1.0), ("stretch_0", 0.0), ("stretch_1", 0.0))))
    out = augment.gathered(augment.warp_map_2d(p, 8, 8), df, "vec_id", ("x", "y"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_convolution_flips_its_kernel(spark):
    x = spark.createDataFrame([(0, 0, i, j, float(10 * i + j)) for i in range(3) for j in range(3)], "k long, ch long, x long, y long, value double")
    w = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 0, 0, 1, 2.0), (0, 0, 1, 0, 3.0), (0, 0, 1, 1, 4.0)], "f long, ch long, kx long, ky long, w double")
    b = spark.createDataFrame([(0, 0.5)], "f long, b double")
    out = {(r["x"], r["y"]): r["z"] for r in layers.conv(x, w, b, ["k"], {"x": 3, "y": 3}, {"x": 2, "y": 2}).collect()}
    assert out[0, 0] == 1.0 * 11 + 2.0 * 10 + 3.0 * 1 + 4.0 * 0 + 0.5 and len(out) == 4


def test_softmax_sums_to_one(spark):
    z = spark.createDataFrame([(k, c, float(c * k)) for k in range(4) for c in range(3)], "k long, c long, z double")
    sums = layers.softmax(z, ["k"]).groupBy("k").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)


def test_gradient_is_finite_difference(spark):
    rng = np.random.default_rng(3)
    rows = [([float(v) for v in rng.normal(size=4)], int(rng.integers(3))) for _ in range(20)]
    at = optimise.loss_and_gradient(spark.createDataFrame(rows, "features array<double>, label long"), 4, 3)
    w = rng.normal(size=(5, 3)) * 0.3
    loss, g = at(w)
    step = np.zeros_like(w)
    step[2, 1] = 1e-5
    assert abs((at(w + step)[0] - at(w - step)[0]) / 2e-5 - g[2, 1]) < 1e-4
    _, log = optimise.lbfgs(at, w, 4)
    assert log[-1] < loss
    _, steps = optimise.conjugate_gradient(at, w, 3)
    assert steps[-1][0] < loss


@pytest.mark.parametrize("parts", [1, 7])
def test_draws_do_not_depend_on_partitions(spark, parts):
    ids = spark.range(100).withColumnRenamed("id", "k").repartition(parts)
    epochs = spark.range(2).withColumnRenamed("id", "epoch")
    rows = sampling.shuffled_batches(ids, "k", 16, epochs, "s").collect()
    by = {e: [r["k"] for r in sorted((r for r in rows if r["epoch"] == e), key=lambda r: (r["batch"], r["slot"]))] for e in (0, 1)}
    assert len(by[0]) == len(set(by[0])) == 96 and by[0] != by[1]
    u = {r["k"]: r["u"] for r in spark.range(100).select(F.col("id").alias("k"), uniform("s", F.lit(0), F.col("id")).alias("u")).collect()}
    assert by[0] == sorted(u, key=lambda k: (u[k], k))[:96]


def test_folds_cover_and_differ_by_one(spark):
    df = indexed(spark.range(101).withColumnRenamed("id", "k"), "k", "i")
    n = [r["count"] for r in sampling.folds(df, "i", F.lit(101), 4).groupBy("fold").count().orderBy("fold").collect()]
    assert n == [26, 25, 25, 25]


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(n - 1)] + [(1, 5, 9)], "k long, a long, b long")
    nodes = spark.createDataFrame([(0, i) for i in range(n)] + [(1, 5), (1, 9), (1, 11)], "k long, node long")
    got = {(r["k"], r["node"]): r["comp"] for r in graph.components(edges, nodes, "k", least=2).collect()}
    assert {got[0, i] for i in range(n)} == {0} and got[1, 5] == got[1, 9] == 5 and got[1, 11] == -1


def test_maximin_counts_by_hand(spark):
    # 0-1-2 in one segment, 3 in another; the weak edge 1-2 is the maximin edge of the pairs over it.
    edges = [(7, 0, 1, 0.9, 1, 1), (7, 1, 2, 0.4, 1, 1), (7, 2, 3, 0.6, 1, 2)]
    r = graph.maximin_counts(spark.createDataFrame(edges, "k long, a long, b long, p double, sa long, sb long"), "k").first()
    assert (r["pos"], r["neg"], r["splits"], r["merges"]) == (1 + 2, 1 + 2, 2, 1)


def test_strip_extents():
    assert reshape.strip_extents(10, 6, 1) == (1, 0)
    assert reshape.strip_extents(6, 10, 0) == (0, 2)
    with pytest.raises(ValueError):
        reshape.strip_extents(10, 5, 0)


def test_all_images_are_compared_pairwise(spark):
    from cubeloom import catalog, registry  # noqa: F401

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    got = registry.queries()["pairwise_prediction_diff_all"](spark, d)
    assert got.count() == n // 4 * 6 * 64 and got.agg({"img": "max"}).first()[0] == n // 4 - 1


def test_ticks_span_the_whole_log_and_sums_need_no_single_task(spark):
    from cubeloom import catalog, registry  # noqa: F401
    from cubeloom.operators import monitor
    from cubeloom.sources.tables import running_sum

    d = "/root/testdata/sf0.01"
    steps = sorted(r["step"] for r in registry.queries()["step_ticks_interp_all"](spark, d).collect())
    assert steps == [0, 2000, 4000, 6000, 8000] and [monitor.tick_spacing(n) for n in (1, 7, 994, 99_995)] == [1, 1, 200, 20_000]
    df = spark.range(1000).selectExpr("id * 3 as i", "cast(id % 7 as double) as v")
    sums = [r["t"] for r in running_sum(df, "i", "v", "t").orderBy("i").collect()]
    assert sums == [float(sum(k % 7 for k in range(n + 1))) for n in range(1000)]
    line = monitor.interpolated(df, spark.createDataFrame([(4,), (2997,), (-1,)], "at long"), "i", "v", "at")
    assert [(r["at"], round(r["v"], 9)) for r in line.collect()] == [(4, round(1 + 1 / 3, 9))]
