"""Layer graphs: shared and tied parameters, several inputs and heads, by finite differences and in training."""

import math

import numpy as np
import pytest

from cubeloom.operators import nets
from cubeloom.operators.graphs import Graph, Head, Node, tied_autoencoder
from cubeloom.operators.nets import Layer, Net
from cubeloom.plans import trainer


def checked(net, x, y, key=None, step=None, **more):
    w = net.initial(3) + 0.01
    loss, g, n = net.loss_and_gradient(w, x, y, key, step, **more)
    assert len(g) == len(w) == net.n_weights
    for i in np.random.default_rng(0).choice(len(w), min(60, len(w)), replace=False):
        d = np.zeros_like(w)
        d[i] = 1e-6
        slope = (net.loss_and_gradient(w + d, x, y, key, step, **more)[0] - net.loss_and_gradient(w - d, x, y, key, step, **more)[0]) / 2e-6
        assert math.isclose(slope, g[i], rel_tol=2e-4, abs_tol=2e-6), (i, slope, g[i])
    return loss, n


def siamese():
    """Two images through one convolution, joined to one decision, with a side loss on the first."""
    conv = Layer("conv", 1, 3, "tanh", 2, 2)
    return Graph(
        {"features": (1, 5, 5), "other": (1, 5, 5)},
        [Node("a", conv, ("features",)), Node("b", conv, ("other",), share="a"), Node("both", Layer("dense", 24, 4, "relu"), ("a", "b")), Node("out", Layer("dense", 4, 3, "linear"), ("both",)), Node("side", Layer("dense", 12, 2, "linear"), ("a",))],
        [Head("out"), Head("side", "nll", "kind", 0.5)],
    )


def test_shared_parameters_two_inputs_and_two_heads():
    rng = np.random.default_rng(1)
    net = siamese()
    assert net.columns == ["features", "label", "other", "kind"] and net.n_weights == 3 * 4 + 3 + 24 * 4 + 4 + 4 * 3 + 3 + 12 * 2 + 2
    checked(net, rng.normal(size=(5, 25)), np.array([0, 2, 1, -1, 2]), other=rng.normal(size=(5, 25)), kind=rng.integers(0, 2, 5))


@pytest.mark.parametrize("tied", [True, False])
def test_autoencoders(tied):
    rng = np.random.default_rng(2)
    net = tied_autoencoder(6, [4, 3], noise=0.2, tied=tied)
    assert net.n_weights == (6 * 4 + 4 * 3) * (1 if tied else 2) + 4 + 3 + 4 + 6
    x = rng.normal(size=(5, 6))
    checked(net, x, np.zeros(5))
    noisy = checked(net, x, np.zeros(5), np.arange(5), 4)
    assert noisy[0] != checked(net, x, np.zeros(5))[0]


def test_joined_volumes_and_a_skipped_layer():
    rng = np.random.default_rng(3)
    same = Layer("conv", 1, 2, "tanh", 1, dims=3)
    net = Graph({"features": (1, 3, 4, 4)}, [Node("a", same, ("features",)), Node("b", Layer("conv", 3, 2, "sigmoid", (1, 2, 2), dims=3), ("a", "features")), Node("out", Layer("conv", 2, 2, "linear", dims=3), ("b",))], [Head("out")])
    checked(net, rng.normal(size=(2, 48)), rng.integers(-1, 2, (2, 27)))


def test_a_chain_is_a_net():
    rng = np.random.default_rng(4)
    layers = [Layer("conv", 1, 3, "relu", 2, 2, 0.3), Layer("dense", 12, 5, "tanh", rate=0.2), Layer("dense", 5, 3, "linear")]
    net = Net((1, 5, 5), layers, 3)
    chain = Graph({"features": (1, 5, 5)}, [Node(str(i), x, (str(i - 1) if i else "features",)) for i, x in enumerate(layers)], [Head("2")])
    w, x, y = net.initial(1), rng.normal(size=(4, 25)), np.array([0, 1, 2, 1])
    assert (chain.initial(1) == w).all()
    for key, step in ((None, None), (np.arange(4), 5)):
        a, b = net.loss_and_gradient(w, x, y, key, step), chain.loss_and_gradient(w, x, y, key, step)
        assert math.isclose(a[0], b[0]) and np.allclose(a[1], b[1]) and a[2] == b[2]


def test_graphs_that_cannot_be():
    dense = Layer("dense", 4, 4, "linear")
    for nodes, heads in (
        ([Node("a", dense, ("b",))], [Head("a")]),
        ([Node("a", dense, ("features",)), Node("a", dense, ("a",))], [Head("a")]),
        ([Node("a", dense, ("features",)), Node("b", Layer("dense", 4, 3), ("a",), share="a")], [Head("a")]),
        ([Node("a", dense, ("features",)), Node("b", dense, ("a",), tied=True)], [Head("a")]),
        ([Node("a", Layer("dense", 4, 4), ("features",))], [Head("a")]),
        ([Node("a", dense, ("features",))], [Head("a", "malis")]),
    ):
        with pytest.raises(ValueError):
            Graph({"features": (4,)}, nodes, heads)
    with pytest.raises(ValueError):
        Graph({"other": (4,)}, [Node("a", dense, ("other",))], [Head("a")])


def test_training_graphs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 8))
    x = rng.normal(size=(150, 3)) @ base
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "key long, features array<double>, label long").repartition(3)
    t = trainer.Trainer(tied_autoencoder(8, [5], noise=0.01), df)
    first = t.evaluate(df)[0]
    for _ in range(10):
        t.training_step("LBFGS")
    assert t.evaluate(df)[0] < 0.6 * first
    y = rng.integers(0, 3, 90)
    images = [(k, rng.normal(size=25).tolist(), int(y[k]), (rng.normal(size=25) + y[k]).tolist(), int(k % 2)) for k in range(90)]
    two = spark.createDataFrame(images, "key long, features array<double>, label long, other array<double>, kind long").repartition(3)
    t = trainer.Trainer(siamese(), two, n_batches=2, rate=0.2)
    first = t.evaluate(two)
    for _ in range(25):
        t.training_step("SGD")
    last = t.evaluate(two)
    assert last[0] < 0.9 * first[0] and last[1] < first[1]
    loss, g, n = t.net.loss_and_gradient(t.w, np.array([r[1] for r in images]), y, other=np.array([r[3] for r in images]), kind=np.array([r[4] for r in images]))
    got = nets.gradient(two, t.net, t.w)
    assert n == got[2] == 90 and math.isclose(got[0], loss / n) and np.allclose(got[1], g / n)


def test_affinity_edges_of_blocks_are_those_of_joins(spark):
    """Voxels over several blocks, some missing, one twice, some without a segment, negative places; one shuffle whatever the number of axes."""
    import random

    from pyspark.sql import functions as F

    from cubeloom.operators.graph import affinity_edges

    rng = random.Random(4)
    rows = [(k, z, x, None if rng.random() < 0.1 else rng.randrange(3)) for k in range(3) for z in range(-3, 36) for x in range(20) if rng.random() < 0.9]
    seg = spark.createDataFrame([*rows, rows[40]], "v long, z long, x long, seg long").repartition(5)
    wanted = None
    for i, a in enumerate(("z", "x")):
        ahead = seg.select("v", *((F.col(c) - 1).alias(c) if c == a else F.col(c) for c in ("z", "x")), F.col("seg").alias("next"))
        one = seg.join(ahead, ["v", "z", "x"]).select("v", F.lit(i).cast("long").alias("dir"), "z", "x", ((F.col("seg") == F.col("next")) & (F.col("seg") > 0)).cast("long").alias("connected"))
        wanted = one if wanted is None else wanted.unionByName(one)
    got = affinity_edges(seg, "v", ("z", "x"))
    assert got.columns == wanted.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
