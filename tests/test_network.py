"""Layer plans: their checks, and forward passes against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.plans.network import Network, NetworkConfig


@pytest.mark.parametrize(
    "values",
    [
        {"mode": "nowhere"},
        {"mode": "img-img", "mlp": [3]},
        {"mode": "img-scalar"},
        {"mode": "vect-scalar", "filters": [3], "pool": [2], "n_filters": [4]},
        {"mode": "img-scalar", "mlp": [3], "rnn": 4},
        {"mode": "img-scalar", "mlp": [3], "filters": [3], "pool": [], "n_filters": [4]},
        {"mode": "img-scalar", "mlp": [3], "dropout": [0.5, 0.5]},
        {"mode": "img-scalar", "mlp": [3], "target": "mean"},
        {"mode": "img-scalar", "mlp": [3], "lazy_labels": True},
        {"mode": "img-scalar", "mlp": [3], "filters": [4], "pool": [2], "n_filters": [2]},
    ],
)
def test_wrong_combinations(values):
    with pytest.raises(ValueError):
        NetworkConfig(**values)


def test_unknown_keys_name_the_nearest():
    with pytest.raises(KeyError, match="n_filters"):
        NetworkConfig.parsed({"nfilters": [3]})


def test_forward_equals_numpy(spark):
    rng = np.random.default_rng(0)
    images = rng.normal(size=(4, 8, 8))
    rows = [(k, k % 3, x, y, float(v)) for k in range(4) for (x, y), v in np.ndenumerate(images[k])]
    df = spark.createDataFrame(rows, "k long, label long, x long, y long, value double")
    net = Network(spark, NetworkConfig(mode="img-scalar", n_lab=3, filters=[3], pool=[2], n_filters=[2], mlp=[5]))
    got = {(r["k"], r["c"]): r["p"] for r in net.probabilities(df, "k").collect()}
    par = {n: {tuple(r[:-1]): r[-1] for r in t.collect()} for n, t in net.parameters.items()}
    for k in range(4):
        flat = []
        for f in range(2):
            z = np.array([[sum(images[k, x + 2 - a, y + 2 - b] * par["conv0"][f, 0, a, b] for a in range(3) for b in range(3)) for y in range(6)] for x in range(6)]) + par["conv0_b"][f,]
            flat.append(np.tanh(z.reshape(3, 2, 3, 2).max(axis=(1, 3))).ravel())
        h = np.concatenate(flat)
        for name, n, act in (("dense0", 5, np.tanh), ("output", 3, lambda v: v)):
            h = act(np.array([sum(v * par[name][i, o] for i, v in enumerate(h)) + par[f"{name}_b"][o,] for o in range(n)]))
        p = np.exp(h - h.max())
        assert np.allclose([got[k, c] for c in range(3)], p / p.sum())
    loss, error = net.loss(df, "k").first()["nll"], net.error(df, "k").first()["error"]
    own = [got[k, k % 3] for k in range(4)]
    assert np.isclose(loss, -np.log(np.array(own) + 1e-6).mean()) and error == np.mean([max(range(3), key=lambda c: got[k, c]) != k % 3 for k in range(4)])


def test_vectors(spark):
    df = spark.range(12).select((F.col("id") % 3).alias("k"), F.lit(1).cast("long").alias("label"), F.expr("id div 3").alias("i"), F.col("id").cast("double").alias("value"))
    net = Network(spark, NetworkConfig(mode="vect-scalar", n_lab=2, side=2, mlp=[3], activation="relu"))
    assert net.probabilities(df, "k").count() == 6 and set(net.activities(df, "k")) == {"dense0", "output"}
