"""Networks: gradients by finite differences, targets, dropout, and whole training runs."""

import math

import numpy as np
import pytest

from cubeloom.operators import nets, optimise
from cubeloom.plans import trainer
from cubeloom.plans.network import NetworkConfig

DIGITS = NetworkConfig(mode="img-scalar", n_lab=3, filters=[3, 2], pool=[2, 1], n_filters=[3, 4], mlp=[5])
PIXELS = NetworkConfig(mode="img-img", n_lab=2, side=8, filters=[3, 2], pool=[1, 1], n_filters=[3, 2])
SEQUENCES = NetworkConfig(mode="vect-scalar", n_lab=3, side=2, rnn=4, mlp=[3])


def checked(net, x, y, key=None, step=None, w=None):
    w = net.initial(3) + 0.01 if w is None else w
    loss, g, _ = net.loss_and_gradient(w, x, y, key, step)
    for i in np.random.default_rng(0).choice(len(w), min(60, len(w)), replace=False):
        d = np.zeros_like(w)
        d[i] = 1e-6
        slope = (net.loss_and_gradient(w + d, x, y, key, step)[0] - net.loss_and_gradient(w - d, x, y, key, step)[0]) / 2e-6
        assert math.isclose(slope, g[i], rel_tol=2e-4, abs_tol=2e-6), (i, slope, g[i])


@pytest.mark.parametrize("act", ["tanh", "relu", "sigmoid", "abs", "linear"])
def test_gradients_of_convolutions_and_pools(act):
    rng = np.random.default_rng(1)
    net = trainer.built(NetworkConfig(**{**DIGITS.__dict__, "activation": act}))
    checked(net, rng.normal(size=(4, 64)), np.array([0, 2, -1, 1]))


def test_gradients_of_maxout():
    rng = np.random.default_rng(11)
    mixed = NetworkConfig(mode="img-scalar", n_lab=3, filters=[3, 2], pool=[2, 1], n_filters=[6, 4], mlp=[6], activation=["maxout 3", "tanh", "maxout 2"], dropout=[0.2, 0.0, 0.3])
    net = trainer.built(mixed)
    assert [x.maps for x in net.layers] == [2, 4, 3, 3] and net.layers[1].n_in == 2
    checked(net, rng.normal(size=(4, 64)), np.array([0, 2, -1, 1]))
    apart = net.initial(3) + rng.normal(size=net.n_weights) * 0.05  # with equal biases, dropped units tie, and a tie has no slope
    checked(net, rng.normal(size=(4, 64)), np.array([0, 2, 0, 1]), np.arange(4), 5, apart)
    pixels = NetworkConfig(mode="img-img", n_lab=2, dims=3, side=6, filters=[2, 2], pool=[1, 1], n_filters=[4, 4], activation="maxout 2")
    checked(trainer.built(pixels), rng.normal(size=(2, 216)), rng.integers(-1, 2, (2, 64)))


def test_maxout_of_adjacent_channels_and_fragments():
    rng = np.random.default_rng(12)
    layer = nets.Layer("conv", 1, 4, "maxout 2", 2, 1)
    x, par = rng.normal(size=(3, 1, 5, 5)), [rng.normal(size=(4, 1, 2, 2)), rng.normal(size=4)]
    h, (_, z, *_) = nets.layer_output(layer, par, x, None, None, 0)
    assert h.shape == (3, 2, 4, 4) and (h == np.maximum(z[:, 0::2], z[:, 1::2])).all()
    net = trainer.built(NetworkConfig(mode="img-img", n_lab=2, side=9, filters=[2, 2], pool=[2, 1], n_filters=[4, 2], activation="maxout 2")).at((12, 12))
    w, x = net.initial(1), rng.normal(size=(2, 144))
    assert np.allclose(net.dense_by_fragments(w, x), net.dense_by_strides(w, x))
    ties = np.zeros((1, 4))
    assert nets.activated_back(nets.Layer("dense", 1, 4, "maxout 2"), ties, ties[:, :2], np.ones((1, 2))).tolist() == [[1, 0, 1, 0]]


@pytest.mark.parametrize("values", [{"mlp": [5], "activation": "maxout 2"}, {"mlp": [4], "activation": "maxout 1"}, {"mlp": [4], "activation": "maxout"}, {"mode": "vect-scalar", "rnn": 4, "activation": "maxout 2"}])
def test_maxout_that_does_not_fit_is_refused(values):
    with pytest.raises(ValueError, match="maxout"):
        NetworkConfig(**values)
    with pytest.raises(ValueError, match="maxout"):
        nets.Layer("dense", 3, 5, "maxout 2")


@pytest.mark.parametrize("target", ["nll", "nll_weak", "regression", "nll_mutiple_binary"])
def test_gradients_of_targets(target):
    rng = np.random.default_rng(2)
    net = trainer.built(NetworkConfig(mode="vect-scalar", n_lab=3, side=2, mlp=[5], target=target))
    y = {"regression": rng.normal(size=(6, 3)), "nll_mutiple_binary": rng.integers(0, 2, (6, 3)) * 1.0}.get(target, np.array([0, 1, 2, -1, 1, 0]))
    checked(net, rng.normal(size=(6, 4)), y)


def test_gradients_of_recurrent_pixel_and_gated_nets():
    rng = np.random.default_rng(3)
    checked(trainer.built(SEQUENCES, steps=5), rng.normal(size=(4, 20)), np.array([0, 1, 2, 1]))
    checked(trainer.built(PIXELS), rng.normal(size=(2, 64)), rng.integers(-1, 2, (2, 25)))
    gated = NetworkConfig(**{**DIGITS.__dict__, "dropout": [0.3, 0.0, 0.5]})
    checked(trainer.built(gated), rng.normal(size=(4, 64)), np.array([0, 2, 0, 1]), np.arange(4), 7)


def test_a_loss_of_ones_own():
    def quartic(z, y):
        d = z - y
        return (d**4).sum(axis=1), 4 * d**3

    rng = np.random.default_rng(4)
    checked(trainer.built(NetworkConfig(mode="vect-scalar", n_lab=2, side=2, mlp=[3]), quartic), rng.normal(size=(5, 4)), rng.normal(size=(5, 2)))


def test_gates_keep_the_mean_and_repeat():
    g = nets.gate(0.25, np.arange(2000), 50, 3)
    assert abs(g.mean() - 1.0) < 0.02 and set(np.unique(g)) == {0.0, 1 / 0.75} and (g == nets.gate(0.25, np.arange(2000), 50, 3)).all() and (g != nets.gate(0.25, np.arange(2000), 50, 4)).any()


def test_affinity_losses_are_refused():
    with pytest.raises(ValueError, match="affinity"):
        trainer.built(NetworkConfig(**{**PIXELS.__dict__, "target": "malis"}))


def test_a_trained_net_over_a_larger_input(spark):
    rng = np.random.default_rng(5)
    t = trainer.Trainer(trainer.built(PIXELS), spark.createDataFrame([(0, [0.0] * 64, [0] * 25)], "key long, features array<double>, label array<long>"))
    large, x = trainer.for_prediction(t, PIXELS, 12), rng.normal(size=(12, 12))
    whole = large.forward(t.w, x.reshape(1, -1))[0].reshape(9, 9, 2)
    part = t.net.forward(t.w, x[2:10, 3:11].reshape(1, -1))[0].reshape(5, 5, 2)
    assert np.allclose(whole[2:7, 3:8], part)


def test_a_saved_network_with_maxout(spark, tmp_path):
    net = trainer.built(NetworkConfig(mode="img-scalar", n_lab=3, filters=[3], pool=[2], n_filters=[4], mlp=[6], activation="maxout 2"))
    w = net.initial(2)
    had, v = trainer.loaded_network(spark, trainer.saved_network(spark, net, w, str(tmp_path / "n")))
    x = np.random.default_rng(0).normal(size=(2, 64))
    assert [(x.act, x.maps, x.extent) for x in had.layers] == [(x.act, x.maps, x.extent) for x in net.layers] and np.allclose(had.forward(v, x)[0], net.forward(w, x)[0])


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 4)) * 0.3 + np.array([[2, 0, 0, 1], [0, 2, 0, -1], [0, 0, 2, 0]])[y]
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(240)], "key long, features array<double>, label long").repartition(4)


@pytest.mark.parametrize(("mode", "steps"), [("SGD", 12), ("Adam", 12), ("RPROP", 12), ("CG", 3), ("LBFGS", 3)])
def test_every_optimiser_lowers_the_loss(examples, mode, steps):
    t = trainer.Trainer(trainer.built(NetworkConfig(mode="vect-scalar", n_lab=3, side=2, mlp=[6])), examples, rate={"Adam": 0.05}.get(mode, 0.3))
    first = t.evaluate(examples)[0]
    for _ in range(steps):
        t.training_step(mode)
    assert t.evaluate(examples)[0] < (0.999 if mode == "RPROP" else 0.9) * first


def test_a_whole_run(spark, examples, tmp_path):
    config = NetworkConfig.parsed({"mode": "vect-scalar", "n_lab": 3, "side": 2, "mlp": [6], "dropout": [0.1]})
    t = trainer.Trainer(trainer.built(config), examples.where("key < 200"), examples.where("key >= 200"), n_batches=2, rate=0.4, decay=0.5, decay_every=6)
    log = t.run(12, evaluate_every=6, save_every=12, path=str(tmp_path)).orderBy("step").collect()
    assert [r["step"] for r in log] == list(range(1, 13)) and log[-1]["valid_error"] < 0.1 and log[0]["valid_loss"] is None
    assert [r["rate"] for r in log][4:7] == [0.4, 0.2, 0.2]
    sizes = [t.batch(k).count() for k in (0, 1)]
    assert sum(sizes) == 200 and min(sizes) > 60
    w = t.w
    t.reset()
    assert t.log == [] and t.steps == 0 and (t.w == t.net.initial(0)).all()
    t.load(f"{tmp_path}/step=12")
    assert (t.w == w).all() and math.isnan(trainer.Trainer(t.net, examples).evaluate()[0])
    with pytest.raises(ValueError, match="mode"):
        t.training_step("Newton")
    with pytest.raises(ValueError, match="weights"):
        trainer.Trainer(trainer.built(SEQUENCES), examples).load(f"{tmp_path}/step=12")


def test_partitions_add_up(examples):
    net = trainer.built(NetworkConfig(mode="vect-scalar", n_lab=3, side=2, mlp=[6]))
    w = net.initial(1)
    rows = examples.orderBy("key").collect()
    loss, g, n = net.loss_and_gradient(w, np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows]))
    got = nets.gradient(examples, net, w)
    assert n == got[2] == 240 and math.isclose(got[0], loss / n) and np.allclose(got[1], g / n)


def test_the_softmax_layer_agrees_with_its_older_form(examples):
    net = nets.Net((4,), [nets.Layer("dense", 4, 3, "linear")], 3)
    w = np.random.default_rng(7).normal(size=(5, 3))
    loss, g = optimise.loss_and_gradient(examples, 4, 3)(w)
    got = nets.gradient(examples, net, np.concatenate((w[:4].ravel(), w[4])))
    assert math.isclose(loss, got[0]) and np.allclose(np.concatenate((g[:4].ravel(), g[4])), got[1])


def test_a_profile_of_sizes(spark, tmp_path):
    table = trainer.profiled(spark, PIXELS, [2, 8, 12], str(tmp_path / "speed"))
    assert [(r["side"], r["pixels"]) for r in table.orderBy("side").collect()] == [(8, 512), (12, 1152)]
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "speed")).count() == 2
