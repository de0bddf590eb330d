"""Searches along many step lengths, bounds, and networks built again from their weights."""

import numpy as np
import pytest

from cubeloom.operators import nets, search
from cubeloom.plans import trainer
from cubeloom.plans.network import NetworkConfig


class Bowl:
    """A quadratic with its number of passes."""

    def __init__(self, n, seed=1):
        rng = np.random.default_rng(seed)
        a = rng.normal(size=(n, n))
        self.h, self.least, self.passes = a @ a.T + np.eye(n), rng.normal(size=n), 0

    def value(self, w):
        d = w - self.least
        return float(0.5 * d @ self.h @ d), self.h @ d

    def at(self, w):
        self.passes += 1
        return self.value(w)

    def along(self, trials, directions):
        self.passes += 1
        found = [self.value(w) for w in trials]
        return np.array([x for x, _ in found]), np.array([g @ d for (_, g), d in zip(found, directions, strict=True)])


@pytest.mark.parametrize("kind", ["CG", "LBFGS"])
def test_a_quadratic_is_solved_within_its_dimension(kind):
    bowl, s, w = Bowl(8), search.Search(kind, memory=8), np.zeros(8)
    for _ in range(8):
        w, loss = s.step(bowl.at, bowl.along, w, "same")
    assert loss < 1e-8 * bowl.value(np.zeros(8))[0] and np.allclose(w, bowl.least, atol=1e-4)
    assert bowl.passes <= 1 + 3 * 8


@pytest.mark.parametrize("n", [5, 9])
def test_bounds_hold_and_the_minimum_within_them_is_found(n):
    bowl, s = Bowl(n, seed=n), search.Search("LBFGS", low=-0.3, high=0.2)
    w = np.full(n, 5.0)
    for _ in range(60):
        w, loss = s.step(bowl.at, bowl.along, w, "same")
        assert (w >= -0.3).all() and (w <= 0.2).all()
    plain = np.zeros(n)
    for _ in range(20_000):
        plain = np.clip(plain - 0.5 / np.linalg.norm(bowl.h, 2) * bowl.value(plain)[1], -0.3, 0.2)
    assert np.isclose(loss, bowl.value(plain)[0], rtol=1e-6) and np.allclose(w, plain, atol=1e-3)
    with pytest.raises(ValueError):
        search.Search("CG", low=0.0)


def test_a_step_at_the_minimum_stays_there():
    bowl, s = Bowl(4), search.Search("LBFGS")
    w, loss = s.step(bowl.at, bowl.along, bowl.least.copy(), "same")
    assert (w == bowl.least).all() and loss == 0


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 4)) + np.array([[2, 0, 0, 1], [0, 2, 0, -1], [0, 0, 2, 0]])[y]
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(240)], "key long, features array<double>, label long").repartition(4)


def test_losses_along_a_direction_are_those_of_passes(examples):
    net = trainer.built(NetworkConfig(mode="vect-scalar", n_lab=3, side=2, mlp=[6]))
    w, d = net.initial(1), np.random.default_rng(2).normal(size=net.n_weights)
    trials = np.stack([w + t * d for t in (0.0, 0.1, 0.7)])
    losses, slopes = nets.along(examples, net, trials, np.stack([d] * 3))
    for x, loss, slope in zip(trials, losses, slopes, strict=True):
        a, g, _ = nets.gradient(examples, net, x)
        assert np.isclose(a, loss) and np.isclose(g @ d, slope)


@pytest.mark.parametrize("mode", ["CG", "LBFGS"])
def test_a_trainer_keeps_what_its_search_remembers(examples, mode):
    t = trainer.Trainer(trainer.built(NetworkConfig(mode="vect-scalar", n_lab=3, side=2, mlp=[6])), examples)
    losses = [t.training_step(mode) for _ in range(5)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.6 * losses[0] and len(t.state[mode].pairs) > 2
    t.reset()
    assert t.state == {}
    bounded = trainer.Trainer(t.net, examples, bounds=(-0.5, 0.5))
    for _ in range(3):
        bounded.training_step("LBFGS")
    assert np.abs(bounded.w).max() <= 0.5


def described(net):
    return net.shape, net.n_lab, net.target, [(x.kind, x.n_in, x.n_out, x.act, x.extent, x.pools, x.rate, x.pooling) for x in net.layers]


def test_a_network_is_built_again_from_its_weights(spark, tmp_path):
    rng = np.random.default_rng(3)
    config = NetworkConfig(mode="img-img", dims=3, n_lab=2, side=[4, 7, 7], filters=[[1, 2, 2], 2], pool=[[1, 2, 2], 1], n_filters=[3, 2], activation="relu")
    net = trainer.built(config)
    w = net.initial(4)
    path = trainer.saved_network(spark, net, w, str(tmp_path / "net"))
    again, v = trainer.loaded_network(spark, path)
    assert described(again) == described(net) and (v == w).all()
    larger, v = trainer.loaded_network(spark, path, (5, 14, 12))
    assert larger.shape == (1, 5, 13, 11) and larger.sizes == net.sizes
    x = rng.normal(size=(1, *larger.shape))
    whole = larger.forward(v, x)[0].reshape(4, 5, 4, 2)
    part = net.forward(w, x[:, :, :4, 2:9, 4:11])[0].reshape(3, 2, 2, 2)
    assert np.allclose(whole[:3, 1:3, 2:4], part)
    with pytest.raises(ValueError, match="fits"):
        trainer.loaded_network(spark, path, (1, 14, 12))
    for kinds in (NetworkConfig(mode="vect-scalar", n_lab=3, side=2, rnn=4, mlp=[3], dropout=[0.1, 0.2]), NetworkConfig(mode="img-scalar", n_lab=3, filters=[3], pool=[2], n_filters=[2], mlp=[4])):
        other = trainer.built(kinds, steps=5)
        assert described(trainer.loaded_network(spark, trainer.saved_network(spark, other, other.initial(1), str(tmp_path / "other")))[0]) == described(other)


def test_weights_fitted_to_another_network(spark, tmp_path, examples):
    small = trainer.built(NetworkConfig(mode="img-img", n_lab=2, side=8, filters=[3], pool=[1], n_filters=[2]))
    large = trainer.built(NetworkConfig(mode="img-img", n_lab=2, side=9, filters=[5, 2], pool=[1, 1], n_filters=[3, 2]))
    w, v = small.initial(1), large.initial(2)
    got = large.unpacked(trainer.adapted_weights(small, w, large, v))
    old, before = small.unpacked(w), large.unpacked(v)
    assert (got[0][0][:, :, 1:4, 1:4] == old[0][0][[0, 1, 0]]).all() and (got[0][0][:, :, 0] == before[0][0][:, :, 0]).all() and (got[0][1] == old[0][1][[0, 1, 0]]).all()
    back = small.unpacked(trainer.adapted_weights(large, v, small, w))
    assert (back[0][0] == before[0][0][:2, :, 1:4, 1:4]).all()
    first = large.unpacked(trainer.adapted_weights(small, w, large, v, 1))
    assert (first[1][0] == before[1][0]).all() and (first[0][1] == got[0][1]).all()
    t = trainer.Trainer(trainer.built(NetworkConfig(mode="vect-scalar", n_lab=3, side=2, mlp=[6])), examples)
    path = t.save(str(tmp_path / "w"))
    other = trainer.Trainer(trainer.built(NetworkConfig(mode="vect-scalar", n_lab=3, side=2, mlp=[8])), examples)
    with pytest.raises(ValueError, match="weights"):
        other.load(path)
    other.load(path, adapt=True)
    assert (other.net.unpacked(other.w)[0][0] == t.net.unpacked(t.w)[0][0][:, [0, 1, 2, 3, 4, 5, 0, 1]]).all()
