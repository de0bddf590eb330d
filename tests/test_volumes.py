"""Networks over volumes: convolutions, pools and gradients in three dimensions, and volumes run and trained on by tiles."""

import math

import numpy as np
import pytest

from cubeloom.operators import nets, tiles
from cubeloom.plans import trainer
from cubeloom.plans.network import NetworkConfig

VOLUME = NetworkConfig(mode="img-img", dims=3, n_lab=2, side=[6, 9, 9], filters=[[3, 2, 2], 2], pool=[[1, 2, 2], 1], n_filters=[3, 2])


def checked(net, x, y, key=None, step=None, tol=2e-4):
    w = net.initial(3) + 0.01
    loss, g, _ = net.loss_and_gradient(w, x, y, key, step)
    for i in np.random.default_rng(0).choice(len(w), min(60, len(w)), replace=False):
        d = np.zeros_like(w)
        d[i] = 1e-6
        slope = (net.loss_and_gradient(w + d, x, y, key, step)[0] - net.loss_and_gradient(w - d, x, y, key, step)[0]) / 2e-6
        assert math.isclose(slope, g[i], rel_tol=tol, abs_tol=2e-6), (i, slope, g[i])


def plain_conv(x, w):
    """Sum over channels and offsets, written out."""
    m, c, *n = x.shape
    k = w.shape[2:]
    out = [a - b + 1 for a, b in zip(n, k, strict=True)]
    z = np.zeros((m, len(w), *out))
    for at in np.ndindex(*out):
        for off in np.ndindex(*k):
            for f in range(len(w)):
                for ch in range(c):
                    z[(slice(None), f, *at)] += x[(slice(None), ch, *(a + e - 1 - o for a, e, o in zip(at, k, off, strict=True)))] * w[(f, ch, *off)]
    return z


@pytest.mark.parametrize("values", [10**9, 0])
def test_convolutions_over_two_and_three_axes(monkeypatch, values):
    monkeypatch.setattr(nets, "WINDOW_VALUES", values)
    rng = np.random.default_rng(1)
    for shape, k in (((2, 2, 5, 4, 6), (2, 3, 2)), ((1, 3, 6, 5), (3, 2))):
        x, w = rng.normal(size=shape), rng.normal(size=(3, shape[1], *k))
        assert np.allclose(nets.convolved(x, w), plain_conv(x, w))


@pytest.mark.parametrize("pooling", ["max", "maxabs"])
def test_pools_over_three_axes(pooling):
    z = np.random.default_rng(2).normal(size=(2, 2, 5, 4, 7))
    blocks = nets.pool_blocks(z, (2, 1, 3))
    best = np.take_along_axis(blocks, nets.pool_routes(blocks, pooling)[..., None], -1)[..., 0]
    for at in np.ndindex(2, 4, 2):
        block = z[:, :, at[0] * 2 : at[0] * 2 + 2, at[1] : at[1] + 1, at[2] * 3 : at[2] * 3 + 3].reshape(2, 2, -1)
        pick = (np.abs(block) if pooling == "maxabs" else block).argmax(axis=2)
        assert (best[(slice(None), slice(None), *at)] == np.take_along_axis(block, pick[..., None], 2)[..., 0]).all()
    assert (nets.unpooled(blocks, (2, 1, 3), z.shape)[:, :, :4, :, :6] == z[:, :, :4, :, :6]).all()


@pytest.mark.parametrize("act", ["tanh", "relu", "sigmoid", "abs", "linear"])
def test_gradients_over_volumes(act):
    rng = np.random.default_rng(3)
    net = trainer.built(NetworkConfig(**{**VOLUME.__dict__, "activation": act}))
    n_out = math.prod((a - f) // s + 1 for a, f, s in zip(net.shape[1:], net.field, net.strides, strict=True))
    checked(net, rng.normal(size=(2, math.prod(net.shape))), rng.integers(-1, 2, (2, n_out)))


def test_gradients_of_gated_pooled_scalar_and_maxabs_nets_over_volumes(monkeypatch):
    rng = np.random.default_rng(4)
    scalar = NetworkConfig(mode="img-scalar", dims=3, n_lab=3, side=[4, 7, 7], filters=[[1, 4, 2], [2, 1, 1]], pool=[[2, 2, 2], 1], n_filters=[2, 3], mlp=[4], dropout=[0.3, 0.0, 0.5])
    checked(trainer.built(scalar), rng.normal(size=(3, 196)), np.array([0, 2, -1]), np.arange(3), 5)
    net = nets.Net((1, 4, 5, 5), [nets.Layer("conv", 1, 2, "tanh", 2, (3, 2, 2), dims=3, pooling="maxabs"), nets.Layer("conv", 2, 2, "linear", dims=3)], 2)
    checked(net, rng.normal(size=(2, 100)), rng.integers(0, 2, (2, 4)))
    monkeypatch.setattr(nets, "WINDOW_VALUES", 0)
    checked(trainer.built(VOLUME), rng.normal(size=(2, 6 * 81)), rng.integers(-1, 2, (2, 27)))


def test_a_recurrent_layer_with_dropout():
    rng = np.random.default_rng(5)
    net = trainer.built(NetworkConfig(mode="vect-scalar", n_lab=3, side=2, rnn=4, mlp=[3], dropout=[0.5, 0.0]), steps=5)
    x, y = rng.normal(size=(4, 20)), np.array([0, 1, 2, 1])
    checked(net, x, y, np.arange(4), 3)
    assert net.loss_and_gradient(net.initial(3), x, y, np.arange(4), 3)[0] != net.loss_and_gradient(net.initial(3), x, y)[0]


def test_configurations_of_volumes():
    # A published boundary network: 25 x 25 outputs on 3 slices of an input of 127 x 127 x 7.
    net = trainer.built(NetworkConfig(mode="img-img", dims=3, n_lab=2, side=[7, 127, 127], filters=[[1, 4, 4], [1, 3, 3], [3, 3, 3], [3, 3, 3], [1, 2, 2]], pool=[[1, 2, 2], [1, 2, 2], 1, 1, 1], n_filters=[10, 25, 40, 50, 60]))
    assert net.strides == (1, 4, 4) and net.field == (5, 31, 31)
    z, kept = net.forward(net.initial(0), np.zeros((1, 7 * 127 * 127)))
    assert z.shape == (3 * 25 * 25, 2) and [k[2].shape[1:] for k in kept] == [(10, 7, 62, 62), (25, 7, 30, 30), (40, 5, 28, 28), (50, 3, 26, 26), (60, 3, 25, 25), (2, 3, 25, 25)]
    for wrong in ({"side": [7, 8]}, {"filters": [[2, 2]], "pool": [1], "n_filters": [1]}, {"dims": 4}, {"pool": [[1, 3, 3], 1]}, {"target": "malis", "mode": "img-scalar", "mlp": [2]}):
        with pytest.raises(ValueError):
            NetworkConfig(**{**VOLUME.__dict__, **wrong})


def fitted_net(extent, seed=6, n_lab=3):
    layers = [nets.Layer("conv", 1, 3, "tanh", (2, 3, 2), (2, 2, 1), dims=3), nets.Layer("conv", 3, 2, "tanh", (1, 2, 3), (1, 2, 2), dims=3), nets.Layer("conv", 2, n_lab, "linear", dims=3)]
    net = nets.Net((1, *extent), layers, n_lab)
    return net, net.initial(seed) + 0.05


def test_fragments_are_strides_are_shifted_patches():
    net, w = fitted_net((7, 14, 9))
    assert net.strides == (2, 4, 2) and net.field == (3, 8, 5)
    net = net.at(tuple(f + 2 * s - 1 for f, s in zip(net.field, net.strides, strict=True)))
    x = np.random.default_rng(7).normal(size=(2, *net.shape))
    by_fragments, by_strides = net.dense_by_fragments(w, x), net.dense_by_strides(w, x)
    assert by_fragments.shape == (2, 3, 4, 8, 4) and np.allclose(by_fragments, by_strides)
    one = net.at(net.field)
    for at in ((0, 0, 0), (3, 7, 2), (1, 5, 3)):
        patch = x[(slice(None), slice(None), *(slice(a, a + f) for a, f in zip(at, net.field, strict=True)))]
        assert np.allclose(one.forward(w, patch)[0], by_fragments[(slice(None), slice(None), *at)])
    with pytest.raises(ValueError, match="multiple"):
        net.at((8, 14, 9)).dense_by_fragments(w, np.zeros((1, 8 * 14 * 9)))


def as_pieces(spark, volumes, cuts):
    """Volumes (key -> channels, axes) cut into unlike pieces."""
    rows = []
    for key, v in volumes.items():
        edges = [[0, *c, n] for c, n in zip(cuts, v.shape[1:], strict=True)]
        for z0, z1 in zip(edges[0][:-1], edges[0][1:], strict=True):
            for x0, x1 in zip(edges[1][:-1], edges[1][1:], strict=True):
                for y0, y1 in zip(edges[2][:-1], edges[2][1:], strict=True):
                    rows.append((key, z0, x0, y0, z1 - z0, x1 - x0, y1 - y0, v[:, z0:z1, x0:x1, y0:y1].ravel().tolist()))
    return spark.createDataFrame(rows, tiles.PIECE).repartition(4)


def put_together(pieces, shape):
    out = {}
    for r in pieces.collect():
        v = out.setdefault(r["key"], np.full(shape, np.nan))
        place = tuple(slice(r[a], r[a] + r[n]) for a, n in zip(tiles.ORIGIN, tiles.EXTENT, strict=True))
        assert np.isnan(v[(slice(None), *place)]).all()
        v[(slice(None), *place)] = np.array(r["values"]).reshape(-1, *(r[n] for n in tiles.EXTENT))
    return out


@pytest.mark.parametrize("mirrored", [False, True])
def test_whole_volumes_by_tiles(spark, mirrored):
    rng, extent = np.random.default_rng(8), (8, 15, 11)
    volumes = {k: rng.normal(size=(1, *extent)) for k in (3, 9)}
    pieces = as_pieces(spark, volumes, ([1, 5], [4, 9], [7]))
    net, w = fitted_net(extent)
    lead = [(f - 1) // 2 for f in net.field] if mirrored else [0, 0, 0]
    result = [n + 2 * e - f + 1 for n, e, f in zip(extent, lead, net.field, strict=True)]
    grown = [-(-r // s) * s + f - 1 for r, s, f in zip(result, net.strides, net.field, strict=True)]
    found = {how: put_together(tiles.predicted(pieces, extent, net, w, (2, 4, 6), how, mirrored), (3, *result)) for how in ("fragments", "strides")}
    for key, v in volumes.items():
        v = np.pad(v, [(0, 0), *((e, e) for e in lead)], mode="symmetric")
        v = np.pad(v, [(0, 0), *((0, g - n) for g, n in zip(grown, v.shape[1:], strict=True))])
        z = net.at(tuple(grown)).dense_by_fragments(w, v[None])[0][(slice(None), *map(slice, result))]
        p = nets.probabilities_of(z.reshape(3, -1).T, "nll").T.reshape(3, *result)
        for how, got in found.items():
            assert got.keys() == volumes.keys() and np.allclose(got[key], p), how


def test_planes_and_bad_tiles(spark):
    rng, extent = np.random.default_rng(9), (1, 9, 8)
    net = trainer.built(NetworkConfig(mode="img-img", n_lab=2, side=8, filters=[3, 2], pool=[2, 1], n_filters=[3, 2]))
    w, v = net.initial(1), {1: rng.normal(size=(1, *extent))}
    pieces = as_pieces(spark, v, ([], [5], []))
    got = put_together(tiles.predicted(pieces, extent, net, w, (1, 2, 4)), (2, 1, 9 - 5, 8 - 5))
    whole = net.at((9, 8 + 1)).dense_by_fragments(w, np.pad(v[1][:, 0], [(0, 0), (0, 0), (0, 1)])[None])[0][:, :, :3]
    assert np.allclose(got[1][:, 0], nets.probabilities_of(whole.reshape(2, -1).T, "nll").T.reshape(2, 4, 3))
    for own, size in (((1, 3, 2), extent), ((1, 2, 2), (1, 4, 4))):
        with pytest.raises(ValueError):
            tiles.predicted(pieces, size, net, w, own)
    assert tiles.predicted(pieces.limit(0), extent, net, w, (1, 2, 4)).count() == 0


def test_gradients_of_tiles_add_up_to_the_volume(spark):
    rng, extent = np.random.default_rng(10), (7, 15, 12)
    net, w = fitted_net(extent, n_lab=2)
    volumes = {k: rng.normal(size=(1, *extent)) for k in (0, 4)}
    labels = {k: rng.integers(-1, 2, (1, *extent)).astype(float) for k in volumes}
    own = (2, 4, 4)
    found = tiles.examples(as_pieces(spark, volumes, ([3], [], [2, 9])), as_pieces(spark, labels, ([], [8], [5])), extent, net, own)
    loss, g, n = nets.gradient(found, net.at(tiles.example_extent(net, own)), w)
    assert len({r["key"] for r in found.collect()}) == found.count() == 2 * 3 * 2 * 2
    total, by_w, count = 0.0, np.zeros_like(w), 0
    result = [a - f + 1 for a, f in zip(extent, net.field, strict=True)]
    n_out = [(r - 1) // s + 1 for r, s in zip(result, net.strides, strict=True)]
    fit = net.at(tuple((o - 1) * s + f for o, s, f in zip(n_out, net.strides, net.field, strict=True)))
    for k, v in volumes.items():
        mid = [(f - 1) // 2 for f in net.field]
        y = labels[k][0][tuple(slice(m, m + r, s) for m, r, s in zip(mid, result, net.strides, strict=True))]
        a, b, c = fit.loss_and_gradient(w, v[(slice(None), *map(slice, fit.shape[1:]))][None], y.reshape(1, -1))
        total, by_w, count = total + a, by_w + b, count + c
    assert n == count and math.isclose(loss, total / count) and np.allclose(g, by_w / count)


def test_training_on_tiles_lowers_the_loss(spark):
    rng, extent = np.random.default_rng(11), (6, 10, 10)
    volumes = {k: rng.normal(size=(1, *extent)) for k in range(3)}
    labels = {k: (v > 0).astype(float) for k, v in volumes.items()}
    net = nets.Net((1, *extent), [nets.Layer("conv", 1, 4, "tanh", (1, 3, 3), dims=3), nets.Layer("conv", 4, 2, "linear", dims=3)], 2)
    own = (2, 4, 4)
    found = tiles.examples(as_pieces(spark, volumes, ([], [], [])), as_pieces(spark, labels, ([], [], [])), extent, net, own)
    t = trainer.Trainer(net.at(tiles.example_extent(net, own)), found, rate=1.0)
    first = t.evaluate(found)
    for _ in range(12):
        t.training_step("SGD")
    last = t.evaluate(found)
    assert last[0] < 0.6 * first[0] and last[1] < 0.2


def test_voxels_of_pieces(spark):
    v = np.random.default_rng(12).random((2, 3, 4, 5))
    got = tiles.voxels(as_pieces(spark, {7: v}, ([1], [], [2])), digits=6)
    assert {(r["key"], r["c"], r["z"], r["x"], r["y"]): r["p"] for r in got.collect()} == {(7, *at): round(v[at], 6) for at in np.ndindex(*v.shape)}
    as_bytes = tiles.voxels(as_pieces(spark, {7: v}, ([1], [], [2])), as_uint8=True)
    assert {r["p"] for r in as_bytes.collect()} <= set(range(256))


# affinities


def test_malis_and_affinity_gradients():
    rng = np.random.default_rng(13)
    config = NetworkConfig(mode="img-img", dims=3, n_lab=2, side=[3, 5, 5], filters=[2], pool=[1], n_filters=[3], target="affinity")
    net = trainer.built(config)
    y = rng.integers(0, 2, (2, 2 * 4 * 4, 3))
    checked(net, rng.normal(size=(2, 75)), y)
    net = trainer.built(config, "malis")
    x, seg = rng.normal(size=(2, 75)), rng.integers(0, 3, (2, 32))
    # Counts of pairs are held while the slope is taken.
    w = net.initial(3) + 0.01
    z = net.forward(w, x)[0]
    loss, slope, known = nets.malis_loss(z, seg, 2, (2, 4, 4))
    assert known.all() and (loss > 0).all()
    axis, a, b = nets.lattice_edges((2, 4, 4))
    p = nets.probabilities_of(z, "malis").reshape(2, 32, 3, 2)
    for i in range(2):
        pos, neg = nets.pair_counts(a, b, p[i, a, axis, 1], seg[i, a], seg[i, b])

        def held(z, i=i, pos=pos, neg=neg):
            q = nets.probabilities_of(z, "malis").reshape(2, 32, 3, 2)[i]
            return (-pos * np.log(q[a, axis, 1]) - neg * np.log(q[a, axis, 0])).sum() / (pos.sum() + neg.sum() + 1e-6)

        assert math.isclose(held(z), loss[i])
        for r in rng.choice(32, 6, replace=False):
            for c in range(6):
                d = np.zeros_like(z)
                d[i * 32 + r, c] = 1e-6
                assert math.isclose((held(z + d) - held(z - d)) / 2e-6, slope[i * 32 + r, c], abs_tol=1e-7)


def test_training_by_malis_lowers_its_loss(spark):
    rng = np.random.default_rng(14)
    seg = np.zeros((6, 4, 6, 6), int)
    seg[:, :, :3, :] = 1
    seg[:, :, 4:, :] = 2
    image = (seg > 0) + rng.normal(size=seg.shape) * 0.1
    net = nets.Net((1, 4, 6, 6), [nets.Layer("conv", 1, 4, "tanh", (1, 2, 2), dims=3), nets.Layer("conv", 4, 6, "linear", dims=3)], 2, "malis")
    rows = spark.createDataFrame([(k, image[k].ravel().tolist(), seg[k][:, :5, :5].ravel().tolist()) for k in range(6)], "key long, features array<double>, label array<long>")
    t = trainer.Trainer(net, rows, rate=0.5)
    first = t.evaluate(rows)[0]
    for _ in range(10):
        t.training_step("SGD")
    assert t.evaluate(rows)[0] < 0.7 * first


# weighted, lazy and propagated labels


def finite(net, x, y, **more):
    w = net.initial(3) + 0.01
    loss, g, n = net.loss_and_gradient(w, x, y, **more)
    for i in np.random.default_rng(0).choice(len(w), min(40, len(w)), replace=False):
        d = np.zeros_like(w)
        d[i] = 1e-6
        slope = (net.loss_and_gradient(w + d, x, y, **more)[0] - net.loss_and_gradient(w - d, x, y, **more)[0]) / 2e-6
        assert math.isclose(slope, g[i], rel_tol=2e-4, abs_tol=2e-6)
    return loss, n


def test_gradients_of_weighted_lazy_and_propagated_labels():
    rng = np.random.default_rng(15)
    layers = [nets.Layer("conv", 1, 3, "tanh", (1, 2, 2), dims=3), nets.Layer("conv", 3, 3, "linear", dims=3)]
    x, y = rng.normal(size=(2, 48)), rng.integers(-1, 3, (2, 27))
    masks, weights = rng.integers(0, 2, (2, 6)) * 1.0, rng.random((2, 27)) + 0.5
    for how in ({"class_weights": (1.0, 0.5, 2.0)}, {"lazy": True}, {"weighted": True}, {"label_prop": 0.35}, {"lazy": True, "label_prop": 0.35, "weighted": True, "class_weights": (0.9, 0.8, 0.7)}):
        net = nets.Net((1, 3, 4, 4), layers, 3, **how)
        more = {"masks": masks} if net.lazy else {}
        loss, n = finite(net, x, y, **more, **({"weights": weights} if net.weighted else {}))
        assert loss > 0 and n > 0
    plain, voted = nets.Net((1, 3, 4, 4), layers, 3), nets.Net((1, 3, 4, 4), layers, 3, class_weights=(1.0, 1.0, 1.0))
    w = plain.initial(1)
    a, b = plain.loss_and_gradient(w, x, y), voted.loss_and_gradient(w, x, y)
    assert math.isclose(a[0], b[0]) and np.allclose(a[1], b[1]) and a[2] == b[2]
    with pytest.raises(ValueError, match="nll"):
        nets.Net((1, 3, 4, 4), layers, 3, "regression", lazy=True)


def test_training_with_lazy_labels(spark):
    rng = np.random.default_rng(16)
    net = trainer.built(NetworkConfig(mode="img-img", n_lab=2, side=5, filters=[2], pool=[1], n_filters=[3], lazy_labels=True))
    rows = [(k, rng.normal(size=25).tolist(), rng.integers(0, 2, 16).tolist(), [float(k % 2), 0.0, 0.0, float(k % 3 == 0)]) for k in range(12)]
    df = spark.createDataFrame(rows, "key long, features array<double>, label array<long>, masks array<double>")
    t = trainer.Trainer(net, df, n_batches=2, rate=0.3)
    first = t.evaluate(df)[0]
    for _ in range(10):
        t.training_step("SGD")
    assert t.evaluate(df)[0] < first


def test_sums_in_slices(spark, monkeypatch):
    monkeypatch.setattr(nets, "SUM_VALUES", 7)
    rng = np.random.default_rng(17)
    net = trainer.built(NetworkConfig(mode="vect-scalar", n_lab=3, side=2, mlp=[6]))
    x, y, w = rng.normal(size=(50, 4)), rng.integers(0, 3, 50), net.initial(1)
    df = spark.createDataFrame([(k, x[k].tolist(), int(y[k])) for k in range(50)], "key long, features array<double>, label long").repartition(9)
    loss, g, n = net.loss_and_gradient(w, x, y)
    got = nets.gradient(df, net, w)
    assert n == got[2] and math.isclose(got[0], loss / n) and np.allclose(got[1], g / n)


def test_activations_and_pooling_by_configuration():
    config = NetworkConfig(mode="img-scalar", dims=3, n_lab=2, side=[3, 5, 5], filters=[[2, 2, 2]], pool=[[1, 2, 2]], n_filters=[2], mlp=[3], activation=["abs", "sigmoid"], pooling="maxabs")
    net = trainer.built(config)
    assert [x.act for x in net.layers] == ["abs", "sigmoid", "linear"] and net.layers[0].pooling == "maxabs"
    checked(net, np.random.default_rng(18).normal(size=(3, 75)), np.array([0, 1, -1]))
    for wrong in ({"activation": ["abs"]}, {"activation": ["abs", "cube"]}, {"pooling": "mean"}):
        with pytest.raises(ValueError):
            NetworkConfig(**{**config.__dict__, **wrong})


def test_fragments_take_a_fraction_of_the_strided_time():
    """Two pools of two along two axes: 16 shifts, each the whole network, against one pass."""
    import time

    net = nets.Net((1, 4, 48, 48), [nets.Layer("conv", 1, 6, "tanh", (1, 3, 3), (1, 2, 2), dims=3), nets.Layer("conv", 6, 8, "tanh", (1, 3, 3), (1, 2, 2), dims=3), nets.Layer("conv", 8, 2, "linear", dims=3)], 2)
    net = net.at((4, net.field[1] + 31, net.field[2] + 31))
    w, x = net.initial(1), np.random.default_rng(19).normal(size=(1, *net.shape))
    took = {}
    for name in ("dense_by_strides", "dense_by_fragments", "dense_by_strides", "dense_by_fragments"):
        began = time.process_time()
        out = getattr(net, name)(w, x)
        took[name] = time.process_time() - began
    assert out.shape == (1, 2, 4, 32, 32) and took["dense_by_strides"] > 2 * took["dense_by_fragments"], took


def test_small_tiles_travel_joined(spark, monkeypatch):
    """Neighbours share a halo and a call; examples and probabilities are those of tiles on their own."""
    plan = tiles.Plan((8, 8, 8), (2, 2, 2), (5, 5, 5), (2, 2, 2))
    assert plan.joined().own == (8, 8, 8) and plan.joined(400) == plan
    rng, extent = np.random.default_rng(13), (7, 9, 8)
    net, w = fitted_net(extent, n_lab=2)
    volumes = {k: rng.normal(size=(1, *extent)) for k in (2, 5)}
    pieces, own = as_pieces(spark, volumes, ([3], [], [5])), (2, 4, 2)
    labels = as_pieces(spark, {k: (v > 0).astype(float) for k, v in volumes.items()}, ([], [4], []))
    assert tiles.parts(pieces, tiles.Plan(extent, own, tuple(f - 1 for f in net.field)).joined()).count() < tiles.parts(pieces, tiles.Plan(extent, own, tuple(f - 1 for f in net.field))).count()

    def found():
        p = put_together(tiles.predicted(pieces, extent, net, w, own), (2, *(n - f + 1 for n, f in zip(extent, net.field, strict=True))))
        return p, {r["key"]: (r["features"], r["label"]) for r in tiles.examples(pieces, labels, extent, net, own).collect()}

    p, joined = found()
    monkeypatch.setattr(tiles, "TILE_VALUES", 1)
    q, alone = found()
    assert joined == alone and all(np.allclose(p[k], q[k]) for k in volumes)


def test_validation_examples_are_made_once(spark):
    """An evaluation reads them several times, and there are many evaluations."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(k, [float(k % 3), 1.0], k % 2) for k in range(20)]
    examples = spark.createDataFrame(rows, "key long, features array<double>, label long")
    t = trainer.Trainer(nets.Net((2,), [nets.Layer("dense", 2, 2, "linear")], 2), examples, examples.mapInArrow(count, examples.schema))
    assert t.evaluate() == t.evaluate() and made.value == 20
