"""Whole batches from volumes against plain cuts, turns and warps of arrays."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.operators import augment, batches, nets
from cubeloom.operators.reshape import TRANSPOSES
from cubeloom.plans import trainer
from cubeloom.sources import tables
from test_volumes import as_pieces

EXTENT = (6, 9, 9)
GRID = (3, 4, 9)
CUTS = ([3], [4, 8], [])


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(1)
    images = {k: rng.random((2, *EXTENT)) for k in range(3)}
    labels = {k: rng.integers(-1, 3, (1, *EXTENT)).astype(float) for k in images}
    labels[2][:] = -1  # nothing known there
    return images, labels


@pytest.fixture(scope="module")
def volumes(spark, arrays):
    images, labels = arrays
    shares = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.5, 0.9), (2, 0.9, 1.0)], "key long, lo double, hi double")
    pieces = as_pieces(spark, images, CUTS)
    return batches.Volumes(pieces, as_pieces(spark, labels, CUTS), batches.cubes_of(pieces, shares, EXTENT), GRID, 2)


def plain(plan, arrays, draw):
    """A draw by cutting, transposing, mirroring and grading whole arrays; None where it is refused."""
    u = lambda name, *k: batches.uniform(plan.seed + name, *k)
    share = u("cube", draw)
    key = 0 if share < 0.5 else 1 if share < 0.9 else 2
    image, label = arrays[0][key], arrays[1][key][0]
    inner = lambda a: a[tuple(slice(i, n - i) for i, n in zip(plan.inset, a.shape, strict=True))]
    for attempt in range(batches.TRIES if plan.most_unlabelled else 1):
        order = (0, 1, 2)
        if plan.planes and not plan.aniso:
            fit = [t for t in TRANSPOSES if EXTENT[t[1]] >= plan.patch[1] and EXTENT[t[2]] >= plan.patch[2]]
            order = fit[int(u("order", draw, attempt) * len(fit))]
        im, la = image.transpose(0, *(1 + a for a in order)), label.transpose(order)
        o = [int(u(a, draw, attempt) * (n if plan.planes and a == "z" else n - p)) for a, n, p in zip("zxy", la.shape, plan.patch, strict=True)]
        where = tuple(slice(a, a + p) for a, p in zip(o, plan.patch, strict=True))
        x, y = im[(slice(None), *where)], la[where]
        if not plan.most_unlabelled or (inner(y) < 0).mean() <= plan.most_unlabelled:
            break
    y = inner(y)
    if plan.most_unlabelled and (y < 0).mean() > plan.most_unlabelled:
        return None
    if plan.flip:
        if plan.planes and plan.upright:
            swap, mirrored = (0, 1, 2), [False, False, u("my", draw) < 0.5]
        else:
            mirrored = [u(f"m{a}", draw) < 0.5 and not (plan.planes and a == "z") for a in "zxy"]
            swap = batches.AXIS_ORDERS[int(u("swap", draw) * 6)] if not plan.planes and not plan.aniso else (0, 2, 1) if u("swap", draw) < 0.5 else (0, 1, 2)
        axes = [i for i, m in enumerate(mirrored) if m]
        x, y = np.flip(x.transpose(0, *(1 + a for a in swap)), [1 + a for a in axes]), np.flip(y.transpose(swap), axes)
    x = x.copy()
    for ch in plan.grey:
        a, c, g = (u(f"grey{n}", draw, ch) for n in "acg")
        x[ch] = np.clip(x[ch] * (1 + (a - 0.5) * 0.3) + (c - 0.5) * 0.3, 0, 1) ** 2.0 ** (2 * g - 1)
    y = y[tuple(slice(None, None, s) for s in plan.strides)]
    if plan.affinity == "affinity":
        out = np.zeros((*y.shape, 3))
        for at in np.ndindex(*y.shape):
            for axis in range(3):
                ahead = tuple(a + (i == axis) for i, a in enumerate(at))
                if ahead[axis] < y.shape[axis]:
                    out[(*at, axis)] = y[at] == y[ahead] and y[at] > 0
        y = out
    return key, x.ravel(), y.ravel()


PLANS = {
    "volumes": batches.Plan((3, 3, 3), (1, 1, 1), most_unlabelled=0.2, aniso=False, grey=(1,)),
    "anisotropic": batches.Plan((2, 5, 5), (0, 1, 1), (1, 2, 2), grey=(0, 1)),
    "planes": batches.Plan((1, 4, 4), (0, 1, 1), (1, 2, 2), most_unlabelled=0.3, aniso=False),
    "slices": batches.Plan((1, 9, 9), (0, 2, 2)),
    "upright": batches.Plan((1, 3, 5), flip=False, upright=True, seed="other"),
    "upright flips": batches.Plan((1, 5, 5), upright=True),
    "whole": batches.Plan(EXTENT),
    "affinities": batches.Plan((3, 5, 5), (0, 1, 1), affinity="affinity"),
    "segments": batches.Plan((3, 5, 5), (0, 1, 1), affinity="malis", flip=False),
}


@pytest.mark.parametrize("name", PLANS)
def test_draws_are_plain_cuts(volumes, arrays, name):
    plan, n = PLANS[name], 40
    got = {r["draw"]: r for r in batches.patches(volumes, plan, 0, n).collect()}
    expected = {d: p for d in range(n) if (p := plain(plan, arrays, d)) is not None}
    assert got.keys() == expected.keys() and (len(got) < n if plan.most_unlabelled else len(got) == n)
    for d, (key, x, y) in expected.items():
        assert got[d]["key"] == key and np.allclose(got[d]["features"], x) and got[d]["label"] == y.astype(int).tolist(), d
        assert (len(got[d]["features"]), len(got[d]["label"])) == batches.example_size(plan, 2)


def test_a_known_absent_class_lets_unlabelled_patches_pass(spark, volumes):
    plan = batches.Plan((3, 3, 3), most_unlabelled=0.1)
    some = batches.Volumes(volumes.images, volumes.labels, volumes.cubes.withColumn("absent", F.col("key") == 2), GRID, 2)
    keys = {r["key"] for r in batches.patches(some, plan, 0, 60).collect()}
    assert 2 in keys and 2 not in {r["key"] for r in batches.patches(volumes, plan, 0, 60).collect()}


@pytest.mark.parametrize("dims", [2, 3])
def test_warps_are_those_of_the_relational_form(spark, dims):
    plan = batches.Plan((1, 6, 6) if dims == 2 else (6, 6, 6), warp=1.0, flip=False, seed="warp")
    df = augment.warp_params(spark.range(12).withColumnRenamed("id", "key"), "key", "warp", dims=dims)
    found = (augment.warp_map_2d if dims == 2 else augment.warp_map_3d)(df, 10, 6)
    n = 0
    for r in found.collect():
        w = batches.warp_of(plan, r["key"])
        size, lead = ((1, 10, 10), (0, 2, 2)) if dims == 2 else ((10,) * 3, (2,) * 3)
        at = np.array([[0 if dims == 2 else r["tz"]], [r["tx"]], [r["ty"]]], float)
        z, x, y = np.trunc(batches.warped(at, size, lead, w) + 0.5).astype(int)[:, 0]
        assert (x, y) == (r["x"], r["y"]) and (dims == 2 or z == r["z"])
        n += 1
    assert n == 12 * 6**dims
    if dims == 2:
        for r in augment.required_size(df, "key", 6).collect():
            assert batches.needed((1, 6, 6), batches.warp_of(plan, r["key"])) == (1, r["req_x"], r["req_y"])


def test_warped_patches(volumes, arrays):
    plan = batches.Plan((2, 5, 5), (0, 1, 1), warp=0.6, amount=0.5, flip=False)
    got = {r["draw"]: r for r in batches.patches(volumes, plan, 0, 40).collect()}
    kinds = {"warped": 0, "not drawn": 0, "too large": 0}
    for d, r in got.items():
        at = batches.place(plan, EXTENT, d, 0)
        kinds["not drawn" if batches.warp_of(plan, d) is None else "warped" if at.warp else "too large"] += 1
        image, label = arrays[0][r["key"]], arrays[1][r["key"]][0]
        x, y = np.zeros((2, 2, 5, 5)), np.zeros((2, 5, 5))
        for t in itertools.product(range(2), range(5), range(5)):
            s = t
            if at.warp:
                lead = tuple((a - p) // 2 for a, p in zip(at.size, plan.patch, strict=True))
                s = tuple(int(v) for v in np.trunc(batches.warped(np.array(t, float)[:, None], at.size, lead, at.warp)[:, 0] + 0.5))
            if all(0 <= a < n for a, n in zip(s, at.size, strict=True)):
                place = tuple(a + o for a, o in zip(s, at.origin, strict=True))
                x[(slice(None), *t)] = image[(slice(None), *place)]
                if all(i <= a < n - i for a, i, n in zip(s, plan.inset, at.size, strict=True)):
                    y[t] = label[place]
        assert np.allclose(r["features"], x.ravel()) and r["label"] == y[:, 1:4, 1:4].astype(int).ravel().tolist()
    assert kinds["warped"] and kinds["not drawn"]


def test_a_stream_of_batches(volumes):
    plan = batches.Plan((3, 3, 3), most_unlabelled=0.25)
    short, long = batches.Stream(volumes, plan, 7, range_draws=10), batches.Stream(volumes, plan, 7, range_draws=64)
    rows = lambda s, k: [(r["key"], r["draw"], r["features"], r["label"]) for r in s.batch(k).orderBy("key").collect()]
    for k in (0, 1, 3):
        assert rows(short, k) == rows(long, k) and [r[0] for r in rows(short, k)] == list(range(7 * k, 7 * k + 7))
    draws = [r[1] for k in range(4) for r in rows(short, k)]
    assert draws == sorted(set(draws))


def test_a_stream_that_cannot_be_filled(spark, volumes, arrays):
    blank = batches.Volumes(volumes.images, as_pieces(spark, {k: np.full_like(v, -1) for k, v in arrays[1].items()}, CUTS), volumes.cubes, GRID, 2)
    with pytest.raises(ValueError, match="labels"):
        batches.Stream(blank, batches.Plan((3, 3, 3), most_unlabelled=0.1), 4, range_draws=8, most_empty=2).batch(0)


def test_bad_plans_and_small_volumes(volumes):
    for wrong in ({"patch": (1, 3, 4)}, {"patch": (2, 3, 3), "aniso": False}, {"patch": (1, 3, 3), "affinity": "both"}):
        with pytest.raises(ValueError):
            batches.Plan(**wrong)
    with pytest.raises(ValueError, match="smaller"):
        batches.place(batches.Plan((7, 3, 3), flip=False), EXTENT, 0, 0)


def test_training_on_a_stream(spark):
    rng = np.random.default_rng(5)
    images = {k: rng.normal(size=(1, 6, 9, 9)) for k in range(2)}
    pieces, labels = as_pieces(spark, images, CUTS), as_pieces(spark, {k: (v > 0).astype(float) for k, v in images.items()}, CUTS)
    shares = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.5, 1.0)], "key long, lo double, hi double")
    stream = batches.Stream(batches.Volumes(pieces, labels, batches.cubes_of(pieces, shares, EXTENT), GRID), batches.Plan((3, 5, 5), (0, 1, 1)), 6, range_draws=96)
    net = nets.Net((1, 3, 5, 5), [nets.Layer("conv", 1, 4, "tanh", (1, 3, 3), dims=3), nets.Layer("conv", 4, 2, "linear", dims=3)], 2)
    t = trainer.Trainer(net, stream, rate=1.0)
    judged = stream.batch(15)
    first = t.evaluate(judged)[0]
    log = t.run(14).orderBy("step").collect()
    assert len(log) == 14 and t.evaluate(judged)[0] < 0.7 * first


def test_draws_match_the_columns(spark):
    from cubeloom.functions.keyed import uniform

    got = spark.range(50).select("id", uniform("s", F.col("id"), F.lit(3)).alias("u")).collect()
    assert all(r["u"] == batches.uniform("s", r["id"], 3) for r in got) and tables.SIDE == 8


def test_only_touched_cells_are_grouped(spark):
    """One box in one of 50 volumes: the others' pieces meet no call."""
    import pyarrow as pa

    from cubeloom.operators import batches, tiles

    calls = spark.sparkContext.accumulator(0)
    pieces = spark.createDataFrame([(k, 0, 0, 0, 1, 2, 2, [float(k)] * 4) for k in range(50)], tiles.PIECE)
    boxes = spark.createDataFrame([(0, 0, 7, 0, 0, 0, 0, 1, 1, 1)], batches.BOX)

    def run(boxes, found):
        calls.add(1)
        return pa.table({"draw": boxes.column("draw"), "v": [float(found[0][1].sum())] * boxes.num_rows if found else pa.array([], pa.float64())})

    assert [tuple(r) for r in batches._by_cell(boxes, pieces, (2, 2, 2), run, "draw long, v double").collect()] == [(0, 28.0)]
    assert calls.value == 1
