"""Whole training batches from volumes: an endless stream of numbered draws, each a patch with its labels, cut, warped, mirrored and graded.

A draw is a number; every choice in it is a keyed hash of that number (and of the attempt), so any range of draws can be made by any task, again and alike.
Volumes and labels are pieces (tiles.py) on a regular grid. Where patches may not have too many unlabelled positions, a draw has TRIES places, of which the first
that fits is taken; their counts come from prefix sums in each grid cell, so no voxel is copied for a place that is not taken. Only the taken boxes' parts are
shuffled, by draw, and a task makes one patch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, pi, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import uniform as uniform_column
from ..sources.tables import indexed, written
from . import tiles
from .reshape import TRANSPOSES
from .sampling import drawn_from

#: Places that are looked at for one patch; the last is taken if none fits.
TRIES = 11
AXIS_ORDERS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))
CELL = ("cz", "cx", "cy")


def uniform(seed: str, *key) -> float:
    """functions.keyed.uniform of numbers."""
    return int(hashlib.md5(":".join((seed, *map(str, key))).encode()).hexdigest()[:8], 16) / 4294967296.0


@dataclass(frozen=True)
class Plan:
    """What a batch's examples are. Extents are z, x, y; a patch of depth 1 is a plane.

    inset: what the label lacks on each side; strides: every how many positions it is kept. most_unlabelled: share of labels below 0 from which a patch is
    refused (0: none is). warp: share of examples that are warped, by amount. aniso: axes x and y may be swapped, but not z; else planes are cut across
    any axis too. upright: only y is mirrored (planes). grey: channels with drawn contrast, brightness and gamma. affinity: labels are segments, given as whether neighbours
    along each axis are of one (affinity), or as they are (malis).
    """

    patch: tuple[int, int, int]
    inset: tuple[int, int, int] = (0, 0, 0)
    strides: tuple[int, int, int] = (1, 1, 1)
    most_unlabelled: float = 0.0
    warp: float = 0.0
    amount: float = 1.0
    flip: bool = True
    aniso: bool = True
    upright: bool = False
    grey: tuple[int, ...] = ()
    affinity: str | None = None
    seed: str = "batch"

    def __post_init__(self) -> None:
        if self.flip and self.patch[1] != self.patch[2] or self.flip and not self.aniso and not self.planes and len(set(self.patch)) > 1:
            raise ValueError("axes that may be swapped must be of one extent")
        if self.affinity not in (None, "affinity", "malis"):
            raise ValueError("affinity must be None, affinity or malis")

    @property
    def planes(self) -> bool:
        return self.patch[0] == 1

    def u(self, name: str, *key) -> float:
        return uniform(self.seed + name, *key)


@dataclass(frozen=True)
class Place:
    """Where a draw's patch is cut: axes of the volume in the patch's order, first position and extent in that order, and how it is warped, if at all."""

    order: tuple[int, int, int]
    origin: tuple[int, ...]
    size: tuple[int, ...]
    warp: dict | None

    def box(self, inset: tuple[int, ...] = (0, 0, 0)) -> tuple[list[int], list[int]]:
        """(origin, extents) on the volume's own axes, less an inset of the patch's axes."""
        at, n = [0, 0, 0], [0, 0, 0]
        for i, axis in enumerate(self.order):
            at[axis], n[axis] = self.origin[i] + inset[i], self.size[i] - 2 * inset[i]
        return at, n


def warp_of(plan: Plan, draw: int) -> dict | None:
    """Drawn warping parameters, in degrees and ratios; None for draws that are not warped."""
    if plan.warp <= 0 or plan.warp < 1 and plan.u("gate", draw) >= plan.warp:
        return None
    rot, shear, scale, stretch = 15.0 * plan.amount, 3.0 * plan.amount, 1.1 * plan.amount, 0.1 * plan.amount  # fixed values: largest warps
    both = lambda name, most: most * 2.0 * (plan.u(name, draw) - 0.5)
    if plan.planes:
        return {"rot": both("rot", rot), "twist": 0.0, "shear": both("shear", shear), "scale": (1.0, 1.0 + (scale - 1.0) * plan.u("scale1", draw), 1.0), "stretch": (both("stretch0", stretch), both("stretch1", stretch), 0.0, 0.0)}
    twist = both("twist", rot)
    return {"rot": min(rot - abs(twist), rot * plan.u("rot", draw)), "twist": twist, "shear": both("shear", shear), "scale": tuple(1.0 + (scale - 1.0) * plan.u(f"scale{a}", draw) for a in "012"), "stretch": tuple(both(f"stretch{a}", stretch) for a in "0123")}


def warped(at: np.ndarray, size: tuple[int, ...], lead: tuple[int, ...], warp: dict) -> np.ndarray:
    """Source positions (3, ...) in a cut of size of the target positions at, which lie lead inside it."""
    c = [n / 2 - 0.5 for n in size]
    z, x, y = (v + e - m for v, e, m in zip(at, lead, c, strict=True))
    safe = [m or 1.0 for m in c]
    (s0, s1, s2), (t0, t1, t2, t3) = warp["scale"], warp["stretch"]
    rot, shear = warp["rot"] * (pi / 180) + z * (warp["twist"] * (pi / 180) / safe[0]), warp["shear"] * (pi / 180)
    xt = x * (1.0 / s0 + (t0 / safe[1] * y + t2 / safe[0] * z))
    yt = y * (1.0 / s1 + (t1 / safe[2] * x + t3 / safe[0] * z))
    u = xt * np.cos(rot - shear) - yt * np.sin(rot + shear) + c[1]
    v = yt * np.cos(rot + shear) + xt * np.sin(rot - shear) + c[2]
    return np.stack((z / s2 + c[0], u, v))


def needed(patch: tuple[int, ...], warp: dict) -> tuple[int, ...]:
    """The extent to cut, so that a warped patch lies inside: from its corners, grown alike on both sides."""
    corners = np.array(np.meshgrid(*((0, n - 1) for n in patch), indexing="ij")).reshape(3, -1).astype(float)
    at = warped(corners, patch, (0, 0, 0), warp)
    grow = [max(floor(abs(min(v.min(), 0.0))), ceil(max(v.max() - n + 1, 0.0))) for v, n in zip(at, patch, strict=True)]
    return tuple(n + 2 * g for n, g in zip(patch, grow, strict=True))


def place(plan: Plan, extent: tuple[int, int, int], draw: int, attempt: int) -> Place:
    """Where the draw's patch is cut at an attempt. A warped patch that needs more than the volume has is cut unwarped."""
    order = (0, 1, 2)
    if plan.planes and not plan.aniso:
        fit = [t for t in TRANSPOSES if extent[t[1]] >= plan.patch[1] and extent[t[2]] >= plan.patch[2]]
        if fit:
            order = fit[floor(plan.u("order", draw, attempt) * len(fit))]
    here = tuple(extent[a] for a in order)
    warp = warp_of(plan, draw)
    size = needed(plan.patch, warp) if warp else plan.patch
    if warp and any(s > n for s, n in zip(size, here, strict=True)):
        warp, size = None, plan.patch
    if any(s > n for s, n in zip(size, here, strict=True)):
        raise ValueError(f"a volume of {extent} is smaller than the patch {plan.patch}")
    span = [n - s for s, n in zip(size, here, strict=True)]
    if plan.planes:
        span[0] = here[0]
    return Place(order, tuple(floor(plan.u(a, draw, attempt) * n) for a, n in zip("zxy", span, strict=True)), size, warp)


def source(plan: Plan, at: Place, draw: int) -> np.ndarray:
    """(3, patch): for each position of the finished patch its position in the cut, nearest."""
    grid = np.indices(plan.patch).astype(float)
    if plan.flip:
        swap = (0, 1, 2)
        if plan.planes and plan.upright:
            mirrored = (False, False, plan.u("my", draw) < 0.5)
        else:
            mirrored = tuple(plan.u(f"m{a}", draw) < 0.5 and not (plan.planes and a == "z") for a in "zxy")
            if plan.planes or plan.aniso:
                swap = (0, 2, 1) if plan.u("swap", draw) < 0.5 else swap
            else:
                swap = AXIS_ORDERS[floor(plan.u("swap", draw) * 6)]
        turned = [n - 1 - g if m else g for g, m, n in zip(grid, mirrored, plan.patch, strict=True)]
        grid = np.stack([turned[swap.index(i)] for i in range(3)])
    if at.warp:
        lead = tuple((s - p) // 2 for s, p in zip(at.size, plan.patch, strict=True))
        grid = warped(grid, at.size, lead, at.warp) + 0.5
    return np.trunc(grid).astype(np.int64)


def finished(plan: Plan, at: Place, draw: int, image: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(image, label, share of unlabelled positions) of a draw from the cut image (channels, axes) and label (axes), in the patch's axis order. What lies outside
    the cut (for labels: outside its inset part) is 0."""
    src = source(plan, at, draw)
    bound = np.array(at.size)[:, None, None, None]
    inside = ((src >= 0) & (src < bound)).all(axis=0)
    safe = tuple(np.where(inside, s, 0) for s in src)
    x = np.where(inside, image[(slice(None), *safe)], 0.0)
    inset = np.array(plan.inset)[:, None, None, None]
    known = inside & ((src >= inset) & (src < bound - inset)).all(axis=0)
    y = np.where(known, label[safe], 0)[tuple(slice(i, n - i) for i, n in zip(plan.inset, plan.patch, strict=True))].astype(np.int64)
    share = float((y < 0).mean())
    for ch in plan.grey:
        a, c, g = (plan.u(f"grey{name}", draw, ch) for name in "acg")
        x[ch] = np.clip(x[ch] * (1.0 + 0.3 * (a - 0.5)) + 0.3 * (c - 0.5), 0.0, 1.0) ** (2.0 ** (2.0 * g - 1.0))
    y = y[tuple(slice(None, None, s) for s in plan.strides)]
    if plan.affinity == "affinity":
        pairs = np.zeros((*y.shape, 3), np.int64)
        for axis in range(3):
            here, ahead = np.take(y, range(y.shape[axis] - 1), axis), np.take(y, range(1, y.shape[axis]), axis)
            pairs[(*(slice(0, n - (i == axis)) for i, n in enumerate(y.shape)), axis)] = (here == ahead) & (here > 0)
        y = pairs
    return x, y, share


def _cells(boxes: DataFrame, grid: tuple[int, int, int]) -> DataFrame:
    """Boxes (z, x, y, nz, nx, ny) once for each grid cell that they touch."""
    for a, n, c, g in zip(tiles.ORIGIN, tiles.EXTENT, CELL, grid, strict=True):
        boxes = boxes.withColumn(c, F.explode(F.sequence(F.floor(F.col(a) / g).cast("int"), F.floor((F.col(a) + F.col(n) - 1) / g).cast("int"))))
    return boxes


def _in_cells(pieces: DataFrame, grid: tuple[int, int, int]) -> DataFrame:
    return pieces.withColumns({c: F.floor(F.col(a) / g).cast("int") for a, c, g in zip(tiles.ORIGIN, CELL, grid, strict=True)})


def _rows(table: pa.Table | pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([np.asarray(table.column(n)).astype(np.int64) for n in names], axis=1) if table.num_rows else np.zeros((0, len(names)), np.int64)


def _by_cell(boxes: DataFrame, pieces: DataFrame, grid: tuple[int, int, int], run, schema: str) -> DataFrame:
    """run(boxes' rows, [(piece's origin, array)]) in each cell of each volume."""
    names = ("key", *CELL)
    left = _cells(boxes, grid).withColumnsRenamed({n: f"b{n}" for n in names})
    # Only cells that a box touches are grouped; boxes are as many as a range's draws and tries.
    touched = left.select(*(F.col(f"b{n}").alias(n) for n in names)).distinct()

    def met(boxes: pa.Table, there: pa.Table) -> pa.Table:
        found = [(o, np.asarray(v.values, np.float64).reshape(-1, *e)) for o, e, v in zip(_rows(there, tiles.ORIGIN), _rows(there, tiles.EXTENT), there.column("values"), strict=True)] if boxes.num_rows else []
        return run(boxes, found)

    return left.groupBy(*(f"b{n}" for n in names)).cogroup(_in_cells(pieces, grid).join(F.broadcast(touched), list(names), "left_semi").groupBy(*names)).applyInArrow(met, schema)


def _unlabelled(boxes: pa.Table, pieces: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """How many labels below 0 each box has in this cell, from prefix sums of each piece."""
    lo, n = _rows(boxes, tiles.ORIGIN), _rows(boxes, tiles.EXTENT)
    total = np.zeros(len(lo), np.int64)
    for origin, values in pieces:
        sums = np.pad((values[0] < 0).astype(np.int64), [(1, 0)] * 3).cumsum(0).cumsum(1).cumsum(2)
        a = np.clip(lo - origin, 0, values.shape[1:])
        b = np.maximum(np.clip(lo + n - origin, 0, values.shape[1:]), a)
        for corner in np.ndindex(2, 2, 2):
            at = np.where(np.array(corner) == 1, b, a)
            total += (-1) ** (3 - sum(corner)) * sums[tuple(at.T)]
    return pa.table({"draw": np.asarray(boxes.column("draw")), "attempt": np.asarray(boxes.column("attempt")), "n": total})


def _taken(kind: int):
    schema = pa.schema([("draw", pa.int64()), ("kind", pa.int32()), *((c, pa.int32()) for c in (*tiles.ORIGIN, *tiles.EXTENT)), ("values", pa.binary())])

    def run(boxes: pa.Table, pieces: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        rows = []
        lows, extents = _rows(boxes, tiles.ORIGIN), _rows(boxes, tiles.EXTENT)
        for draw, lo, n in zip(boxes.column("draw").to_pylist(), lows, extents, strict=True):
            for origin, values in pieces:
                a, b = np.maximum(lo, origin), np.minimum(lo + n, origin + values.shape[1:])
                if (a < b).all():
                    part = values[(slice(None), *(slice(x, y) for x, y in zip(a - origin, b - origin, strict=True)))]
                    rows.append((draw, kind, *(a - lo).tolist(), *part.shape[1:], part.tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 9
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


TAKEN = "draw long, kind int, z int, x int, y int, nz int, nx int, ny int, values binary"
BOX = "draw long, attempt int, key long, order int, z int, x int, y int, nz int, nx int, ny int"


def _boxes(draws: DataFrame, plan: Plan, attempts: int | None, inset: tuple[int, int, int]) -> DataFrame:
    """Boxes of draws (draw, key, ez, ex, ey): of so many attempts, or (None) of the one in column attempt."""
    names = [c.split()[0] for c in BOX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row in b.to_pylist():
                for k in [row["attempt"]] if attempts is None else range(attempts):
                    at = place(plan, (row["ez"], row["ex"], row["ey"]), row["draw"], k)
                    origin, n = at.box(inset)
                    rows.append((row["draw"], k, row["key"], TRANSPOSES.index(at.order), *origin, *n))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return draws.select("draw", "key", "ez", "ex", "ey", *(["attempt"] if attempts is None else [])).mapInArrow(run, BOX)


@dataclass(frozen=True)
class Volumes:
    """Images and labels as pieces on a regular grid, and cubes: key, ez, ex, ey (extents), lo, hi (its share of the draws), absent (whether it is known to lack a class, so that
    unlabelled positions say something)."""

    images: DataFrame
    labels: DataFrame
    cubes: DataFrame
    grid: tuple[int, int, int]
    channels: int = 1


def patches(volumes: Volumes, plan: Plan, first: int, last: int) -> DataFrame:
    """(draw, key, features, label) of the draws from first to last - 1 that are not refused."""
    spark = volumes.cubes.sparkSession
    numbers = spark.range(first, last).select(F.col("id").alias("draw"), uniform_column(plan.seed + "cube", F.col("id")).alias("u"))
    chosen = drawn_from(numbers, volumes.cubes).select("draw", "key", "ez", "ex", "ey", "absent")
    if plan.most_unlabelled > 0:
        chosen = written(chosen, "draws")
        boxes = _boxes(chosen, plan, TRIES, plan.inset)
        n = _by_cell(boxes, volumes.labels, volumes.grid, _unlabelled, "draw long, attempt int, n long").groupBy("draw", "attempt").agg(F.sum("n").alias("n"))
        size = F.col("nz") * F.col("nx") * F.col("ny")
        fits = boxes.select("draw", "attempt", size.alias("size")).join(n, ["draw", "attempt"], "left")
        fits = fits.where(F.coalesce("n", F.lit(0)) <= plan.most_unlabelled * F.col("size")).groupBy("draw").agg(F.min("attempt").alias("attempt"))
        chosen = chosen.join(fits, "draw", "left").withColumn("attempt", F.coalesce("attempt", F.lit(TRIES - 1)))
    else:
        chosen = chosen.withColumn("attempt", F.lit(0))
    chosen = written(chosen, "places")
    boxes = _boxes(chosen, plan, None, (0, 0, 0))
    parts = _by_cell(boxes, volumes.images, volumes.grid, _taken(0), TAKEN).unionByName(_by_cell(boxes, volumes.labels, volumes.grid, _taken(1), TAKEN))
    # A draw's own row goes along, so that a patch of nothing but missing pieces is one too.
    none = [F.lit(None).cast("int").alias(c) for c in (*tiles.ORIGIN, *tiles.EXTENT)]
    wanted = chosen.select("draw", F.lit(2).alias("kind"), F.col("attempt").alias("z"), *none[1:], F.lit(None).cast("binary").alias("values"), "key", "ez", "ex", "ey", "absent")
    met = parts.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("ez", "int"), ("ex", "int"), ("ey", "int"), ("absent", "boolean")))).unionByName(wanted.select(*[c.split()[0] for c in TAKEN.split(", ")], "key", F.col("ez").cast("int").alias("ez"), F.col("ex").cast("int").alias("ex"), F.col("ey").cast("int").alias("ey"), "absent"))
    channels = volumes.channels
    schema = pa.schema([("draw", pa.int64()), ("key", pa.int64()), ("features", pa.list_(pa.float64())), ("label", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        own = table.filter(pa.array(kind == 2)).to_pylist()[0]
        draw = own["draw"]
        at = place(plan, (own["ez"], own["ex"], own["ey"]), draw, own["z"])
        _, n = at.box()
        cut = []
        for k, c in ((0, channels), (1, 1)):
            out = np.zeros((c, *n))
            for row in table.filter(pa.array(kind == k)).select([*tiles.ORIGIN, *tiles.EXTENT, "values"]).to_pylist():
                o, e = [row[x] for x in tiles.ORIGIN], [row[x] for x in tiles.EXTENT]
                out[(slice(None), *(slice(s, s + m) for s, m in zip(o, e, strict=True)))] = np.frombuffer(row["values"]).reshape(c, *e)
            cut.append(out.transpose(0, *(1 + a for a in at.order)))
        x, y, share = finished(plan, at, draw, cut[0], cut[1][0])
        if plan.most_unlabelled > 0 and share > plan.most_unlabelled and not own["absent"]:
            return schema.empty_table()
        return pa.table([[draw], [own["key"]], [x.ravel()], [y.ravel()]], schema=schema)

    return met.groupBy("draw").applyInArrow(run, "draw long, key long, features array<double>, label array<long>")


class Stream:
    """Batches of size examples, numbered from 0: those draws that are not refused, in their order. Draws are made range by range, each in one job of which only
    counts come to the driver; a range is written once, with its examples' places in the stream."""

    def __init__(self, volumes: Volumes, plan: Plan, size: int, range_draws: int = 1024, most_empty: int = 16) -> None:
        self.volumes, self.plan, self.size, self.range_draws, self.most_empty = volumes, plan, size, range_draws, most_empty
        self.made: list[tuple[int, int, DataFrame]] = []  # (first place, number, examples) of each range
        self.draws = 0

    def _more(self) -> int:
        found = indexed(written(patches(self.volumes, self.plan, self.draws, self.draws + self.range_draws), "patches"), "draw", "__n")
        self.draws += self.range_draws
        first = self.made[-1][0] + self.made[-1][1] if self.made else 0
        n = found.count()
        self.made.append((first, n, found.withColumn("place", F.col("__n") + first).drop("__n")))
        return n

    def batch(self, number: int) -> DataFrame:
        """(key, features, label, draw, volume) of a batch; key is the example's place in the stream."""
        lo, hi, empty = number * self.size, (number + 1) * self.size, 0
        while not self.made or self.made[-1][0] + self.made[-1][1] < hi:
            empty = 0 if self._more() else empty + 1
            if empty >= self.most_empty:
                raise ValueError(f"{empty} ranges of {self.range_draws} draws gave no patch with enough labels")
        out = None
        for first, n, rows in self.made:
            if first < hi and first + n > lo:
                some = rows.where(F.col("place").between(lo, hi - 1)).select(F.col("place").alias("key"), "features", "label", "draw", F.col("key").alias("volume"))
                out = some if out is None else out.unionByName(some)
        return out


def cubes_of(pieces: DataFrame, priorities: DataFrame, extent: tuple[int, int, int]) -> DataFrame:
    """Volumes of one extent as Volumes.cubes, from priorities (key, lo, hi) and no class known to be absent."""
    sizes = [F.lit(n).cast("int").alias(c) for n, c in zip(extent, ("ez", "ex", "ey"), strict=True)]
    return priorities.join(pieces.select("key").distinct(), "key", "left_semi").select("key", *sizes, "lo", "hi", F.lit(False).alias("absent"))


def example_size(plan: Plan, channels: int = 1) -> tuple[int, int]:
    """Values of an example's features and of its label."""
    n = [-(-(p - 2 * i) // s) for p, i, s in zip(plan.patch, plan.inset, plan.strides, strict=True)]
    return channels * prod(plan.patch), prod(n) * (3 if plan.affinity == "affinity" else 1)
