"""Volumes as pieces, cut into tiles with halos: what networks over whole volumes are run and trained on.

A piece is a box of a volume in one row: key, origin z, x, y, extents nz, nx, ny, and its values as one array (channel by channel, then z, x, y). Where
a tile overlaps a piece it gets that part of it; parts are shuffled by volume and tile, so a task holds a bounded number of values at a time, however
large its volume is and whatever the pieces' layout. Small tiles that are neighbours travel as one, which reads their common halo once, and
small tiles share a call. A plane is a volume of depth 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import rounded
from . import nets
from .graph import by_whole_volumes

ORIGIN, EXTENT = ("z", "x", "y"), ("nz", "nx", "ny")
PIECE = "key long, z int, x int, y int, nz int, nx int, ny int, values array<double>"
PART = "key long, tz int, tx int, ty int, kind int, z int, x int, y int, nz int, nx int, ny int, values binary"


#: Values that a tile reads up to which neighbours are joined to it, and tiles share a call; tiles that a network runs on at once.
TILE_VALUES, AT_ONCE = 4096, 64
KEYS = ("key", "tz", "tx", "ty")


def _box(row: dict, names: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(int(row[n]) for n in names)


@dataclass(frozen=True)
class Plan:
    """Tiles over a volume of extent: each owns own positions of the result along an axis and reads own + reach positions of the volume, from lead before its
    first one (lead is 0 unless the volume is grown by its mirrored edges)."""

    extent: tuple[int, int, int]
    own: tuple[int, int, int]
    reach: tuple[int, int, int]
    lead: tuple[int, int, int] = (0, 0, 0)
    most: tuple[int, ...] | None = None

    @property
    def tiles(self) -> tuple[int, ...]:
        """Numbers of tiles by axis (most, where that is set)."""
        return self.most or tuple(-(-r // o) for r, o in zip(self.result, self.own, strict=True))

    @property
    def result(self) -> tuple[int, ...]:
        """Positions of the result by axis."""
        return tuple(n + 2 * e - r for n, e, r in zip(self.extent, self.lead, self.reach, strict=True))

    @property
    def read(self) -> tuple[int, ...]:
        return tuple(o + r for o, r in zip(self.own, self.reach, strict=True))

    def first(self, tile: tuple[int, ...]) -> tuple[int, ...]:
        """The volume's position that a tile reads first; below 0 in mirrored edges."""
        return tuple(t * o - e for t, o, e in zip(tile, self.own, self.lead, strict=True))

    def joined(self, values: int | None = None) -> Plan:
        """The plan of twice, four times ... the own positions, as long as a tile reads no more than so many values (TILE_VALUES) and the result has more."""
        plan, most = self, TILE_VALUES if values is None else values
        while True:
            more = replace(plan, own=tuple(2 * o if o < r else o for o, r in zip(plan.own, plan.result, strict=True)))
            if more.own == plan.own or prod(more.read) > most:
                return plan
            plan = more

    def of(self, axis: int, lo: int, hi: int) -> range:
        """Tiles along an axis that read any of the positions lo to hi - 1."""
        own, e, n = self.own[axis], self.lead[axis], self.tiles[axis]
        return range(max(0, (lo + e - self.read[axis]) // own + 1), min(n, (hi + e - 1) // own + 1))


def slab_pieces(rows: DataFrame, key: str, z: str, values: str, nx: int, ny: int) -> DataFrame:
    """Pieces of one slice each, of rows that hold a slice's values in an array."""
    one = lambda v: F.lit(v).cast("int")
    return rows.select(F.col(key).cast("long").alias("key"), F.col(z).cast("int").alias("z"), one(0).alias("x"), one(0).alias("y"), one(1).alias("nz"), one(nx).alias("nx"), one(ny).alias("ny"), F.col(values).cast("array<double>").alias("values"))


def parts(pieces: DataFrame, plan: Plan, kind: int = 0) -> DataFrame:
    """The part of each piece that each tile reads, with its place in the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PART.split(", ")]
        for batch in batches:
            boxes = batch.select(["key", *ORIGIN, *EXTENT]).to_pylist()
            rows: list[tuple] = []
            for box, values in zip(boxes, batch.column(7), strict=True):
                key, origin, extent = box["key"], _box(box, ORIGIN), _box(box, EXTENT)
                a = np.asarray(values.values, np.float64).reshape(-1, *extent)
                for tz in plan.of(0, origin[0], origin[0] + extent[0]):
                    for tx in plan.of(1, origin[1], origin[1] + extent[1]):
                        for ty in plan.of(2, origin[2], origin[2] + extent[2]):
                            first = plan.first((tz, tx, ty))
                            lo = [max(o, f) for o, f in zip(origin, first, strict=True)]
                            hi = [min(o + n, f + r) for o, n, f, r in zip(origin, extent, first, plan.read, strict=True)]
                            part = a[(slice(None), *(slice(x - o, y - o) for x, y, o in zip(lo, hi, origin, strict=True)))]
                            rows.append((key, tz, tx, ty, kind, *(x - f for x, f in zip(lo, first, strict=True)), *part.shape[1:], part.tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kinds = [pa.int64(), *[pa.int32()] * 10, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return pieces.select("key", *ORIGIN, *EXTENT, "values").mapInArrow(run, PART)


def assembled(table: pa.Table, plan: Plan, tile: tuple[int, ...], channels: int, fill: float = 0.0) -> np.ndarray:
    """(channels, axes): the tile of its parts, with the volume's mirrored edges where it reaches over them; fill beyond."""
    out = np.full((channels, *plan.read), fill)
    for row in table.select([*ORIGIN, *EXTENT, "values"]).to_pylist():
        at, n = _box(row, ORIGIN), _box(row, EXTENT)
        out[(slice(None), *(slice(a, a + e) for a, e in zip(at, n, strict=True)))] = np.frombuffer(row["values"]).reshape(channels, *n)
    if any(plan.lead):
        for axis, (first, size) in enumerate(zip(plan.first(tile), plan.extent, strict=True)):
            place = np.arange(first, first + plan.read[axis])
            place = np.where(place < 0, -1 - place, np.where(place >= size, 2 * size - 1 - place, place)) - first
            far = (place < 0) | (place >= plan.read[axis])  # over the mirrored edge of the far side: cut from the result
            out = np.take(out, np.where(far, 0, place), axis + 1)
    return out


def by_tile(pieces: DataFrame, plan: Plan, run: Callable[[pa.Table], pa.Table], schema: str, more: DataFrame | None = None) -> DataFrame:
    """run on tables of whole tiles' parts, tile by tile: many small ones, or a large one; more: further parts (of another kind) of the same tiles."""
    met = parts(pieces, plan)
    met = met if more is None else met.unionByName(more)
    return by_whole_volumes(met, KEYS, run, schema) if prod(plan.read) <= TILE_VALUES else met.groupBy(*KEYS).applyInArrow(run, schema)


def _each(table: pa.Table) -> Iterator[tuple[int, tuple[int, ...], pa.Table]]:
    """(key, tile, parts) of each tile in a table."""
    keys = [np.asarray(table.column(c)) for c in KEYS]
    ends = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
    for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), table.num_rows], strict=True):
        if hi > lo:
            yield int(keys[0][lo]), tuple(int(k[lo]) for k in keys[1:]), table.slice(lo, hi - lo)


def predicted(pieces: DataFrame, extent: tuple[int, int, int], net: nets.Net, w: np.ndarray, own: tuple[int, int, int], how: str = "fragments", mirrored: bool = False) -> DataFrame:
    """Pieces of a network's probabilities at every position of volumes of one extent that the network's field fits (with mirrored: at every position), class by
    class; how: fragments, or strides, which runs the network on every shift.

    own: least positions of the result for each tile, multiples of the network's strides; neighbouring tiles are joined (Plan.joined). The network is one of convolutions, over volumes or (depth 1) over
    planes; its weights go along with the tasks.
    """
    flat = net.layers[0].dims == 2
    field = (1, *net.field) if flat else net.field
    strides = (1, *net.strides) if flat else net.strides
    if any(o % s for o, s in zip(own, strides, strict=True)):
        raise ValueError("own must be a multiple of the network's strides")
    lead = tuple((f - 1) // 2 for f in field) if mirrored else (0, 0, 0)
    plan = Plan(tuple(extent), tuple(own), tuple(f - 1 for f in field), lead)
    if min(plan.result) < 1 or any(e > n for e, n in zip(lead, extent, strict=True)):
        raise ValueError("the volumes are smaller than the network's field")
    plan = plan.joined()
    own = plan.own
    tile_net = net.at(plan.read[1:] if flat else plan.read)
    sent = pieces.sparkSession.sparkContext.broadcast((tile_net, w))

    schema = pa.schema([("key", pa.int64()), *((c, pa.int32()) for c in (*ORIGIN, *EXTENT)), ("values", pa.list_(pa.float64()))])

    def run(table: pa.Table) -> pa.Table:
        net, w = sent.value
        rows: list[tuple] = []
        each = list(_each(table))
        for k in range(0, len(each), AT_ONCE):
            some = each[k : k + AT_ONCE]
            x = np.stack([assembled(found, plan, tile, net.shape[0]).reshape(net.shape) for _, tile, found in some])
            for (key, tile, _), z in zip(some, (net.dense_by_fragments if how == "fragments" else net.dense_by_strides)(w, x), strict=True):
                p = nets.probabilities_of(z.reshape(len(z), -1).T, net.target).T.reshape(len(z), *own)
                n = [min(o, r - t * o) for o, r, t in zip(own, plan.result, tile, strict=True)]
                rows.append((key, *(t * o for t, o in zip(tile, own, strict=True)), *n, p[(slice(None), *map(slice, n))].ravel()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return by_tile(pieces, plan, run, PIECE)


def examples(pieces: DataFrame, labels: DataFrame, extent: tuple[int, int, int], net: nets.Net, own: tuple[int, int, int]) -> DataFrame:
    """(key, features, label): the tiles of volumes as training examples of a network of convolutions over volumes, each with the labels of its own positions at the
    network's strides. labels: pieces of classes on the volume's coordinates; an output has the label at the middle of its field. Positions beyond the
    volume are unlabelled, so the tiles' losses and gradients add up to those of the whole volume. A tile's key is its number among all."""
    field, strides = net.field, net.strides
    if any(o % s for o, s in zip(own, strides, strict=True)):
        raise ValueError("own must be a multiple of the network's strides")
    plan = Plan(tuple(extent), tuple(own), tuple(f - 1 for f in field))
    mid = tuple((f - 1) // 2 for f in field)
    n_tiles = plan.tiles
    joined = plan.joined()
    inner = Plan(tuple(extent), joined.own, (0, 0, 0), tuple(-m for m in mid), joined.tiles)
    channels, result = net.shape[0], plan.result
    # With pools, the last output of a tile needs no more than the network's own extent for so many outputs.
    need = example_extent(net, own)
    share = tuple(a // b for a, b in zip(joined.own, own, strict=True))
    schema = pa.schema([("key", pa.int64()), ("features", pa.list_(pa.float64())), ("label", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for key, large, found in _each(table):
            kinds = np.asarray(found.column("kind"))
            boxes = np.array([[*_box(r, ORIGIN), *_box(r, EXTENT)] for r in found.select([*ORIGIN, *EXTENT]).to_pylist()])
            whole = assembled(found.filter(pa.array(kinds == 0)), joined, large, channels)
            labels = assembled(found.filter(pa.array(kinds == 1)), inner, large, 1, -1.0)[0]
            for axis in range(3):
                beyond = np.arange(large[axis] * joined.own[axis], (large[axis] + 1) * joined.own[axis]) >= result[axis]
                labels[(slice(None),) * axis + (beyond,)] = -1
            for part in np.ndindex(*share):
                tile = tuple(t * n + i for t, n, i in zip(large, share, part, strict=True))
                at = np.array(part) * own
                met = (boxes[:, :3] < at + np.where(kinds[:, None] == 0, plan.read, own)) & (boxes[:, :3] + boxes[:, 3:] > at)
                if any(t >= n for t, n in zip(tile, n_tiles, strict=True)) or not met.all(axis=1).any():
                    continue
                x = whole[(slice(None), *(slice(a, a + n) for a, n in zip(at, need, strict=True)))]
                y = labels[tuple(slice(a, a + o, s) for a, o, s in zip(at, own, strides, strict=True))]
                rows.append((((key * n_tiles[0] + tile[0]) * n_tiles[1] + tile[1]) * n_tiles[2] + tile[2], x.ravel(), y.ravel().astype(np.int64)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 3, schema, strict=True)], schema=schema)

    # A tile without any labels of its own (all beyond the volume) can't be: its first position is inside the result.
    return by_tile(pieces, joined, run, "key long, features array<double>, label array<long>", parts(labels, inner, 1))


def example_extent(net: nets.Net, own: tuple[int, int, int]) -> tuple[int, ...]:
    """The extent of the examples that examples() makes; net.at(it) runs on them."""
    return tuple((o // s - 1) * s + f for o, s, f in zip(own, net.strides, net.field, strict=True))


def voxels(pieces: DataFrame, digits: int | None = None, as_uint8: bool = False) -> DataFrame:
    """(key, c, z, x, y, p): pieces as one row a value; rounded, or as bytes of 255 steps."""
    n = F.col("nz") * F.col("nx") * F.col("ny")
    at = F.posexplode("values").alias("i", "p")
    rows = pieces.select("key", *ORIGIN, *EXTENT, n.alias("n"), at)
    p = F.floor(rounded(F.col("p")) * 255.0).cast("long") if as_uint8 else rounded(F.col("p"), digits) if digits is not None else F.col("p")
    i = F.col("i") % F.col("n")
    place = {"z": F.floor(i / (F.col("nx") * F.col("ny"))), "x": F.floor(i / F.col("ny")) % F.col("nx"), "y": i % F.col("ny")}
    return rows.select("key", F.floor(F.col("i") / F.col("n")).cast("long").alias("c"), *((F.col(a) + v).cast("long").alias(a) for a, v in place.items()), p.alias("p"))

