"""Dense prediction over planes larger than a network's input, tile by tile or by fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layers, reshape


def tiled(plane: DataFrame, axis: str, own: int, reach: int, n_tiles: int) -> DataFrame:
    """Cells with the tiles that read them: tile t owns own outputs from t * own on, and reads reach more cells.

    A cell in the overlap goes to both tiles; tiles are then independent of each other.
    """
    first = F.greatest(F.floor((F.col(axis) - reach - own) / own) + 1, F.lit(0))
    last = F.least(F.floor(F.col(axis) / own), F.lit(n_tiles - 1))
    with_tile = plane.withColumn("__f", first).withColumn("__l", last).where("__f <= __l")
    met = with_tile.withColumn("tile", F.explode(F.sequence("__f", "__l"))).drop("__f", "__l")
    return met.withColumn(axis, F.col(axis) - F.col("tile") * own)


def untiled(out: DataFrame, axis: str, own: int, size: int) -> DataFrame:
    """Tile outputs on the plane's coordinates; what a tile doesn't own, or is beyond the plane, goes."""
    return out.where(F.col(axis) < own).withColumn(axis, F.col("tile") * own + F.col(axis)).where(F.col(axis) < size).drop("tile")


def dense(images: DataFrame, key: str, side: int, kernel: int, w: DataFrame, b: DataFrame, tile: int, mirrored: bool = False) -> DataFrame:
    """(key, f, x, y, z) of a convolution over whole images (key, x, y, value), tile by tile of tile x tile outputs.

    With mirrored, images are grown by their own mirrored edges so that every pixel has an output; without, only inner ones have.
    """
    if mirrored:
        grown = side + kernel - 1
        images, side = reshape.border_padded(images, key, side, grown, mirror=True), grown
    reach, size = kernel - 1, side - kernel + 1
    n = -(-size // tile)
    tiles = tiled(tiled(images.withColumn("ch", F.lit(0).cast("long")), "x", tile, reach, n).withColumnRenamed("tile", "tx"), "y", tile, reach, n)
    out = layers.conv(tiles, w, b, [key, "tx", "tile"], {"x": tile + reach, "y": tile + reach}, {"x": kernel, "y": kernel})
    return untiled(untiled(out, "y", tile, size).withColumnRenamed("tx", "tile"), "x", tile, size)


def strided(maps: DataFrame, key: list[str], pool: int, size: int, value: str) -> DataFrame:
    """Dense output of a pool by running it on every shifted crop and interleaving the results. All crops are made by one scan."""
    n = (size - pool + 1) // pool
    shift = F.explode(F.sequence(F.lit(0), F.lit(pool - 1)).cast("array<long>"))
    crops = maps.withColumn("__sx", shift).withColumn("__sy", shift).withColumns({"x": F.col("x") - F.col("__sx"), "y": F.col("y") - F.col("__sy")})
    crops = crops.where(F.col("x").between(0, n * pool - 1) & F.col("y").between(0, n * pool - 1))
    p = layers.pooled(crops, [*key, "__sx", "__sy"], {"x": pool, "y": pool}, value)
    return p.withColumns({"x": F.col("x") * pool + F.col("__sx"), "y": F.col("y") * pool + F.col("__sy")}).drop("__sx", "__sy")


def fragmented(maps: DataFrame, key: list[str], pool: int, size: int, value: str) -> DataFrame:
    """The same output from one pass that keeps all fragments."""
    p = {"x": pool, "y": pool}
    return layers.defragmented(layers.fragments(maps, key, p, {"x": size, "y": size}, value), p)


def centre_slices(volume: DataFrame, depth: int, thick: int) -> DataFrame:
    lo = (depth - thick) // 2
    return volume.where(F.col("z").between(lo, lo + thick - 1)).withColumn("z", F.col("z") - lo)
