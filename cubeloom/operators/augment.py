"""Augmentation of images and volumes: flips, grey values, warping, shifts, noise and dropout."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keyed import normal, uniform


def flipped_2d(df: DataFrame, key: str, side: int, seed: str) -> DataFrame:
    """Half of the images transposed, then each axis mirrored in half of them."""
    t = uniform(seed + "t", F.col(key)) < 0.5
    x, y = F.when(t, F.col("y")).otherwise(F.col("x")), F.when(t, F.col("x")).otherwise(F.col("y"))
    x = F.when(uniform(seed + "x", F.col(key)) < 0.5, side - 1 - x).otherwise(x)
    y = F.when(uniform(seed + "y", F.col(key)) < 0.5, side - 1 - y).otherwise(y)
    return df.withColumns({"x": x, "y": y})


def flipped_3d(df: DataFrame, key: str, side: int, seed: str) -> DataFrame:
    """A drawn permutation of the three axes, then each axis mirrored in half of the volumes."""
    axes = [F.col(a) for a in ("z", "x", "y")]
    orders = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))
    pick = F.floor(uniform(seed + "p", F.col(key)) * 6)
    out = {}
    for i, a in enumerate(("z", "x", "y")):
        c = F.lit(None).cast("long")
        for k, o in enumerate(orders):
            c = F.when(pick == k, axes[o[i]]).otherwise(c)
        out[a] = F.when(uniform(seed + a, F.col(key)) < 0.5, side - 1 - c).otherwise(c)
    return df.withColumns(out)


def grey(value: Column, seed: str, *key: Column) -> Column:
    """clip(v * a + c, 0, 1) ** g with contrast, brightness and gamma drawn for each key."""
    a = 1.0 + 0.3 * (uniform(seed + "a", *key) - 0.5)
    c = 0.3 * (uniform(seed + "c", *key) - 0.5)
    g = F.pow(F.lit(2.0), 2.0 * uniform(seed + "g", *key) - 1.0)
    return F.pow(F.least(F.greatest(value * a + c, F.lit(0.0)), F.lit(1.0)), g)


def warp_params(df: DataFrame, key: str, seed: str, amount: float = 1.0, dims: int = 2) -> DataFrame:
    """rot, shear, scale_* and stretch_* (and twist in 3-D) for each key, in degrees and ratios."""
    u = lambda name: uniform(seed + name, F.col(key))
    both = lambda name, most: most * 2.0 * (u(name) - 0.5)
    rot, shear, scale, stretch = 15.0 * amount, 3.0 * amount, 1.1 * amount, 0.1 * amount
    out = {"shear": both("shear", shear)}
    if dims == 3:
        out |= {"twist": both("twist", rot)}
        out |= {"rot": F.least(rot - F.abs(out["twist"]), rot * u("rot"))}
        out |= {f"scale_{a}": 1.0 + (scale - 1.0) * u(f"scale{a}") for a in ("0", "1", "2")}
        out |= {f"stretch_{a}": both(f"stretch{a}", stretch) for a in ("0", "1", "2", "3")}
    else:
        out |= {"rot": both("rot", rot), "scale_0": F.lit(1.0), "scale_1": 1.0 + (scale - 1.0) * u("scale1")}
        out |= {f"stretch_{a}": both(f"stretch{a}", stretch) for a in ("0", "1")}
    return df.withColumns(out)


def _warped_xy(x: Column, y: Column, cx: float, cy: float, rot: Column, z: Column | None = None, cz: float = 1.0) -> tuple[Column, Column]:
    """Source coordinates of centred target coordinates x, y; rot and shear in radians, further columns by name."""
    s0, s1 = 1.0 / F.col("scale_0"), 1.0 / F.col("scale_1")
    more_x, more_y = F.col("stretch_0") / cx * y, F.col("stretch_1") / cy * x
    if z is not None:
        more_x, more_y = more_x + F.col("stretch_2") / cz * z, more_y + F.col("stretch_3") / cz * z
    xt, yt = x * (s0 + more_x), y * (s1 + more_y)
    shear = F.col("shear") * (pi / 180)
    u = xt * F.cos(rot - shear) - yt * F.sin(rot + shear) + cx
    v = yt * F.cos(rot + shear) + xt * F.sin(rot - shear) + cy
    return u, v


def warp_map_2d(params: DataFrame, size: int, patch: int) -> DataFrame:
    """params with tx, ty (target pixel) and x, y (its source pixel, nearest: truncated after adding a half)."""
    side = params.sparkSession.range(patch)
    grid = side.select(F.col("id").alias("tx")).crossJoin(side.select(F.col("id").alias("ty")))  # patch * patch rows
    c, lead = size / 2 - 0.5, (size - patch) // 2
    met = params.crossJoin(F.broadcast(grid))
    u, v = _warped_xy(F.col("tx") + (lead - c), F.col("ty") + (lead - c), c, c, F.col("rot") * (pi / 180))
    return met.withColumns({"x": (u + 0.5).cast("long"), "y": (v + 0.5).cast("long")})


def warp_map_3d(params: DataFrame, size: int, patch: int) -> DataFrame:
    side = params.sparkSession.range(patch)
    grid = side.select(F.col("id").alias("tz")).crossJoin(side.select(F.col("id").alias("tx"))).crossJoin(side.select(F.col("id").alias("ty")))  # patch ** 3 rows
    c, lead = size / 2 - 0.5, (size - patch) // 2
    met = params.crossJoin(F.broadcast(grid))
    z = F.col("tz") + (lead - c)
    rot = F.col("rot") * (pi / 180) + z * (F.col("twist") * (pi / 180) / c)
    u, v = _warped_xy(F.col("tx") + (lead - c), F.col("ty") + (lead - c), c, c, rot, z, c)
    w = z / F.col("scale_2") + c
    return met.withColumns({"z": (w + 0.5).cast("long"), "x": (u + 0.5).cast("long"), "y": (v + 0.5).cast("long")})


def gathered(target: DataFrame, source: DataFrame, key: str, axes: tuple[str, ...], value: str = "value") -> DataFrame:
    """(key, axes of the target, value): the source's value at each mapped coordinate, 0 outside it."""
    met = target.join(source.select(key, *axes, value), [key, *axes], "left")
    return met.select(key, *(F.col(f"t{a}").alias(a) for a in axes), F.coalesce(value, F.lit(0)).alias(value))


def required_size(params: DataFrame, key: str, patch: int) -> DataFrame:
    """(key, req_x, req_y): the extent a 2-D patch needs before warping, from its warped corners."""
    corners = params.sparkSession.range(4).select((F.col("id") % 2 * (patch - 1)).alias("i"), (F.expr("id div 2") * (patch - 1)).alias("j"))
    c = patch / 2 - 0.5
    u, v = _warped_xy(F.col("i") - c, F.col("j") - c, c, c, F.col("rot") * (pi / 180))
    met = params.crossJoin(F.broadcast(corners)).select(key, u.alias("u"), v.alias("v"))

    def grown(a: str) -> Column:
        left = F.floor(F.abs(F.least(F.min(a), F.lit(0.0))))
        right = F.ceil(F.greatest(F.max(a) - patch + 1, F.lit(0.0)))
        return (patch + 2 * F.greatest(left, right)).cast("long")

    return met.groupBy(key).agg(grown("u").alias("req_x"), grown("v").alias("req_y"))


def shifted_copies(df: DataFrame, key: str, crop: int, factor: int, side: int, seed: str) -> DataFrame:
    """(copy, key, x, y, value): factor copies of each image, each cropped at another of the crop * crop first offsets of a drawn order."""
    spark = df.sparkSession
    offsets = spark.range(crop * crop).select(F.expr(f"id div {crop}").alias("dx"), (F.col("id") % crop).alias("dy"), F.row_number().over(Window.orderBy(uniform(seed, F.col("id")), "id")).alias("r"))  # crop * crop rows
    kept = offsets.where(F.col("r") <= factor).select("dx", "dy", (F.col("r") - 1).cast("long").alias("copy"))
    extent = side - crop + 1
    met = df.crossJoin(F.broadcast(kept)).withColumns({"x": F.col("x") - F.col("dx"), "y": F.col("y") - F.col("dy")})
    return met.where(F.col("x").between(0, extent - 1) & F.col("y").between(0, extent - 1)).select("copy", key, "x", "y", "value")


def noisy(value: Column, sigma: float, seed: str, *key: Column) -> Column:
    return value + sigma * normal(seed, *key)


def dropout(rate: float, seed: str, *unit: Column) -> Column:
    """0, or 1 / (1 - rate) for the units that stay."""
    return F.when(uniform(seed, *unit) >= rate, F.lit(1.0 / (1.0 - rate))).otherwise(F.lit(0.0))


def pattern(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """x, y, value: a test image of one half with four diagonals and a border, scaled to a maximum of 1."""
    x = spark.range(rows).select(F.col("id").alias("x"))
    grid = x.crossJoin(spark.range(cols).select(F.col("id").alias("y")))
    d = min(rows, cols)
    far_x, far_y = rows - d, cols - d
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    near = (F.col("x") < d) & (F.col("y") < d)
    far = (F.col("x") >= far_x) & (F.col("y") >= far_y)
    v = F.lit(0.5) + one(near & (F.col("x") == F.col("y"))) + one(near & (F.col("x") + F.col("y") == d - 1))
    v = v + one(far & (F.col("x") - far_x == F.col("y") - far_y)) + one(far & (F.col("x") - far_x + F.col("y") - far_y == d - 1))
    v = v + one(F.col("x") == 0) + one(F.col("x") == rows - 1) + one(F.col("y") == 0) + one(F.col("y") == cols - 1)
    top = grid.agg(F.max(v).alias("__top"))
    return grid.withColumn("value", v).crossJoin(F.broadcast(top)).select("x", "y", (F.col("value") / F.col("__top")).alias("value"))
