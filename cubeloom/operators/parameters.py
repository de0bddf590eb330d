"""Parameter tables: initial values, filter banks, storing, loading and fitting to other shapes."""

from __future__ import annotations

from math import pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keyed import normal, uniform


def glorot_scale(n_in: int, n_out: int) -> float:
    return sqrt(2.0 / (n_in + n_out))


def grid(spark: SparkSession, **dims: int) -> DataFrame:
    """One row for each index of a parameter."""
    out = None
    for d, n in dims.items():
        side = spark.range(n).select(F.col("id").alias(d))
        out = side if out is None else out.crossJoin(side)
    return out


def glorot(spark: SparkSession, n_in: int, n_out: int, seed: str, kind: str = "uniform") -> DataFrame:
    return glorot_rows(spark.range(n_in).withColumnRenamed("id", "i"), n_in, n_out, seed, kind)


def glorot_rows(rows: DataFrame, n_in: int, n_out: int, seed: str, kind: str = "uniform") -> DataFrame:
    """(i, o, w) for each input i of rows."""
    s = glorot_scale(n_in, n_out)
    draw = (2.0 * uniform(seed, F.col("i"), F.col("o")) - 1.0) if kind == "uniform" else normal(seed, F.col("i"), F.col("o"))
    return rows.select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_out - 1).cast("long"))).alias("o")).withColumn("w", draw * s)


def spectral(w: DataFrame, n: int) -> DataFrame:
    """A square recurrent weight (i, o below n, w) divided by its largest singular value; n * n values pass the driver."""
    values = np.zeros((n, n))
    for row in w.collect():
        values[row["i"], row["o"]] = row["w"]
    return w.withColumn("w", F.col("w") / float(np.linalg.svd(values, compute_uv=False)[0]))


def bias(act: str, seed: str, index: Column) -> Column:
    """1 for relu, 0.5 for sigmoid, else within a millionth of 0."""
    if act == "relu":
        return F.lit(1.0)
    return F.lit(0.5) if act == "sigmoid" else (2.0 * uniform(seed, index) - 1.0) * 1e-6


def gabor(cells: DataFrame, size: int, angle: Column, modes: Column, offset: Column, by: list[str]) -> DataFrame:
    """value for each cell (x, y) of each filter: a Gaussian times a cosine, without its mean, by the sum of its squares."""
    half = (size - 1) // 2 if size % 2 else size // 2
    step = 2.0 * half / (size - 1)
    px, py = (F.col("x") * step - half) / (half + 1), (F.col("y") * step - half) / (half + 1)
    theta, shift = angle / 180.0 * pi, offset / 180.0 * pi
    u, v = px * F.cos(theta) + py * F.sin(theta), -px * F.sin(theta) + py * F.cos(theta)
    wave = F.exp(-0.5 * (u * u + v * v) / (0.35 * 0.35)) * F.cos(2.0 * pi * (modes / pi * 1.6 * v + shift))
    w = Window.partitionBy(*by)
    centred = cells.withColumn("g", wave).withColumn("g", F.col("g") - F.avg("g").over(w))
    return centred.withColumn("value", F.col("g") / F.sum(F.col("g") * F.col("g")).over(w)).drop("g")


def gabor_bank(spark: SparkSession, size: int, number: int) -> DataFrame:
    """(f, x, y, value): number first-order filters around the circle, then number second-order ones around half of it."""
    cells = grid(spark, f=2 * number, x=size, y=size)
    first = F.col("f") < number
    angle = F.when(first, F.col("f") * (360.0 / number)).otherwise((F.col("f") - number) * (180.0 / number))
    return gabor(cells, size, angle, F.when(first, 1.0).otherwise(2.0), F.when(first, 45.0).otherwise(0.0), ["f"])


def blob(spark: SparkSession, size: int) -> DataFrame:
    """(x, y, value): a Gaussian on [-2, 2] by the sum of its squares."""
    step = 4.0 / (size - 1)
    px, py = F.col("x") * step - 2.0, F.col("y") * step - 2.0
    g = grid(spark, x=size, y=size).withColumn("g", F.exp(-0.5 * (px * px + py * py)))
    total = g.agg(F.sum(F.col("g") * F.col("g")).alias("t"))
    return g.crossJoin(F.broadcast(total)).select("x", "y", (F.col("g") / F.col("t")).alias("value"))


def gabor_filters(spark: SparkSession, size: int, n: int, channels: int, seed: str) -> DataFrame:
    """(f, ch, x, y, w) for n filters of each channel: a bank, a blob, and, for an even n, a drawn one."""
    number = (n - 1) // 2 if n % 2 else (n - 2) // 2
    bank = gabor_bank(spark, size, number).withColumn("value", F.col("value") / 10.0)
    one = blob(spark, size).select(F.lit(2 * number).cast("long").alias("f"), "x", "y", (F.col("value") / (1.0 if n % 2 else 10.0)).alias("value"))
    out = bank.unionByName(one)
    if n % 2 == 0:
        noise = grid(spark, x=size, y=size).select(F.lit(2 * number + 1).cast("long").alias("f"), "x", "y", (0.02 * normal(seed, F.col("x"), F.col("y"))).alias("value"))
        out = out.unionByName(noise)
    return out.crossJoin(spark.range(channels).withColumnRenamed("id", "ch")).select("f", "ch", "x", "y", F.col("value").alias("w"))


def adapted(saved: DataFrame, target: DataFrame, saved_maps: int, fill: Column) -> DataFrame:
    """target (f, ch, x, y) with w: saved maps are repeated along f, cropped from the top left, and missing places filled."""
    t = target.withColumn("sf", F.col("f") % saved_maps)
    s = saved.select(F.col("f").alias("sf"), "ch", "x", "y", F.col("w").alias("sw"))
    return t.join(s, ["sf", "ch", "x", "y"], "left").select("f", "ch", "x", "y", F.coalesce("sw", fill).alias("w"))


def refitted(saved: DataFrame, target: DataFrame, had: dict[str, int], wants: dict[str, int], seed: str) -> DataFrame:
    """target (f, ch, x, y) with w from saved filters of other extents (had, wants: of f and ch).

    Maps repeat where more are wanted. Channels repeat where more are wanted (with up to 1e-4 added where maps don't repeat); of too
    many, the first are taken where maps repeat, else the middle ones. In the plane filters are cropped, or filled up with normal
    values of deviation 0.02.
    """
    more, wider = wants["f"] > had["f"], wants["ch"] > had["ch"]
    ch = F.col("ch") % had["ch"] if wider else F.col("ch") + (0 if more else (had["ch"] - wants["ch"]) // 2)
    at = [F.col(c) for c in ("f", "ch", "x", "y")]
    jitter = 1e-4 * uniform(seed + "j", *at) if wider and not more else F.lit(0.0)
    t = target.withColumns({"sf": F.col("f") % had["f"], "sch": ch})
    s = saved.select(F.col("f").alias("sf"), F.col("ch").alias("sch"), "x", "y", F.col("w").alias("sw"))
    return t.join(s, ["sf", "sch", "x", "y"], "left").select("f", "ch", "x", "y", F.coalesce(F.col("sw") + jitter, 0.02 * normal(seed, *at)).alias("w"))


def refitted_3d(saved: DataFrame, target: DataFrame, had: dict[str, int], wants: dict[str, int], seed: str) -> DataFrame:
    """target (f, z, ch, x, y) with w from saved filters whose z, x and y are put in the middle, or cropped to it; further maps and channels and the rims are
    filled with normal values of the saved deviation."""
    shift = {a: (had[a] - wants[a]) // 2 if had[a] > wants[a] else -((wants[a] - had[a]) // 2) for a in ("z", "x", "y")}
    t = target.withColumns({f"s{a}": F.col(a) + n for a, n in shift.items()})
    s = saved.select("f", "ch", *(F.col(a).alias(f"s{a}") for a in shift), F.col("w").alias("sw"))
    spread = saved.agg(F.stddev_pop("w").alias("std"))
    met = t.join(s, ["f", "ch", *(f"s{a}" for a in shift)], "left").crossJoin(F.broadcast(spread))
    at = [F.col(c) for c in ("f", "z", "ch", "x", "y")]
    return met.select("f", "z", "ch", "x", "y", F.coalesce("sw", (F.col("std") + 1e-9) * normal(seed, *at)).alias("w"))


def refitted_bias(saved: DataFrame, target: DataFrame, had: int) -> DataFrame:
    """target (o) with b: saved biases, from the first again where more are wanted."""
    return target.withColumn("so", F.col("o") % had).join(saved.select(F.col("o").alias("so"), "b"), "so").select("o", "b")


def shapes(params: DataFrame) -> DataFrame:
    """(layer, param, d0, d1): extents of stored parameters from their largest indices."""
    return params.groupBy("layer", "param").agg((F.max("i") + 1).alias("d0"), (F.max("o") + 1).alias("d1"))
