"""Time series of training, statistics and their presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import rounded as r


def last_ema(seq: DataFrame, key: str, keep: float, start: float) -> DataFrame:
    """(key, ema) after the last value of each sequence (key, t, value), t counting from 0: a weighted sum, so a long sequence is summed in parts."""
    n = seq.groupBy(key).agg(F.count("*").alias("__n"))
    weight = F.pow(F.lit(keep), F.col("__n") - 1 - F.col("t")) * (1.0 - keep)
    return seq.join(n, key).groupBy(key).agg((F.sum(F.col("value") * weight) + F.pow(F.lit(keep), F.max("__n")) * start).alias("ema"))


def diverged(x: Column) -> Column:
    return F.bool_or(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def decimated(df: DataFrame, index: str, most: int) -> DataFrame:
    n = df.agg(F.greatest(F.floor(F.count("*") / most), F.lit(1)).alias("__step"))
    return df.join(F.broadcast(n)).where(F.col(index) % F.col("__step") == 0).drop("__step")  # one row


def summary(log: DataFrame, last: int = 30) -> DataFrame:
    n = log.agg(F.count("*").alias("n"))
    met = log.join(F.broadcast(n))
    mean, std = F.avg("nll"), F.stddev_pop("nll")
    return met.agg(r(F.max("i") / 60.0).alias("minutes"), r(F.avg(F.when(F.col("i") >= F.col("n") - last, F.col("nll")))).alias("last_mean"), r(3.0 * mean).alias("cap"), r(mean - 2.0 * std).alias("low"), r(mean + 2.0 * std).alias("high"))


def interpolated(series: DataFrame, points: DataFrame, x: str, y: str, at: str) -> DataFrame:
    """y at each point by the straight line between the neighbours in x; points beyond them have no row. points is small and broadcast."""
    met = series.select(x, y).crossJoin(F.broadcast(points.select(at)))
    place = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ends = met.groupBy(at).agg(F.max(F.when(F.col(x) <= F.col(at), place)).alias("a"), F.min(F.when(F.col(x) > F.col(at), place)).alias("b"))
    line = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col(at) - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    return ends.where("a is not null and b is not null").select(at, line.alias(y))


def tick_spacing(last: int, about: int = 5) -> int:
    """Steps between ticks on an axis to step last: a multiple of a power of ten that gives about so many ticks."""
    unit = 10 ** (len(str(max(last // about, 1))) - 1)
    return max(round(last / (about * unit)), 1) * unit


def parameter_stats(df: DataFrame, by: str, w: str) -> DataFrame:
    a = F.abs(w)
    return df.groupBy(by).agg(F.count("*").alias("n"), r(F.avg(w)).alias("mean"), r(F.stddev_pop(w), 4).alias("std"), r(F.avg(a), 8).alias("mean_abs"), r(F.median(a), 8).alias("median_abs"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) of equal widths between the extremes; the last bin is closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * float(bins))
    return df.select(column).join(F.broadcast(ends)).groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def pairwise(df: DataFrame, model: str, on: list[str]) -> DataFrame:
    """For all pairs of models, pixel by pixel: r the smaller, g the first's and b the second's value."""
    a = df.select(*on, F.col(model).alias("m1"), F.col("value").alias("g"))
    b = df.select(*on, F.col(model).alias("m2"), F.col("value").alias("b"))
    return a.join(b, on).where("m1 < m2").select("m1", "m2", *on, F.least("g", "b").alias("r"), "g", "b")


def pairwise_cropped(df: DataFrame, model: str, side: str, on: list[str]) -> DataFrame:
    """As pairwise, for models whose images (on, x, y, value) have sides of their own: the larger image of a pair is cropped to the middle of the smaller's
    extent."""
    sizes = df.select(F.col(model).alias("m"), F.col(side).alias("n")).distinct()
    pairs = sizes.toDF("m1", "n1").join(sizes.toDF("m2", "n2"), F.col("m1") < F.col("m2")).withColumn("n", F.least("n1", "n2"))

    def one(m: str, n: str, value: str) -> DataFrame:
        pad = F.floor((F.col(n) - F.col("n")) / 2)
        met = df.select(F.col(model).alias(m), *on, "x", "y", F.col("value").alias(value)).join(pairs, m)
        moved = met.withColumns({"x": F.col("x") - pad, "y": F.col("y") - pad})
        return moved.where("x >= 0 and y >= 0 and x < n and y < n").select("m1", "m2", *on, "x", "y", value)

    met = one("m1", "n1", "g").join(one("m2", "n2", "b"), ["m1", "m2", *on, "x", "y"])
    return met.select("m1", "m2", *on, "x", "y", F.least("g", "b").alias("r"), "g", "b")


def cost(layers: DataFrame, batch: int) -> DataFrame:
    each = F.col("n_in") * F.col("n_out") * F.col("filter")
    return layers.select("layer", (each * F.col("positions") * batch).alias("mults"), (each + F.col("n_out")).alias("params"))


def unit(n: Column) -> Column:
    return F.when(n >= 1e12, "T").when(n >= 1e9, "G").when(n >= 1e6, "M").otherwise("k")


def time_unit(seconds: Column) -> Column:
    return F.when(seconds > 4000, "h").when(seconds > 300, "m").otherwise("s")


def suggestions(names: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """For each name the nearest known one by edit distance, the first in ties. known is a fixed list of keys."""
    met = names.crossJoin(F.broadcast(known)).withColumn("d", F.levenshtein(name, "known").cast("long"))
    return met.groupBy(name).agg(F.min_by("known", F.struct("d", "known")).alias("suggestion"), F.min("d").alias("distance"))
