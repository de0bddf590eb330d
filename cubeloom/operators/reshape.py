"""Scaling, cropping, padding and other maps of coordinates and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scaled(df: DataFrame, column: str) -> DataFrame:
    """Integers divided by 255, floats as they are; decided by the schema."""
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    return df.withColumn(column, F.col(column).cast("double") / 255.0 if whole else F.col(column))


def class_range(df: DataFrame, column: str, most: int = 32767) -> DataFrame:
    """One row: the largest class, and whether all fit 16 bits."""
    return df.agg(F.max(column).cast("long").alias("max_label"), (F.max(column) <= most).alias("fits"))


def centred(df: DataFrame, column: str, by: str) -> DataFrame:
    """column less its mean in each split."""
    means = df.groupBy(by).agg(F.avg(column).alias("__m"))
    return df.join(means, by).withColumn(column, F.col(column) - F.col("__m")).drop("__m")


def log_scaled(df: DataFrame, column: str, out: str) -> DataFrame:
    """log10(t / max * 9999 + 1)."""
    top = df.agg(F.max(column).alias("__top"))
    return df.join(F.broadcast(top)).withColumn(out, F.log10(F.col(column) / F.col("__top") * 9999.0 + 1.0)).drop("__top")  # one row


def standardised(df: DataFrame, column: str, by: str) -> DataFrame:
    """(x - M) / S with M the mean of the groups' means and S that of their population deviations."""
    each = df.groupBy(by).agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))
    both = each.agg(F.avg("m").alias("__m"), F.avg("s").alias("__s"))
    return df.join(F.broadcast(both)).withColumn(column, (F.col(column) - F.col("__m")) / F.col("__s")).drop("__m", "__s")  # one row


def rank_scaled(df: DataFrame, column: str, out: str) -> DataFrame:
    """A category's rank among the sorted distinct ones, divided by the largest rank (0 where there is one category)."""
    distinct = df.select(column).distinct()
    ranks = distinct.withColumn("__r", F.dense_rank().over(Window.orderBy(column)) - 1)  # a row for each category
    top = ranks.agg(F.max("__r").alias("__top"))
    scale = ranks.join(F.broadcast(top)).select(column, F.coalesce(F.col("__r") / F.nullif(F.col("__top"), F.lit(0)), F.lit(0.0)).alias(out))
    return df.join(scale, column)


def max_scaled(df: DataFrame, column: str, out: str) -> DataFrame:
    top = df.agg(F.max(column).alias("__top"))
    return df.join(F.broadcast(top)).withColumn(out, F.col(column) / F.col("__top")).drop("__top")


def stripped(df: DataFrame, border: int, side: int, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Without the outer border; coordinates start at 0 again."""
    for a in axes:
        df = df.where(F.col(a).between(border, side - 1 - border)).withColumn(a, F.col(a) - border)
    return df


def centred_extent(size: int, patch: int) -> tuple[int, int]:
    """(start, stop) of the central patch, or the negative start of padding: odd excess to the left."""
    return ((size - patch) // 2, (size - patch) // 2 + patch) if size >= patch else (-(-(patch - size) // 2) * -1, 0)


def border_cropped(df: DataFrame, size: int, patch: int) -> DataFrame:
    lo = (size - patch) // 2
    return df.where(F.col("x").between(lo, lo + patch - 1) & F.col("y").between(lo, lo + patch - 1)).withColumn("x", F.col("x") - lo).withColumn("y", F.col("y") - lo)


def border_padded(df: DataFrame, key: str, size: int, patch: int, mirror: bool = False) -> DataFrame:
    """Images grown to patch: zeros around, or mirrored with the edge repeated. Key columns are key; gives key, x, y, value."""
    left = -((size - patch) // 2)
    side = df.sparkSession.range(patch)
    grid = side.select(F.col("id").alias("tx")).crossJoin(side.select(F.col("id").alias("ty")))  # patch * patch rows

    def source(t: Column) -> Column:
        i = t - left
        return F.when(i < 0, -i - 1).when(i >= size, 2 * size - 1 - i).otherwise(i) if mirror else i

    grid = grid.select("tx", "ty", source(F.col("tx")).alias("x"), source(F.col("ty")).alias("y"))
    inner = df.select(key, "x", "y", "value").join(F.broadcast(grid), ["x", "y"]).select(key, F.col("tx").alias("x"), F.col("ty").alias("y"), "value")
    if mirror:
        return inner
    edge = grid.where((F.col("x") < 0) | (F.col("x") >= size) | (F.col("y") < 0) | (F.col("y") >= size))
    zeros = df.select(key).distinct().crossJoin(F.broadcast(edge)).select(key, F.col("tx").alias("x"), F.col("ty").alias("y"), F.lit(0.0).alias("value"))
    return inner.unionByName(zeros)


def strip_extents(data: int, label: int, offset: int) -> tuple[int, int]:
    """(crop of data, crop of labels) on each side of an axis, so that labels stand at offset inside the data."""
    extra = data - label - 2 * offset
    if extra % 2:
        raise ValueError("data and labels can't be centred")
    return max(extra // 2, 0), max(-extra // 2, 0)


def strip_cubes(data: DataFrame, label: DataFrame, data_side: int, label_side: int, offset: int, axes: tuple[str, ...] = ("z", "x", "y")) -> DataFrame:
    """Data and labels on common coordinates: the larger is cropped, labels are padded by zeros to the data's extent."""
    crop_d, crop_l = strip_extents(data_side, label_side, offset)
    for a in axes:
        data = data.where(F.col(a).between(crop_d, data_side - 1 - crop_d)).withColumn(a, F.col(a) - crop_d)
        label = label.where(F.col(a).between(crop_l, label_side - 1 - crop_l)).withColumn(a, F.col(a) - crop_l + offset)
    return data.join(label, ["cube_id", *axes], "left").withColumn("cls", F.coalesce("cls", F.lit(0)))


def downsampled(df: DataFrame, factor: int, side: int) -> DataFrame:
    """Block means of data and integer block means of classes in x and y; a rest that fills no block goes."""
    kept = df.where((F.col("x") < side // factor * factor) & (F.col("y") < side // factor * factor))
    block = kept.groupBy("cube_id", "z", F.expr(f"x div {factor}").alias("x"), F.expr(f"y div {factor}").alias("y"))
    return block.agg(F.avg("value").alias("value"), F.floor(F.sum("cls") / (factor * factor)).alias("cls"))


def strided(df: DataFrame, steps: dict[str, int]) -> DataFrame:
    for a, s in steps.items():
        df = df.where(F.col(a) % s == 0).withColumn(a, F.expr(f"{a} div {s}"))
    return df


def transposed(df: DataFrame, order: dict[str, str]) -> DataFrame:
    """Axes renamed: {new: old}."""
    return df.select(*(c for c in df.columns if c not in order.values()), *(F.col(old).alias(new) for new, old in order.items()))


# The cyclic orders of three axes.
TRANSPOSES = ((0, 1, 2), (2, 0, 1), (1, 2, 0))


def valid_transposes(spark: SparkSession, shapes: DataFrame, patch: tuple[int, int]) -> DataFrame:
    """The cyclic axis orders of each shape (s0, s1, s2) whose first two extents hold the patch."""
    orders = spark.createDataFrame([(i, *t) for i, t in enumerate(TRANSPOSES)], "t long, a int, b int, c int")
    side = F.array("s0", "s1", "s2")
    met = shapes.crossJoin(F.broadcast(orders))  # three rows a shape
    return met.where((side[F.col("a")] >= patch[0]) & (side[F.col("b")] >= patch[1])).drop("a", "b", "c")


def enough_labelled(df: DataFrame, key: str, most: float, not_present: DataFrame | None = None) -> DataFrame:
    """Keys whose share of unlabelled entries is at most most, or for which a class is known to be absent."""
    share = df.groupBy(key).agg(F.avg((F.col("cls") < 0).cast("double")).alias("share"))
    if not_present is None:
        return share.where(F.col("share") <= most)
    known = not_present.groupBy(key).agg(F.max("not_present").alias("np"))
    return share.join(known, key, "left").where((F.col("share") <= most) | (F.coalesce("np", F.lit(0)) == 1)).drop("np")


def feature_subset(df: DataFrame, ratio: float, n: int, draw) -> DataFrame:
    """The features (column i of 0..n-1) whose draw ranks among the first ratio of n."""
    spark = df.sparkSession
    ranks = spark.range(n).withColumn("r", F.row_number().over(Window.orderBy(draw(F.col("id")), "id")))  # n rows
    kept = ranks.where(F.col("r") <= int(n * ratio)).select(F.col("id").alias("i"))
    return df.join(F.broadcast(kept), "i")


def quantised(p: Column) -> Column:
    return F.floor(p * 255.0).cast("long")


def mosaic(df: DataFrame, index: str, n: Column, side: int, border: int, ratio: float, normalise: bool = True) -> DataFrame:
    """Pixels placed on one canvas: image index at (index div across, index mod across); optionally each image from 0 to 1."""
    across = F.floor(F.sqrt(n * ratio))
    out = df
    if normalise:
        ends = df.groupBy(index).agg(F.min("value").alias("__lo"), (F.max("value") + 1e-8).alias("__hi"))
        out = df.join(ends, index).withColumn("value", (F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return out.select((F.floor(F.col(index) / across) * (side + border) + F.col("x")).cast("long").alias("row"), ((F.col(index) % across) * (side + border) + F.col("y")).cast("long").alias("col"), "value")


def natural_key(name: Column, width: int = 20) -> Column:
    """A text that sorts as a reader would: digit runs padded to width."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, width, "0")).otherwise(r)), "")
