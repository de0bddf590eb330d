"""Loaders: chains of sources and maps that give ready example sets, and sources of the user's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import uniform
from ..operators import augment, reshape, sampling
from .tables import indexed, written

_SOURCES: dict[str, Callable] = {}


def register_source(name: str, shape: tuple[int, ...], n_lab: int) -> Callable:
    """Registers a function of (spark, path) that gives examples (key, features, label) as a source of that name, with the shape of its features."""

    def put(f: Callable) -> Callable:
        _SOURCES[name] = f
        f.shape, f.n_lab = shape, n_lab
        return f

    return put


def source(name: str, spark: SparkSession, path: str) -> DataFrame:
    if name not in _SOURCES:
        raise KeyError(f"no source {name!r}; there are {', '.join(sorted(_SOURCES)) or 'none'}")
    df = _SOURCES[name](spark, path)
    missing = {"key", "features", "label"} - set(df.columns)
    if missing:
        raise ValueError(f"source {name!r} lacks {', '.join(sorted(missing))}")
    return df


def read_cubes(data: DataFrame, label: DataFrame, side: int, label_side: int, offset: int, factor: int = 1) -> DataFrame:
    """(cube_id, z, x, y, value, cls): integer data by 255, labels within 16 bits at offset inside the data, 0 where there are none; optionally block means.

    data: cube_id, z, x, y, value; label: cube_id, z, x, y, cls.
    """
    fits = reshape.class_range(label, "cls").first()["fits"]
    if fits is False:
        raise ValueError("labels do not fit 16 bits")
    met = reshape.strip_cubes(reshape.scaled(data, "value"), label.select("cube_id", "z", "x", "y", "cls"), side, label_side, offset)
    met = met.select("cube_id", "z", "x", "y", "value", "cls")
    return reshape.downsampled(met, factor, side) if factor > 1 else met


def cubes_of_arrays(df: DataFrame, key: str, extent: tuple[int, int, int], data: str = "data", label: str | None = None) -> DataFrame:
    """(cube_id, z, x, y, value, cls) of whole volumes held as one flat array a row (z by z, then by x): numbers as they are, labels as read_cubes takes them, 0 where
    label is none or null. An array of another length than the extent's is an error; a null one has no voxels."""
    n = extent[0] * extent[1] * extent[2]
    sized = lambda c: F.when(F.size(c) != n, F.raise_error(F.concat(F.lit(f"{c} has not {n} values, row "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col(c))
    classes = F.lit(None) if label is None else F.when(F.col(label).isNotNull(), sized(label))
    rows = df.where(F.col(data).isNotNull()).select(F.col(key).alias("cube_id"), sized(data).alias("__data"), classes.alias("__label"))
    flat = rows.select("cube_id", "__label", F.posexplode("__data").alias("p", "value"))
    cls = F.lit(0) if label is None else F.coalesce(F.col("__label")[F.col("p")], F.lit(0))
    place = [F.expr(f"p div {extent[1] * extent[2]}").alias("z"), F.expr(f"p div {extent[2]} % {extent[1]}").alias("x"), (F.col("p") % extent[2]).cast("long").alias("y")]
    return flat.select("cube_id", *place, F.col("value").cast("double").alias("value"), cls.cast("long").alias("cls"))


def cube_set(cubes: DataFrame, side: int, patch: int, valid: list[int]) -> tuple[DataFrame, int, DataFrame]:
    """(voxels with split, number of classes, priorities of training cubes) of read_cubes' rows: cropped to patch in x and y, standardised, the
    cubes in valid set aside; a training cube's priority is how many labelled voxels it has."""
    cropped = reshape.border_cropped(cubes, side, patch) if patch < side else cubes
    whole = reshape.standardised(cropped, "value", "cube_id").withColumn("split", F.when(F.col("cube_id").isin(valid), "valid").otherwise("train"))
    n_lab = whole.agg(F.max("cls")).first()[0]
    prio = whole.where("split = 'train'").groupBy("cube_id").agg(F.count(F.when(F.col("cls") >= 0, 1)).alias("prio"))
    return whole, 0 if n_lab is None else int(n_lab) + 1, prio


def digit_set(images: DataFrame, side: int, border: int, crop: int, factor: int, seed: str) -> DataFrame:
    """(split, copy, vec_id, x, y, value) of images (vec_id, split, x, y, value): each split less its own mean, without the border; training images in
    factor shifted copies of crop pixels less, the others in one, at the middle."""
    inner = reshape.stripped(reshape.centred(images, "value", "split"), border, side)
    left = side - 2 * border
    train = augment.shifted_copies(inner.where("split = 0"), "vec_id", crop, factor, left, seed)
    lo = (crop - 1) // 2
    size = left - crop + 1
    rest = inner.where("split <> 0").where(F.col("x").between(lo, lo + size - 1) & F.col("y").between(lo, lo + size - 1))
    rest = rest.select(F.lit(0).cast("long").alias("copy"), "vec_id", (F.col("x") - lo).alias("x"), (F.col("y") - lo).alias("y"), "value", "split")
    columns = ["split", "copy", "vec_id", "x", "y", "value"]
    return train.withColumn("split", F.lit(0).cast("long")).select(*columns).unionByName(rest.select(*columns))


def digit_batch(images: DataFrame, key: str, size: int, epoch: int, batch: int, side: int, seed: str, warp: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(slot, key, i, value): one shuffled batch of images (key, x, y, value), optionally warped, as flat rows."""
    epochs = images.sparkSession.range(epoch, epoch + 1).withColumnRenamed("id", "epoch")
    chosen = sampling.shuffled_batches(images.select(key).distinct(), key, size, epochs, seed).where(F.col("batch") == batch)
    met = images.join(F.broadcast(chosen.select("slot", key)), key)  # size rows
    met = warp(met) if warp else met
    return met.select("slot", key, (F.col("x") * side + F.col("y")).alias("i"), "value")


def saved_by_split(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df (with split) written in a folder for each split and read back; a reader of one split reads its folder alone."""
    return written(df, label, path=path, by="split")


def reset_priorities(examples: DataFrame, key: str) -> DataFrame:
    """(key, prio, visits) as before the first loss."""
    return examples.select(key).distinct().select(key, F.lit(0.0).alias("prio"), F.lit(1).cast("long").alias("visits"))


def keyed_split(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """df with split: valid for about a share of the keys, else train, by a draw that each key keeps."""
    return df.withColumn("split", F.when(uniform(seed, F.col(key)) < share, "valid").otherwise("train"))


def fold_set(df: DataFrame, key: str, features: list[str], target: str, n_folds: int = 3, use_fold: int = 2, log_target: bool = False) -> DataFrame:
    """(key, features, label, split) of a table: features an array of its columns, label the target as a vector of one (on the scale of
    reshape.log_scaled where log_target), split valid for the use_fold-th (from 0) of contiguous folds in order of a unique numeric key, else train."""
    if not 0 <= use_fold < n_folds:
        raise ValueError(f"use_fold must be 0 to {n_folds - 1}")
    rows = df.select(F.col(key).alias("key"), F.array(*(F.col(c).cast("double") for c in features)).alias("features"), F.col(target).cast("double").alias("__target"))
    if log_target:
        rows = reshape.log_scaled(rows, "__target", "__target")
    folded = sampling.folds(indexed(rows, "key", "__i"), "__i", F.lit(df.count()), n_folds)
    return folded.select("key", "features", F.array("__target").alias("label"), F.when(F.col("fold") == use_fold + 1, "valid").otherwise("train").alias("split"))


def sequence_set(frames: DataFrame, key: str, valid: float, test: float, seed: str) -> DataFrame:
    """frames (one row a step of a sequence) with split: about shares valid and test of the sequences are set aside whole, by a draw that each key keeps."""
    u = uniform(seed, F.col(key))
    return frames.withColumn("split", F.when(u < valid, "valid").when(u < valid + test, "test").otherwise("train"))


def sequence_batch(sets: DataFrame, key: str, split: str, size: int, length: int, epoch: int, batch: int, seed: str) -> DataFrame:
    """(slot, key, k, and the frame's columns): windows of length steps from drawn places of one batch of sequences, and the step after each (k = length), which is what
    is to be told. sets: sequence_set's rows with t, a step's number from 0.

    Training sequences come in an order drawn for each epoch, those of valid and test are always the first by key. Sequences of no more than
    length steps have no window and are left out; where fewer than size are left, a training batch is empty and the others are shorter.
    """
    own = sets.where(F.col("split") == split).drop("split")
    long = written(own.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > length), "sequence-lengths")
    if split == "train":
        epochs = own.sparkSession.range(epoch, epoch + 1).withColumnRenamed("id", "epoch")
        chosen = sampling.shuffled_batches(long, key, size, epochs, seed).where(F.col("batch") == batch).select("slot", key)
    else:
        chosen = indexed(long.select(key), key, "slot").where(F.col("slot") < size)
    start = F.floor(uniform(f"{seed}t", F.lit(epoch), F.lit(batch), F.col(key)) * (F.col("__n") - length - 1) + 0.5)
    places = chosen.join(long, key).select(key, "slot", start.alias("__s"))
    met = own.join(F.broadcast(places), key).where(F.col("t").between(F.col("__s"), F.col("__s") + length))  # size rows
    return met.withColumn("k", F.col("t") - F.col("__s")).drop("t", "__s")
