"""Further views: sequences, cube masks, and keyed weight tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keyed import sql_uniform, uniform
from .tables import images, table


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t (from 0 in order of time), value."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return table(spark, sf_dir, "events").select("user_id", place.alias("t"), "value")


def cube_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cube_id, cls, labeled, not_present: which classes a cube has labelled, and which it lacks."""
    cubes = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("cube_id")).distinct()
    both = cubes.crossJoin(spark.range(2).withColumnRenamed("id", "cls"))
    draw = lambda seed, p: (uniform(seed, F.col("cube_id"), F.col("cls")) < p).cast("long")
    return both.select("cube_id", "cls", draw("lab", 0.8).alias("labeled"), draw("np", 0.1).alias("not_present"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, i, value: images as feature vectors."""
    return images(spark, sf_dir).select("vec_id", "label", (F.col("x") * 8 + F.col("y")).alias("i"), "value")


def weights(spark: SparkSession, name: str, dims: dict[str, int], scale: float) -> DataFrame:
    """A keyed weight grid: one row for each index, w uniform within scale, to four decimals."""
    out = None
    for d, n in dims.items():
        side = spark.range(n).select(F.col("id").alias(d))
        out = side if out is None else out.crossJoin(side)  # a layer's parameters
    return out.withColumn("w", F.round((2.0 * uniform(name, *(F.col(d) for d in dims)) - 1.0) * scale, 4) + 0.0)


def biases(spark: SparkSession, name: str, index: str, n: int) -> DataFrame:
    return weights(spark, name, {index: n}, 0.1).withColumnRenamed("w", "b")


def sql_weights(table_name: str, name: str, dims: dict[str, int], scale: float, value: str = "w") -> str:
    grid = " CROSS JOIN ".join(f"(SELECT unnest(range({n})) AS {d})" for d, n in dims.items())
    return f"{table_name} AS (SELECT {', '.join(dims)}, round((2.0 * {sql_uniform(name, *dims)} - 1.0) * {scale!r}, 4) + 0.0 AS {value} FROM {grid})"


def sql_biases(table_name: str, name: str, index: str, n: int) -> str:
    return sql_weights(table_name, name, {index: n}, 0.1, "b")


#: features as a common table expression over img8
FEATURES = "feat AS (SELECT vec_id, label, x * 8 + y AS i, value FROM img8)"
