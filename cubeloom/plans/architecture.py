"""Sizes of layered networks: which inputs fit, what each layer sees, and what to choose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layer:
    """A convolution and the pool after it along one axis; fragment: its pool keeps all offsets."""

    filter: int
    pool: int
    fragment: bool = False


def chain(filters: tuple[int, ...], pools: tuple[int, ...], fragment: tuple[bool, ...] | None = None) -> list[Layer]:
    if len(filters) != len(pools):
        raise ValueError("a pool for each filter is needed")
    return [Layer(f, p, m) for f, p, m in zip(filters, pools, fragment or (False,) * len(filters), strict=True)]


def extents(n: int, layers: list[Layer]) -> list[tuple[int, int]] | None:
    """(out, pooled) of each layer for an input of n, or None if it doesn't fit."""
    rows = []
    for x in layers:
        out = n - x.filter + 1
        if out <= 0 or x.pool > 1 and out % x.pool != (1 if x.fragment else 0):
            return None
        n = out // x.pool
        if n <= 0:
            return None
        rows.append((out, n))
    return rows


def fields(layers: list[Layer]) -> list[int]:
    """The receptive field of each layer."""
    out = []
    for k in range(1, len(layers) + 1):
        rf = 1
        for x in reversed(layers[:k]):
            rf = rf * x.pool + x.filter - 1
        out.append(rf)
    return out


def strides(layers: list[Layer]) -> list[int]:
    out, s = [], 1
    for x in layers:
        s *= x.pool
        out.append(s)
    return out


def choose(valid: list[int], desired: int | None) -> int:
    """The desired input if valid, else the largest below it, else the smallest; the largest where none is desired."""
    below = [v for v in valid if desired is None or v <= desired]
    return max(below) if below else min(valid)


def output_size(n: Column, layers: list[Layer]) -> Column:
    """The network's output for an input of n; null where it doesn't fit."""
    ok = F.lit(True)
    for x in layers:
        out = n - (x.filter - 1)
        ok = ok & (out > 0)
        if x.pool > 1:
            ok = ok & (F.pmod(out, F.lit(x.pool)) == (1 if x.fragment else 0))
        n = F.floor(out / x.pool)
    return F.when(ok & (n > 0), n)


def valid_inputs(spark: SparkSession, layers: list[Layer], most: int = 5000) -> DataFrame:
    """(input, out) of all inputs below most that fit."""
    sizes = spark.range(2, most).select(F.col("id").alias("input"), output_size(F.col("id"), layers).alias("out"))
    return sizes.where("out is not null")


def selected(valid: DataFrame, desired: DataFrame, name: str = "desired") -> DataFrame:
    """(desired, input): for each desired size the largest valid one not above it, else the smallest. Valid sizes are a bounded list."""
    met = desired.crossJoin(F.broadcast(valid.select("input")))
    return met.groupBy(name).agg(F.coalesce(F.max(F.when(F.col("input") <= F.col(name), F.col("input"))), F.min("input")).alias("input"))


def bordered(chosen: DataFrame, stride: int, mode: str, name: str = "desired") -> DataFrame:
    """The input by border mode: cropping takes the chosen one, padding the next larger where it differs, reject none."""
    other = F.col("input") != F.col(name)
    if mode in ("mirror", "0-pad"):
        size = F.when(other, F.col("input") + stride).otherwise(F.col("input"))
    elif mode == "reject":
        size = F.when(~other, F.col("input"))
    else:
        size = F.col("input")
    return chosen.select(name, F.lit(mode).alias("mode"), size.alias("input"))
