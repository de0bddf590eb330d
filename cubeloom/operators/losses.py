"""Losses and errors as aggregates. Probabilities are long: key, c, p; targets are joined as y (below 0: unlabelled)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def _count(c: Column) -> Column:
    return F.count(F.when(c, 1))


def hit(y: str = "y", c: str = "c") -> Column:
    return F.col(y) == F.col(c)


def nll(df: DataFrame, weight: Column | float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Sum of -ln(p + eps) of the labelled class, weighted, by the number of labelled examples (at least 1)."""
    w = F.lit(weight) if isinstance(weight, int | float) else weight
    loss = _sum(F.when(hit(), -F.log(F.col("p") + EPS) * w)) / F.greatest(_count(hit()), F.lit(1))
    return (df.groupBy(*by) if by else df).agg(loss.alias("nll"))


def propagated_nll(df: DataFrame, least: float) -> DataFrame:
    """As nll, with confident predictions of unlabelled examples taken as labels."""
    sure = (F.col("y") < 0) & (F.col("p") > least)
    total = _sum(F.when(hit() | sure, -F.log(F.col("p") + EPS)))
    return df.agg((total / F.greatest(_count(hit() | sure), F.lit(1))).alias("nll"))


def lazy_nll(df: DataFrame) -> DataFrame:
    """Votes for the labelled class where the cube has that class labelled, against classes known to be absent.

    Needs labeled, not_present (0 or 1 for the cube and class) and w (class weight).
    """
    up = F.when(hit(), -F.log(F.col("p") + EPS) * F.col("labeled") * F.col("w")).otherwise(0.0)
    down = -F.log(1.0 - F.col("p") * F.col("not_present") * F.col("w") + EPS)
    n = F.sum(F.when(hit(), F.col("labeled")).otherwise(0)) + F.sum("not_present")
    return df.agg((F.sum(up + down) / F.greatest(n, F.lit(1))).alias("nll"))


def weak_nll(df: DataFrame) -> DataFrame:
    """The target is half the label, half the prediction itself."""
    target = 0.5 * F.when(hit(), 1.0).otherwise(0.0) + 0.5 * F.col("p")
    labelled = F.col("y") >= 0
    return df.agg((_sum(F.when(labelled, -F.log(F.col("p") + EPS) * target)) / F.greatest(_count(hit()), F.lit(1))).alias("nll"))


def binary_nll(act: Column, y: Column, w0: float = 1.0, w1: float = 1.0) -> Column:
    """Mean over all of independent heads; sigmoid(act) is the probability of 0."""
    p0 = 1.0 / (1.0 + F.exp(-act))
    return F.avg(-F.log(p0 + EPS) * (1.0 - y) * w0 - F.log(1.0 - p0 + EPS) * y * w1)


def squared(o: Column, y: Column, mask: Column | None = None) -> Column:
    d = o - y
    return F.avg(d * d if mask is None else d * d * mask * mask)


def cross_entropy(p: Column, t: Column, weight: Column | None = None) -> Column:
    e = F.log(p) * t + F.log(1.0 - p) * (1.0 - t)
    return -F.avg(e if weight is None else e * weight)


def window_weight(axis: Column) -> Column:
    """One axis of the 32-pixel window."""
    d = F.abs(axis - 16.0)
    return 32.0 / 29.8 * F.exp(-(d * d * d) / (2.0 * 6859.0))


def example_weights(label: Column, previous: Column, gain: float = 2.0) -> Column:
    """More weight where the previous prediction missed or cluttered."""
    d = label - previous
    one = F.lit(1.0)
    return one + F.when(d < -0.1, gain * (-d - 0.1)).otherwise(0.0) + F.when(d > 0.05, gain * (d - 0.05)).otherwise(0.0)


def error_rate(pred: str = "pred", y: str = "y", labelled_only: bool = False) -> Column:
    wrong = (F.col(pred) != F.col(y)).cast("double")
    return F.avg(F.when(F.col(y) >= 0, wrong)) if labelled_only else F.avg(wrong)


def jaccard(pred: Column, y: Column) -> Column:
    both = F.sum((pred & y).cast("long"))
    return both / F.sum((pred | y).cast("long"))
