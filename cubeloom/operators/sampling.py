"""Shuffling, splitting, balancing and drawing examples by keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import uniform
from ..sources.tables import RANGE_ROWS, ranges, running_sum


def shuffled_batches(df: DataFrame, key: str, size: int, epochs: DataFrame, seed: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(epoch, batch, slot, key): each epoch a new order without replacement; the rest that fills no batch is left out.

    The order is that of the draws; rows are ranked within ranges of the draw, after the totals of the ranges before, so
    no task sees a whole epoch.
    """
    drawn = df.select(key).crossJoin(F.broadcast(epochs)).withColumn("u", uniform(seed, F.col("epoch"), F.col(key)))
    rank = ranked(drawn, "u", [key], ["epoch"], ranges(df.count(), range_rows))
    n = drawn.groupBy("epoch").agg(F.count("*").alias("n"))
    out = rank.join(F.broadcast(n), "epoch").where(F.col("rank") < F.floor(F.col("n") / size) * size)
    return out.select("epoch", F.expr(f"rank div {size}").alias("batch"), (F.col("rank") % size).alias("slot"), key)


def ranked(df: DataFrame, draw: str, ties: list[str], by: list[str], buckets: int | None = None) -> DataFrame:
    """df with rank, from 0 in each group by in order of draw (uniform on [0, 1)) and ties. Rows are dealt by buckets of the draw, as many as the rows need."""
    buckets = buckets or ranges(df.count())
    dealt = df.withColumn("__b", F.floor(F.col(draw) * buckets))
    totals = dealt.groupBy(*by, "__b").agg(F.count("*").alias("__n"))  # at most buckets rows a group
    before = totals.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(draw, *ties)).cast("long") - 1
    met = dealt.withColumn("__p", place).join(before, [*by, "__b"])
    return met.withColumn("rank", F.col("__before") + F.col("__p")).drop("__b", "__p", "__before")


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def subset(df: DataFrame, key: str, ratio: float, seed: str) -> DataFrame:
    """The first int(n * ratio) rows in the order of a draw, with their rank."""
    drawn = df.withColumn("u", uniform(seed, F.col(key)))
    n = drawn.agg(F.floor(F.count("*") * ratio).alias("__most"))
    return ranked(drawn, "u", [key], []).join(F.broadcast(n)).where(F.col("rank") < F.col("__most")).drop("__most", "u")


def folds(df: DataFrame, index: str, n: Column, k: int) -> DataFrame:
    """Contiguous folds from 1 over an index from 0; the first n % k are one larger."""
    small = F.floor(n / k)
    more = n % k
    edge = more * (small + 1)
    fold = F.when(F.col(index) < edge, F.floor(F.col(index) / (small + 1))).otherwise(more + F.floor((F.col(index) - edge) / small)) + 1
    return df.withColumn("fold", fold.cast("long"))


def holdout(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """split: the n rows first in a drawn order are valid, the others train."""
    rank = ranked(df.withColumn("u", uniform(seed, F.col(key))), "u", [key], [])
    return rank.withColumn("split", F.when(F.col("rank") < n, "valid").otherwise("train")).drop("rank", "u")


def balanced(df: DataFrame, key: str, label: str, size: int, n_labels: int, batch: int, seed: str) -> DataFrame:
    """(slot, label, key) of one batch: size // n_labels rows of each class, class after class; a class's cursor wraps around."""
    per = size // n_labels
    rank = ranked(df.select(key, label).withColumn("u", uniform(seed, F.col(key))), "u", [key], [label])
    count = df.groupBy(label).agg(F.count("*").alias("n"))
    slots = df.sparkSession.range(per).select(F.col("id").alias("s"))
    wanted = count.crossJoin(F.broadcast(slots)).select(label, "s", ((F.lit(batch * per) + F.col("s")) % F.col("n")).alias("rank"))
    return rank.join(F.broadcast(wanted), [label, "rank"]).select((F.col(label) * per + F.col("s")).alias("slot"), label, key)


def by_priority(df: DataFrame, priority: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(priority).desc(), key).limit(n)


def updated_priority(nll: Column, visits: Column, iteration: Column, last: Column) -> Column:
    """Losses weigh more, visited and stale examples less."""
    return nll / (1.0 + 0.017 * visits) - 0.004 * (iteration - last)


def priority_cdf(df: DataFrame, key: str, priority: str) -> DataFrame:
    """(key, lo, hi): each row's share of the unit interval, in order of a unique numeric key."""
    total = df.agg(F.sum(priority).alias("__t"))
    summed = running_sum(df.select(key, priority), key, priority, "__s").join(F.broadcast(total))  # one row
    return summed.select(key, ((F.col("__s") - F.col(priority)) / F.col("__t")).alias("lo"), (F.col("__s") / F.col("__t")).alias("hi"))


def drawn_from(draws: DataFrame, cdf: DataFrame, u: str = "u") -> DataFrame:
    """Each draw with the row whose interval holds it. Both sides are dealt by equal parts of the unit interval, as many as the distribution has rows, and
    joined by part; an interval stands in each part that it touches, so there are at most twice as many rows as intervals."""
    n = max(1, cdf.count())
    part = lambda x: F.least(F.floor(x * float(n)), F.lit(n - 1))
    touched = cdf.withColumn("__part", F.explode(F.sequence(part(F.col("lo")), part(F.col("hi")))))
    met = draws.withColumn("__part", part(F.col(u))).join(touched, "__part")
    return met.where((F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))).drop("__part")


def patch_offsets(draws: DataFrame, axes: dict[str, tuple[int, int]], seed: str, key: list[str]) -> DataFrame:
    """A corner for each draw: floor(u * (size - patch)) on each axis {name: (size, patch)}; 0 where they are equal."""
    for a, (size, patch) in axes.items():
        if patch > size:
            raise ValueError(f"the image is smaller than the patch along {a}")
        draws = draws.withColumn(f"o{a}", F.floor(uniform(seed + a, *(F.col(k) for k in key)) * (size - patch)))
    return draws


def cut(draws: DataFrame, volume: DataFrame, patch: dict[str, int], on: list[str]) -> DataFrame:
    """The voxels of each draw's patch, on the patch's own coordinates. Voxels are shuffled once by the source's key."""
    inside = [F.col(a).between(F.col(f"o{a}"), F.col(f"o{a}") + (p - 1)) for a, p in patch.items()]
    met = draws.join(volume, on)
    for c in inside:
        met = met.where(c)
    return met.select(*[c for c in met.columns if c not in patch and not (c[0] == "o" and c[1:] in patch)], *((F.col(a) - F.col(f"o{a}")).alias(a) for a in patch))


def sequence_windows(seq: DataFrame, key: str, length: int, seed: str) -> DataFrame:
    """For each sequence (key, t, value): length values from round(u * (n - length - 1)), each with the next one as its target."""
    n = seq.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > length)
    start = n.select(key, F.floor(uniform(seed, F.col(key)) * (F.col("n") - length - 1) + 0.5).alias("s"))
    ahead = seq.withColumn("target", F.lead("value").over(Window.partitionBy(key).orderBy("t")))
    return ahead.join(start, key).where((F.col("t") >= F.col("s")) & (F.col("t") < F.col("s") + length)).select(key, (F.col("t") - F.col("s")).alias("k"), "value", "target")
