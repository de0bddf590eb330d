"""Layers as joins of activations with weight tables, followed by grouped sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def activation(x: Column, name: str) -> Column:
    """tanh, relu, abs, sigmoid or linear."""
    kinds = {"tanh": lambda: F.tanh(x), "relu": lambda: F.greatest(x, F.lit(0.0)), "abs": lambda: F.abs(x), "sigmoid": lambda: 1.0 / (1.0 + F.exp(-x)), "linear": lambda: x}
    return kinds[name.lower()]()


def flattened(df: DataFrame, key: str, order: list[str], value: str = "value") -> DataFrame:
    """(key, features): values of each key as one array in the order of the given columns."""
    cells = F.array_sort(F.collect_list(F.struct(*order, value)))
    return df.groupBy(key).agg(F.transform(cells, lambda c: c[value]).alias("features"))


def dense(x: DataFrame, w: DataFrame, b: DataFrame, key: list[str], act: str = "linear") -> DataFrame:
    """(key, o, z, h) of x (key, i, value): z the sums of value * w over i plus b, h the activation. w (i, o, w) and b (o, b) are a layer's
    parameters and are broadcast; sums combine before the shuffle."""
    met = x.join(F.broadcast(w), "i").groupBy(*key, "o").agg(F.sum(F.col("value") * F.col("w")).alias("s")).join(F.broadcast(b), "o")
    z = F.col("s") + F.col("b")
    return met.select(*key, "o", z.alias("z"), activation(z, act).alias("h"))


def as_input(df: DataFrame, key: list[str], out: str = "h") -> DataFrame:
    return df.select(*key, F.col("o").alias("i"), F.col(out).alias("value"))


def conv(x: DataFrame, w: DataFrame, b: DataFrame, key: list[str], size: dict[str, int], kernel: dict[str, int], flip: bool = True) -> DataFrame:
    """(key, f, axes, z): valid convolution of x (key, ch, axes, value) with w (f, ch, k<axis>, w) plus b (f, b).

    Each input value meets each tap once (the taps are broadcast) and is added to the output it belongs to: a true
    convolution has the taps flipped.
    """
    met = x.join(F.broadcast(w), "ch")
    for a in size:
        at = F.col(a) - ((kernel[a] - 1 - F.col(f"k{a}")) if flip else F.col(f"k{a}"))
        met = met.withColumn(f"o{a}", at).where(F.col(f"o{a}").between(0, size[a] - kernel[a]))
    sums = met.groupBy(*key, "f", *(F.col(f"o{a}").alias(a) for a in size)).agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    return sums.join(F.broadcast(b), "f").select(*key, "f", *size, (F.col("s") + F.col("b")).alias("z"))


def pooled(df: DataFrame, key: list[str], pool: dict[str, int], value: str, signed: bool = False) -> DataFrame:
    """Block maxima (by magnitude with the sign kept, positive in ties, where signed)."""
    best = F.max_by(value, F.struct(F.abs(value), value)) if signed else F.max(value)
    return df.groupBy(*key, *(F.expr(f"{a} div {p}").alias(a) for a, p in pool.items())).agg(best.alias(value))


def maxout(df: DataFrame, key: list[str], factor: int, value: str = "value", channel: str = "ch") -> DataFrame:
    return df.groupBy(*key, F.expr(f"{channel} div {factor}").alias(channel)).agg(F.max(value).alias(value))


def fragments(df: DataFrame, key: list[str], pool: dict[str, int], size: dict[str, int], value: str = "value") -> DataFrame:
    """Pools at every offset below the pool's size: key, o<axis> for the fragment, axes within it, value. All fragments have equal extents."""
    out = df
    for a, p in pool.items():
        out = out.withColumn(f"o{a}", F.explode(F.sequence(F.lit(0), F.lit(p - 1)).cast("array<long>")))
        n = (size[a] - p + 1) // p
        out = out.where((F.col(a) >= F.col(f"o{a}"))).withColumn(a, F.expr(f"({a} - o{a}) div {p}")).where(F.col(a) < n)
    return out.groupBy(*key, *(f"o{a}" for a in pool), *pool).agg(F.max(value).alias(value))


def defragmented(df: DataFrame, pool: dict[str, int]) -> DataFrame:
    """Fragments put side by side again: dense output."""
    others = [c for c in df.columns if c not in pool and not (c[0] == "o" and c[1:] in pool)]
    return df.select(*others, *((F.col(a) * p + F.col(f"o{a}")).alias(a) for a, p in pool.items()))


def softmax(df: DataFrame, key: list[str], z: str = "z", out: str = "p") -> DataFrame:
    """Class probabilities over the rows of each key, from the linear output. One small group for each key."""
    w = Window.partitionBy(*key)
    e = df.withColumn("__e", F.exp(F.col(z) - F.max(z).over(w)))
    return e.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def argmax(df: DataFrame, key: list[str], cls: str, p: str = "p", digits: int = 9) -> DataFrame:
    """(key, pred): the class of the largest value, the first one in ties."""
    return df.groupBy(*key).agg(F.max_by(cls, F.struct(F.round(p, digits), -F.col(cls))).alias("pred"))


def recurrent(seq: DataFrame, key: str, w_in: list[float], w_hid: list[list[float]], bias: list[float], start: list[float]) -> DataFrame:
    """(key, h): the last hidden state of h' = tanh(x * w_in + h @ w_hid + bias) over each sequence (key, t, value).

    A sequence is folded in its row; the weights are literals of the plan.
    """
    n = len(bias)
    frames = F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda c: c["value"])
    rows = seq.groupBy(key).agg(frames.alias("frames"))

    def step(h: Column, x: Column) -> Column:
        return F.array(*(F.tanh(x * w_in[j] + sum((h[i] * w_hid[i][j] for i in range(n)), F.lit(0.0)) + bias[j]) for j in range(n)))

    return rows.select(key, F.aggregate("frames", F.array(*(F.lit(x) for x in start)), step).alias("h"))


def recurrent_streamed(seq: DataFrame, key: str, w_in: list[list[float]], w_hid: list[list[float]], bias: list[float], start: list[float], n_parts: int | None = None) -> DataFrame:
    """(key, h, steps): recurrent's last hidden state, of sequences (key, t, value) of any length, value a number or an array of inputs.

    Rows are dealt by key and sorted by key and t, which spills; a task reads its sequences row by row and carries one state of len(bias) numbers from batch to batch, so a
    sequence never is in memory as a whole. Rows with equal t come in order of their values; a null value is 0.
    """
    many = seq.schema["value"].dataType.typeName() == "array"
    value = F.transform("value", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))) if many else F.array(F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    kind = seq.schema[key].dataType.simpleString()
    rows = seq.select(F.col(key).alias("key"), "t", value.alias("value"))
    dealt = (rows.repartition(n_parts, "key") if n_parts else rows.repartition("key")).sortWithinPartitions("key", "t", "value").select("key", "value")
    weights = [np.array(w, np.float64) for w in (w_in, w_hid, bias, start)]
    width = len(weights[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, over, bias, start = weights
        open_key, h, steps, begun = None, start, 0, False
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            keys, states, counts = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(states, pa.list_(pa.float64())), pa.array(counts, pa.int64())], names=[key, "h", "steps"])

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            if not b.num_rows:
                continue
            given = np.asarray(b.column(1).flatten()).reshape(b.num_rows, width) @ into + bias
            keys = b.column(0).to_pylist()
            for k, x in zip(keys, given, strict=True):
                if not begun or k != open_key:
                    if begun:
                        done.append((open_key, h.tolist(), steps))
                    open_key, h, steps, begun = k, start, 0, True
                h = np.tanh(x + h @ over)
                steps += 1
            if done:
                yield out()
        if begun:
            done.append((open_key, h.tolist(), steps))
            yield out()

    return dealt.mapInArrow(run, f"{key} {kind}, h array<double>, steps long")


def recurrent_repeated(x: DataFrame, key: str, features: str, w_in: list[list[float]], w_hid: list[list[float]], bias: list[float], start: list[float], iterations: int) -> DataFrame:
    """(key, h): the last hidden state where an input without time, an array of features, is given iterations times."""
    n = len(bias)
    given = [sum((F.col(features)[i] * w_in[i][j] for i in range(len(w_in))), F.lit(0.0)) + bias[j] for j in range(n)]
    fed = x.select(key, F.array(*given).alias("__in"))

    def step(h: Column, _: Column) -> Column:
        return F.array(*(F.tanh(F.col("__in")[j] + sum((h[i] * w_hid[i][j] for i in range(n)), F.lit(0.0))) for j in range(n)))

    return fed.select(key, F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.array(*(F.lit(v) for v in start)), step).alias("h"))
