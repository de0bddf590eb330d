"""Gradients as grouped sums, update rules as expressions over parameter tables, and iterative optimisers.

The model state is small (a layer's weights) and lives in tables or on the driver; examples stay distributed. Each step of a
loop is one pass that adds up partial losses and gradients.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def softmax_delta(p: DataFrame, key: str, n: Column) -> DataFrame:
    """(key, c, delta): the loss's gradient at the linear output, for the mean of -ln(p + eps). p: key, label, c, p."""
    own = p.where(F.col("label") == F.col("c")).select(key, (F.col("p") / (F.col("p") + EPS)).alias("__own"))
    hit = (F.col("label") == F.col("c")).cast("double")
    return p.join(own, key).select(key, "c", ((F.col("p") - hit) * F.col("__own") / n).alias("delta"))


def outer_sum(x: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """(i, c, g): the weight gradient, the sum over examples of value * delta."""
    return x.select(key, "i", "value").join(delta, key).groupBy("i", "c").agg(F.sum(F.col("value") * F.col("delta")).alias("g"))


def backward_tanh(delta: DataFrame, w: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """(key, o, delta) of a tanh layer below weights w (i, o, w): delta comes by (key, c)."""
    up = delta.join(F.broadcast(w.select(F.col("i").alias("h_o"), F.col("o").alias("c"), "w")), "c").groupBy(key, "h_o").agg(F.sum(F.col("delta") * F.col("w")).alias("s"))
    met = up.join(hidden.select(key, F.col("o").alias("h_o"), "h"), [key, "h_o"])
    return met.select(key, F.col("h_o").alias("c"), (F.col("s") * (1.0 - F.col("h") * F.col("h"))).alias("delta"))


def sgd(w: Column, g: Column, v: Column, rate: float, momentum: float, decay: float) -> tuple[Column, Column]:
    """(new weight, new velocity)."""
    new = g + momentum * v
    return w - rate * new - rate * decay * w, new


def adam(w, g, m, v, t: int, rate: float, b1: float, b2: float, eps: float):
    """(new weight, new moments), of columns or of arrays."""
    root = F.sqrt if isinstance(v, Column) else np.sqrt
    m, v = b1 * m + (1.0 - b1) * g, b2 * v + (1.0 - b2) * g * g
    return w - (rate * float(np.sqrt(1.0 - b2**t)) / (1.0 - b1**t)) * m / (root(v) + eps), m, v


# Fixed values of the step rule: products of slopes that count as a turn or as agreement, what keeps a division finite, and the least and largest step.
TURN, AGREE, FLOOR, LEAST_STEP, LARGEST_STEP = -1e-9, 1e-11, 1e-6, 1e-7, 2e-3


def rprop(w, g, last, step, gain: float, penalty: float, decay: float):
    """(new weight, new step), of columns or of arrays: the weight moves by the old step."""
    agree = g * last
    if isinstance(g, Column):
        new = F.when(agree < TURN, step * (1.0 - penalty)).when(agree > AGREE, step * (1.0 + gain)).otherwise(step)
        return w - step * g / (F.abs(g) + FLOOR) - decay * w, F.least(F.greatest(new, F.lit(LEAST_STEP)), F.lit(LARGEST_STEP))
    new = np.where(agree < TURN, step * (1.0 - penalty), np.where(agree > AGREE, step * (1.0 + gain), step))
    return w - step * g / (np.abs(g) + FLOOR) - decay * w, np.clip(new, LEAST_STEP, LARGEST_STEP)


def rate_at(step: Column, start: float, decay: float, every: int, schedule: dict[int, float]) -> Column:
    """The learning rate after step: multiplied by decay every so many steps (step 0 too), and set by a schedule at exact steps.

    The last scheduled rate before holds from its step on, with the decays after it.
    """
    base, since = F.lit(start), F.lit(-1)
    for s, v in sorted(schedule.items()):
        base, since = F.when(step >= s, v).otherwise(base), F.when(step >= s, s).otherwise(since)
    times = F.floor(step / every) - F.floor(since / every)
    return base * F.pow(F.lit(decay), times + F.when((since >= 0) & (since % every == 0), 1).otherwise(0))


def loss_and_gradient(examples: DataFrame, n_in: int, n_out: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The mean loss of a softmax layer over examples (features array<double>, label), and its gradient, at given weights (n_in + 1, n_out).

    Each partition sums its own rows' loss and gradient; only these partial sums are added up.
    """

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, g, n = 0.0, np.zeros((n_in + 1, n_out)), 0
            for b in batches:
                x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, n_in)
                x, y = np.hstack((x, np.ones((len(x), 1)))), np.asarray(b.column(1))
                z = x @ w
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                own = p[np.arange(len(y)), y]
                total -= np.log(own + EPS).sum()
                p[np.arange(len(y)), y] -= 1.0
                g += x.T @ (p * (own / (own + EPS))[:, None])
                n += len(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.size + 2)), pa.array(np.concatenate((g.ravel(), [total, n])))], names=["k", "v"])

        sums = np.zeros((n_in + 1) * n_out + 2)
        for r in examples.select("features", "label").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # as many rows as weights
            sums[r["k"]] = r["v"]
        n = max(sums[-1], 1.0)
        return float(sums[-2] / n), sums[:-2].reshape(n_in + 1, n_out) / n

    return at


def line_search(loss: Callable[[np.ndarray], float], w: np.ndarray, d: np.ndarray, start: float, slope: float, most: float = 1.0, beta: float = 0.5, alpha: float = 1e-3, least: float = 1e-3) -> tuple[float, float, int]:
    """(t, loss, trials) by backtracking; stops early where the loss rises again."""
    last, t = None, most
    for k in range(max(1, int(np.log(least / most) / np.log(beta)))):
        t = most * beta**k
        now = loss(w + t * d)
        if now <= start + t * alpha * slope or last is not None and now > last:
            return t, now, k + 1
        last = now
    return t, last, k + 1


def conjugate_gradient(at: Callable, w: np.ndarray, steps: int) -> tuple[np.ndarray, list[tuple[float, float, float]]]:
    """Weights and (loss, t, coefficient) of each step (Polak and Ribiere, not below 0)."""
    log, g_last, d = [], None, None
    for _ in range(steps):
        loss, g = at(w)
        coefficient = 0.0 if g_last is None else max(0.0, float((g * (g - g_last)).sum() / (g_last * g_last).sum()))
        d = -g if d is None else -g + coefficient * d
        slope = float((g * d).sum())
        if slope > 0:
            d, slope = -g, -float((g * g).sum())
        t, new, _ = line_search(lambda x: at(x)[0], w, d, loss, slope)
        w, g_last = w + t * d, g
        log.append((new, t, coefficient))
    return w, log


def lbfgs(at: Callable, w: np.ndarray, steps: int, memory: int = 5) -> tuple[np.ndarray, list[float]]:
    """Limited-memory quasi-Newton steps; the history holds at most memory pairs on the driver."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    loss, g = at(w)
    log = [loss]
    for _ in range(steps):
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - (y * q).sum() / (s * y).sum())
        t, _, _ = line_search(lambda x: at(x)[0], w, -q, loss, -float((g * q).sum()))
        new = w - t * q
        new_loss, new_g = at(new)
        if ((new - w) * (new_g - g)).sum() > 1e-12:
            pairs = [*pairs, (new - w, new_g - g)][-memory:]
        w, g, loss = new, new_g, new_loss
        log.append(loss)
    return w, log
