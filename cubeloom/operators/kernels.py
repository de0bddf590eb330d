"""Layers over dense rows (one array for each example) as NumPy kernels on Arrow batches: the throughput path.

The relational forms in layers.py explode an example into a row for each product. Where an example fits one array, a batch is one
matrix and a layer one product of matrices; weights are small and go along with the task. Both forms give the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ACTIVATIONS = {"tanh": np.tanh, "relu": lambda x: np.maximum(x, 0.0), "abs": np.abs, "sigmoid": lambda x: 1.0 / (1.0 + np.exp(-x)), "linear": lambda x: x}
SLICE = 2048


def _matrix(column: pa.Array, n: int, digits: int | None) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, n)
    return x if digits is None else np.round(x, digits) + 0.0


def weights_array(table: DataFrame, dims: dict[str, int], value: str = "w") -> np.ndarray:
    """A parameter table (a layer's, so of bounded size) as an array with the given axes."""
    out = np.zeros(tuple(dims.values()))
    for r in table.collect():
        out[tuple(r[d] for d in dims)] = r[value]
    return out


def mlp_probabilities(rows: DataFrame, key: str, features: str, layers: list[tuple[np.ndarray, np.ndarray, str]], digits: int | None = 4) -> DataFrame:
    """(key, label, pred, p): the most likely class (the first in ties) and its probability after dense layers (weights, bias, activation)."""
    n = layers[0][0].shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                x = _matrix(b.column(2), n, digits)
                for w, bias, act in layers:
                    x = ACTIVATIONS[act](x @ w + bias)
                p = np.exp(x - x.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = np.round(p, 9).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best), pa.array(p.max(axis=1))], names=[key, "label", "pred", "p"])

    return rows.select(key, "label", features).mapInArrow(run, f"{key} long, label long, pred long, p double")


def conv_pool(rows: DataFrame, key: str, features: str, side: int, w: np.ndarray, bias: np.ndarray, pool: int, act: str, digits: int | None = 4) -> DataFrame:
    """(key, f, x, y, h): a true convolution of square images with w (f, kx, ky), block maxima, activation."""
    n_f, kernel = w.shape[0], w.shape[1]
    flipped = w[:, ::-1, ::-1].reshape(n_f, -1)
    out = side - kernel + 1
    kept = out // pool
    f, x, y = (a.ravel() for a in np.meshgrid(np.arange(n_f), np.arange(kept), np.arange(kept), indexing="ij"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                img = _matrix(b.column(1), side * side, digits).reshape(-1, side, side)
                windows = np.lib.stride_tricks.sliding_window_view(img, (kernel, kernel), axis=(1, 2)).reshape(len(img), out * out, -1)
                z = (windows @ flipped.T).transpose(0, 2, 1).reshape(len(img), n_f, out, out)[:, :, : kept * pool, : kept * pool]
                z = z.reshape(len(img), n_f, kept, pool, kept, pool).max(axis=(3, 5)) + bias[None, :, None, None]
                m = len(img)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), len(f))), pa.array(np.tile(f, m)), pa.array(np.tile(x, m)), pa.array(np.tile(y, m)), pa.array(ACTIVATIONS[act](z).ravel())], names=[key, "f", "x", "y", "h"])

    return rows.select(key, features).mapInArrow(run, f"{key} long, f long, x long, y long, h double")
