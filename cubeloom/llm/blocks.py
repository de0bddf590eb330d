"""Documents dealt into blocks of bounded text, and arrays of 64-bit keys dealt between blocks and buckets.

Corpus-wide questions about n-grams or word windows need one row per distinct key. Rows that small cost more in
row headers than in content, so a block's keys for one bucket travel as one row of packed arrays: blocks send
(bucket, block, arrays), a bucket answers about its share of the key space, and answers go back by block. Each block and
each bucket holds a bounded share of the input, because their numbers follow the input's size; repeated keys are
folded inside the block before they are sent, so a word or passage that is in every document arrives once a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import released

BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
BLOCK = "__block"
LEAST_BYTES = 1 << 20
SLICE_CHARS = 2_000_000


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def parts(n_bytes: int, each: int) -> int:
    return max(1, math.ceil(n_bytes / each))


def with_blocks(docs: DataFrame, n_blocks: int, *keys: str) -> DataFrame:
    """Adds the block of each row. Keys are the id and the text, so rows that share an id, or have none, are dealt out too."""
    return docs.withColumn(BLOCK, F.pmod(F.xxhash64(*keys), F.lit(n_blocks)).cast("int"))


def sized(docs: DataFrame, n_bytes: int, each: int) -> int:
    """How many blocks or buckets: so many that each has about so many bytes, and one for each core at least where that leaves LEAST_BYTES to each."""
    return max(parts(n_bytes, each), min(docs.sparkSession.sparkContext.defaultParallelism, n_bytes // LEAST_BYTES))


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered; cleared when large, so memory is bounded."""

    LIMIT = 200_000

    def __init__(self) -> None:
        released()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """An invertible scrambling of 64-bit integers, so that every bit of a sum counts in the leading bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sequence_hashes(h: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every run of width consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        if width <= 8:
            for j in range(width):
                out = out * np.uint64(base) + h[j : j + n]
        else:  # width runs from the halves of a doubling table: log2(width) passes
            power, table, size, done = np.uint64(base), h.copy(), 1, 0
            rest = width
            while rest:
                if rest & 1:
                    out = out * power + table[done : done + n]
                    done += size
                rest >>= 1
                if rest:
                    table = table[: len(table) - size] * power + table[size:]
                    power, size = power * power, 2 * size
        return mixed(out + np.uint64(width))


def deal(bucket: np.ndarray, n_buckets: int, *columns: np.ndarray) -> Iterable[tuple]:
    """(bucket, arrays) for every bucket that has entries; entries keep their order within a bucket."""
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    columns = [c[order] for c in columns]
    for b in range(n_buckets):
        if at[b] < at[b + 1]:
            yield b, [c[at[b] : at[b + 1]] for c in columns]


def slices(batch: pa.RecordBatch, at: int, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Rows in runs of bounded text in column at (a longer row is a run of its own)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).astype(np.int64)
    cut = np.concatenate(([0], np.cumsum(lengths))) // most
    edges = [0, *(np.flatnonzero(np.diff(cut[:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        if e > s:
            yield batch.slice(s, e - s)


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)


def rows(schema: pa.Schema, values: list[tuple]) -> pa.Table:
    columns = list(zip(*values, strict=True)) if values else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
