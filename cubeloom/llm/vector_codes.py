"""Product codes of vectors: Lloyd's rounds kept up by deltas.

A vector's integer components fall into equal parts, each coded by the nearest entry of its part's codebook. What a round needs of all
vectors are the entries' sums and counts, which stand on the driver as exact integers (as many as codebooks have components, whatever the
number of vectors). A round reads the vectors with the assignments that the round before wrote, assigns anew, and writes the new assignments;
a part that changed its entry gives a minus to the old one and a plus to the new one, added up within the task, and only these contributions
are shuffled. Vectors are shuffled once, into buckets by row number; assignments lie in the same buckets, so they meet again
without an exchange.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .answers import answered
from .storage import shared_dir, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a bucket, which one task reads.
BUCKET_ROWS, LEAST_ROWS = 200_000, 2_000
#: Integers below this have squared distances that doubles hold exactly; others are computed in Python's integers.
EXACT = 1 << 22
LONG_MAX = (1 << 63) - 1
UNSET = 255


@dataclass(frozen=True)
class Codes:
    """frame: id, label, code (one byte a part), error, label_error of every kept vector; codebooks: integers by part, entry and position."""

    frame: DataFrame
    codebooks: list[list[list[int]]]

    def codebooks_sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.codebooks for entry in part for x in entry).encode()).hexdigest()


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, ints): floor(scale * x) of every component of vectors that have neither null nor non-finite ones."""
    v = F.col(vector_col)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(whole).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).cast("array<long>").alias("ints"))


def _cut(column: pa.Array, parts: int) -> np.ndarray:
    """(vectors, parts, width): doubles where these are exact, else Python's integers."""
    ints = np.asarray(column.flatten()).reshape(len(column), parts, -1)
    return ints.astype(np.float64) if not ints.size or -EXACT < ints.min() and ints.max() < EXACT else ints.astype(object)


def nearest(cut: np.ndarray, codebooks: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, parts) codes, the lowest index of the nearest entries, and each vector's squared distances summed over parts."""
    codes, error = np.empty(cut.shape[:2], np.uint8), np.zeros(len(cut), cut.dtype)
    for p, book in enumerate(codebooks):
        v, c = cut[:, p], np.array(book, cut.dtype).reshape(len(book), cut.shape[2])
        far = (c * c).sum(axis=1) - 2 * (v @ c.T)
        codes[:, p] = at = np.argmin(far, axis=1)
        error = error + far[np.arange(len(v)), at] + (v * v).sum(axis=1)
    return codes, error


class Deltas:
    """Plus and minus contributions, added up: a count and a sum of vectors for each part's entry."""

    def __init__(self, parts: int, entries: int, width: int) -> None:
        self.sums = np.zeros((parts, entries, width + 1), object)

    def add(self, cut: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        n_entries = self.sums.shape[1]
        for p in range(cut.shape[1]):
            moved = np.flatnonzero(before[:, p] != after[:, p])
            if not len(moved):
                continue
            v = np.concatenate((np.ones((len(moved), 1), cut.dtype), cut[moved, p]), axis=1)
            for codes, sign in ((after[moved, p], 1), (before[moved, p], -1)):
                chosen = (codes[:, None] == np.arange(n_entries)).astype(cut.dtype)
                self.sums[p] += sign * (chosen.T @ v).astype(object)

    def rows(self) -> list[tuple[int, int, int, Decimal]]:
        return [(*map(int, at), Decimal(int(self.sums[tuple(at)]))) for at in np.argwhere(self.sums != 0)]


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of every vector that has neither null nor non-finite components.

    Components become floor(scale * x). A part's codebook starts as that part of the vectors with the smallest ids (null ids last; of equal ids the
    smaller vector first, repeated rows each; fewer entries where there are fewer vectors). Each round assigns parts to the nearest entry, ties to the
    lower index, then replaces each used entry by the floors of its parts' means. label_error sums the errors of a label's vectors, null labels
    together. Vectors whose length is not that of the first one, or not a multiple of parts, can't be cut and are left out. Integers stop at those of a
    long, as does an error; all between is exact. Without vectors, frame is empty and there are no entries. Further columns are ignored.
    """
    spark = vectors.sparkSession
    n_buckets = max(1, -(-(n := vectors.count()) // BUCKET_ROWS), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    name = f"vector_codes_{uuid.uuid4().hex}"

    def bucketed(df: DataFrame, label: str) -> DataFrame:
        df.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}-{label}").bucketBy(n_buckets, "row").saveAsTable(f"{name}_{label}")
        return spark.table(f"{name}_{label}")

    found = integers(vectors, id_col, vector_col, label_col, scale).where(F.size("ints") % parts == 0).withColumn("row", F.monotonically_increasing_id())
    base = bucketed(found.repartition(n_buckets, "row"), "vectors")
    order = [F.col("id").asc_nulls_last(), "ints"]
    first = base.orderBy(*order).select("ints").first()
    width = len(first["ints"]) // parts if first else 0
    base = base.where(F.size("ints") == width * parts)
    starters = [r["ints"] for r in base.orderBy(*order).select("ints").limit(entries).collect()]
    books = [[v[p * width : (p + 1) * width] for v in starters] for p in range(parts)]
    sums = [[[0] * (width + 1) for _ in starters] for _ in range(parts)]
    before = None
    for k in range(rounds if starters else 0):
        last = k == rounds - 1
        source = base.select("row", "ints")
        source = source.join(before.hint("shuffle_hash"), "row") if before is not None else source.withColumn("code", F.lit(None).cast("binary"))
        moved = source.mapInArrow(_round(books, parts, width, not last), "row long, code binary, part int, entry int, at int, amount decimal(38,0)")
        if not last:
            moved = bucketed(moved, f"round{k + 1}")
            before = moved.where("code is not null").select("row", "code")
        changes = moved.where("part is not null").groupBy("part", "entry", "at").agg(F.sum("amount").alias("amount")).where("amount <> 0").collect()
        for r in changes:
            sums[r["part"]][r["entry"]][r["at"]] += int(r["amount"])
        if not changes:  # all further rounds would find the same
            break
        books = [[[s // total[0] for s in total[1:]] if total[0] else entry for entry, total in zip(book, totals, strict=True)] for book, totals in zip(books, sums, strict=True)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = nearest(_cut(b.column(2), parts), books)
            error = [min(int(x), LONG_MAX) for x in error] if error.dtype == object else error.astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_packed(codes), pa.binary()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    kinds = dict(base.dtypes)
    final = stored(base.select("id", "label", "ints").mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code binary, error long"), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX)).cast("long")
    by_label = stored(final.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n")), "vector-label-errors")
    return Codes(answered(final, by_label, "label", "n", n).drop("n"), books)


def _packed(codes: np.ndarray) -> list[bytes]:
    raw, k = codes.tobytes(), codes.shape[1]
    return [raw[i : i + k] for i in range(0, len(raw), k)]


def _round(books: list[list[list[int]]], parts: int, width: int, write: bool):
    """A task's share of a round: rows of new codes (if write), then its contributions, in rows that lie in the bucket of its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deltas, row = Deltas(parts, len(books[0]), width), None
        names = ["row", "code", "part", "entry", "at", "amount"]
        for b in batches:
            if not b.num_rows:
                continue
            cut = _cut(b.column(1), parts)
            codes, _ = nearest(cut, books)
            old = b.column(2)
            held = np.full(codes.shape, UNSET, np.uint8) if old.null_count else np.frombuffer(b"".join(old.to_pylist()), np.uint8).reshape(codes.shape)
            deltas.add(cut, held, codes)
            row = b.column(0)[-1].as_py()
            if write:
                none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_packed(codes), pa.binary()), *none], names=names)
        if found := deltas.rows():
            part, entry, at, amount = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.nulls(len(found), pa.binary()), *(pa.array(x, pa.int32()) for x in (part, entry, at)), pa.array(amount, pa.decimal128(38, 0))], names=names)

    return run
