"""Exact duplicates by a tree-merge of sorted digest runs.

A scan takes each text's SHA-256, lower-casing A-Z on the bytes. Each partition folds its digests into a sorted run: a digest once, with the
identifier that stays and how many rows it stands for. Blocks of the digest space then meet in binomial rounds: with 2**BITS-ary
digits, round j cuts every block's run by the digest's j-th digit and sends each part to the block that has this digit in place of
its own. A block merges what it gets, comparing all 32 bytes, and keeps one entry a digest, so a group of copies has one entry a block at
every level however many rows it has. After as many rounds as blocks have digits, a block holds its own range of the digest
space from all partitions. A block sends 2**BITS rows a round, not one to every other block, and its size stays that of a run.

Only groups of two or more send an answer back to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .answers import answered
from .arrow_text import buffers, lowered
from .blocks import slices
from .storage import stored

#: Rows of a run, and about so many distinct digests of a block. A digest's entry takes 57 bytes.
RUN_ROWS = 1 << 17
#: A digit of a block's number has so many bits: a block merges 2**BITS runs.
BITS = 5
RUN = "dest int, digests binary, known binary, ids binary, rows binary, counts binary"
KINDS = ("S32", np.uint8, np.int64, np.int64, np.int64)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: bool = True) -> DataFrame:
    """(doc_id, row, digest) of every row: a number of its own and the SHA-256 of its text; a null text counts as empty."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for b in slices(batch, 1):
                offsets, data = buffers(b.column(1))
                text = memoryview(lowered(data) if lower else data)
                at = offsets.tolist()
                found = [hashlib.sha256(text[s:e]).digest() for s, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(row, row + len(found))), pa.array(found, pa.binary())], names=["doc_id", "row", "digest"])
                row += len(found)

    return source.mapInArrow(run, "doc_id long, row long, digest binary")


def merged(digest: np.ndarray, known: np.ndarray, ids: np.ndarray, rows: np.ndarray, counts: np.ndarray, largest: bool) -> tuple[np.ndarray, ...]:
    """Entries of one or more runs as one sorted run with a digest once: the preferred identifier (a known one before none, of equal ones the first
    row's) and the sum of counts."""
    if not len(digest):
        return digest, known, ids, rows, counts
    order = np.lexsort((~rows, ids if largest else ~ids, known, digest))
    digest = digest[order]
    last = np.append(digest[1:] != digest[:-1], True)
    starts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    keep = order[last]
    return digest[last], known[keep], ids[keep], rows[keep], np.add.reduceat(counts[order], starts)


def _parts(run: tuple[np.ndarray, ...], block: int, level: int, levels: int, bits: int) -> pa.RecordBatch:
    """The run cut by the level's digit, each part with the block that it goes to."""
    shift = bits * (levels - 1 - level)
    lead = np.frombuffer(run[0].tobytes(), ">u8")[::4].astype(np.uint64)
    digit = (lead >> np.uint64(64 - bits * levels) >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
    order = np.argsort(digit, kind="stable")
    edges = np.searchsorted(digit[order], np.arange((1 << bits) + 1))
    dest, columns = [], [[] for _ in run]
    for d in range(1 << bits):
        if edges[d] < edges[d + 1]:
            at = order[edges[d] : edges[d + 1]]
            dest.append(block & ~(((1 << bits) - 1) << shift) | d << shift)
            for column, values in zip(columns, run, strict=True):
                column.append(values[at].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["dest", "digests", "known", "ids", "rows", "counts"])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(b"".join(table.column(i).to_pylist()), kind) for i, kind in enumerate(KINDS, 1))


def groups(rows: DataFrame, n_rows: int, largest: bool = True, run_rows: int = RUN_ROWS, bits: int = BITS) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of every digest that two or more of rows (doc_id, row, digest) have."""
    levels = 1
    while run_rows << (bits * levels) < n_rows and bits * (levels + 1) <= 30:
        levels += 1

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() % (1 << bits * levels), [], 0

        def emitted() -> pa.RecordBatch:
            ids = pa.chunked_array([b.column(0) for b in held])
            digest = np.frombuffer(b"".join(x for b in held for x in b.column(2).to_pylist()), "S32")
            entry = digest, np.asarray(ids.is_valid()).astype(np.uint8), np.asarray(ids.fill_null(0)), np.concatenate([np.asarray(b.column(1)) for b in held]), np.ones(n, np.int64)
            return _parts(merged(*entry, largest), block, 0, levels, bits)

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= run_rows:
                yield emitted()
                held, n = [], 0
        if n:
            yield emitted()

    sent = rows.select("doc_id", "row", "digest").mapInArrow(runs, RUN)

    def exchange(level: int):
        def exchanged(key: tuple, table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_parts(merged(*_unpacked(table), largest), key[0].as_py(), level, levels, bits)])

        return exchanged

    for level in range(1, levels):
        sent = sent.groupBy("dest").applyInArrow(exchange(level), RUN)

    def copies(key: tuple, table: pa.Table) -> pa.Table:
        digest, known, ids, row, counts = merged(*_unpacked(table), largest)
        at = np.flatnonzero(counts > 1)
        raw = digest.tobytes()
        return pa.table([pa.array([raw[32 * i : 32 * i + 32] for i in at.tolist()], pa.binary()), pa.array(ids[at], mask=known[at] == 0), pa.array(row[at]), pa.array(counts[at])], names=["digest", "keep_id", "keep_row", "group_size"])

    return sent.groupBy("dest").applyInArrow(copies, "digest binary, keep_id long, keep_row long, group_size long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, lower: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest (32 bytes) for every row of docs.

    Texts are equal when identical after lower-casing A-Z (not if lower is False), by all of their SHA-256. Of equal texts the row with the largest
    id stays (the smallest if largest is False): rows with a null id give way to others, and of rows with equal ids, or all null ones, exactly one
    stays. keep_id is null where no row of the group has an id. Null texts count as empty and are copies of each other; texts count whole, however
    long. An empty table gives an empty result; further columns are ignored.
    """
    rows = stored(digests(docs, id_col, text_col, lower), "exact-digests")
    n = rows.count()
    found = stored(groups(rows, n, largest), "exact-groups")
    out = answered(rows, found, "digest", "group_size", n)
    alone = F.col("keep_row").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row"))).alias("kept"),
        "digest",
    )
