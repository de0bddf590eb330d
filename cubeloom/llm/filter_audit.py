"""What each of a set of document filters removes, in every order of applying them.

Texts are scanned as Arrow's byte buffers: tables of byte classes mark white space, capitals, symbols and first bytes of characters, and
prefix sums over the marks give each document's counts. Distinct words come from sorting a document's word hashes; neighbours with
equal hashes are compared byte by byte, and a document where two words share a hash is counted anew from its words. What leaves the scan is
a row of numbers and a digest a document.

A document's failures are a mask of five bits. Rows fold to counts of masks by part (32 a part at most), and everything that is asked of
the orders is a sum over masks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import buffers
from .blocks import mixed, slices
from .storage import stored

LETTERS = "ABCDE"
#: Texts of more bytes are read in pieces of about so many; words of more bytes are hashed and compared one by one.
LONG_TEXT, LONG_WORD = 4 << 20, 256
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


WHITE, SYMBOL = _class(b" \t\n\v\f\r"), _class(b"#$%&*|")
CAPITAL, FIRST_BYTE = _class(bytes(range(65, 91))), _class(bytes(x for x in range(256) if x & 0xC0 != 0x80))
_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def _eight(windows: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, zeros after the first left ones."""
    return windows[at].view(np.uint64).ravel() & _LOW[np.minimum(left, 8)]


def word_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    keys = mixed(_eight(windows, starts, lengths) ^ mixed(lengths.astype(np.uint64)))
    left = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    done = 8
    while len(left):
        keys[left] = mixed(keys[left] ^ _eight(windows, starts[left] + done, lengths[left] - done))
        done += 8
        left = left[lengths[left] > done]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        keys[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return keys


def _same(data: np.ndarray, windows: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the words at a (of n bytes) and b (of m bytes) are equal."""
    same = n == m
    left, done = np.flatnonzero(same & (n <= LONG_WORD)), 0
    while len(left):
        ok = _eight(windows, a[left] + done, n[left] - done) == _eight(windows, b[left] + done, n[left] - done)
        same[left[~ok]] = False
        done += 8
        left = left[ok & (n[left] > done)]
    for i in np.flatnonzero(same & (n > LONG_WORD)).tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + n[i]], data[b[i] : b[i] + n[i]])
    return same


def scanned(offsets: np.ndarray, data: np.ndarray, keys_of=word_keys) -> list[np.ndarray]:
    """COUNTS of texts that lie in data between neighbouring offsets."""
    begin, end = offsets[:-1], offsets[1:]
    filled = begin[end > begin]
    word = ~WHITE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[filled] = word[filled]
    last[end[end > begin] - 1] = word[end[end > begin] - 1]

    def per_text(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return sums[end] - sums[begin]

    n_words = per_text(first)
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = ends - starts
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    text_of = np.repeat(np.arange(len(begin)), n_words)
    keys = keys_of(data, starts, lengths, windows)
    order = np.lexsort((keys, text_of))
    here, after = order[:-1], order[1:]
    pair = np.flatnonzero((keys[here] == keys[after]) & (text_of[here] == text_of[after]))
    here, after = here[pair], after[pair]
    same = _same(data, windows, starts[here], starts[after], lengths[here], lengths[after])
    n_distinct = n_words - np.bincount(text_of[here[same]], minlength=len(begin))
    for i in np.unique(text_of[here[~same]]).tolist():
        n_distinct[i] = len(set(data[begin[i] : end[i]].tobytes().split()))
    return [n_words, n_distinct, per_text(CAPITAL[data]), per_text(FIRST_BYTE[data]), per_text(SYMBOL[data])]


def scanned_long(data: np.ndarray, piece: int = LONG_TEXT) -> list[int]:
    """COUNTS of one text, read in pieces that end at white space."""
    words: set[bytes] = set()
    total, at, size = np.zeros(4, np.int64), 0, len(data)
    while at < size:
        end = min(at + piece, size)
        while end < size and not WHITE[data[end]]:
            more = np.flatnonzero(WHITE[data[end : end + piece]])
            end = min(end + (int(more[0]) if len(more) else piece), size)
        part = data[at:end]
        own = part.tobytes().split()
        words.update(own)
        total += [len(own), *(int(c[part].sum()) for c in (CAPITAL, FIRST_BYTE, SYMBOL))]
        at = end
    return [int(total[0]), len(words), *total[1:].tolist()]


def counted(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """The columns keep of docs with COUNTS of the text and its 16-byte digest. Words are separated by ASCII white space and differ by case; a null
    text is empty."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", " + ", ".join(f"{c} long" for c in COUNTS) + ", digest binary"
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, n_keep):
                offsets, data = buffers(b.column(n_keep))
                if len(data) > LONG_TEXT:
                    columns = [np.array(x, np.int64) for x in zip(*(scanned_long(data[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)), strict=True)]
                else:
                    columns = scanned(offsets, data)
                text, at = memoryview(data), offsets.tolist()
                found = [hashlib.blake2b(text[s:e], digest_size=16).digest() for s, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], *map(pa.array, columns), pa.array(found, pa.binary())], names=[*keep, *COUNTS, "digest"])

    return docs.select(*keep, text_col).mapInArrow(run, schema)


#: What fails filters A to D; E is decided over the whole table.
FAILS = ("n_words < 200", "100 * n_distinct < 50 * n_words", "100 * n_capitals > 2 * n_chars", "n_symbols > 0")


def masks(docs: DataFrame, labels: DataFrame, part_col: str = "source", fails: tuple[str, ...] = FAILS) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of mask (bit i: the i-th), and how many of these are labelled
    good (quality 1) and toxic.

    The last filter fails a text that a smaller id has too, in any part. A null id is neither smaller nor larger than another, and has no label;
    an id that is labelled more than once is good or toxic if any of its labels says so.
    """
    mask = sum(((F.expr(x)).cast("int") * (1 << i) for i, x in enumerate(fails)), F.lit(0))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), "text")
    scan = counted(source, "text", "doc_id", "part").select("doc_id", "part", mask.alias("mask"), "digest")
    rows = stored(scan.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "audit-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    flags = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flags = flags.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    known = rows.where("doc_id is not null").join(first, ["digest", "doc_id"], "left").join(flags, "doc_id", "left")
    repeated = F.when(F.col("first").isNull(), 1 << len(fails)).otherwise(0)
    known = known.select("part", (F.col("mask") + repeated).alias("mask"), "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = rows.where("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    n = F.sum("n").alias("n")
    return known.unionByName(nameless).groupBy("part", "mask").agg(n, F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _orders(n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(order, own filter, mask of the filters before) for every order and step."""
    found = [("".join(LETTERS[f] for f in p), p[k], sum(1 << f for f in p[:k])) for p in permutations(range(n)) for k in range(n)]
    names, own, before = zip(*found, strict=True)
    return list(names), np.array(own), np.array(before)


def interactions(counts: DataFrame, n_filters: int = len(LETTERS)) -> DataFrame:
    """For every part of counts (part, mask, n, good, toxic), order of the filters and step: kept after the step, removed by it, redundant (failing its filter,
    but removed before), unique_fails (failing its filter alone), good_lost and toxic_lost among the removed, and shapley: what its filter
    removes, summed over all orders. A part has one row an order and step, zeros too."""
    names, own, before = _orders(n_filters)
    mask = np.arange(1 << n_filters)[:, None]
    fails, gone = mask >> own & 1 == 1, (mask & before) != 0
    kept, removed, redundant, alone = ~gone & ~fails, ~gone & fails, gone & fails, mask == 1 << own
    steps = (np.arange(len(names)) % n_filters + 1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, found in zip(b.column(0), b.column(1), strict=True):
                n = np.zeros((3, 1 << n_filters), np.int64)
                for x in found.as_py():
                    n[:, x["mask"]] = x["n"], x["good"], x["toxic"]
                lost = n @ removed
                by_filter = np.bincount(own, weights=lost[0], minlength=n_filters).astype(np.int64)
                columns = [n[0] @ kept, lost[0], n[0] @ redundant, n[0] @ alone, lost[1], lost[2], by_filter[own]]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(names)), pa.array(names), pa.array(steps), *map(pa.array, columns)], names=["part", "filter_order", "step", *OUT])

    whole = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("found"))
    return whole.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUT))


OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """interactions of the five filters over docs (doc_id, text and part_col) with labels (doc_id, quality, toxic).

    Filters fail a text of under 200 words (A), with less than half of its words distinct (B), with over 2 % of capitals A-Z (C), with one of #$%&*|
    (D), or that a smaller id has too (E). A null text is empty (it fails A, and E where a smaller id has an empty text); a null part is the empty
    one; repeated rows count each, and rows that share id and text fail E together or not at all; texts count whole, however long. An empty table
    gives no row; further columns are ignored.
    """
    return interactions(masks(docs, labels, part_col))
