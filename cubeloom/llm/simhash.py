"""SimHash near-duplicates, found with Golay-code keys.

A fingerprint's 64 bits fall into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two bits
agree in at least one segment (pigeonhole), and each other segment differs in at most two bits. A segment, padded to 23
bits plus a parity bit, is decoded in the extended binary Golay code: a word within distance 3 of a codeword gets that
codeword's index as its key, any other lies at distance 4 from exactly six codewords and gets six keys. Any two words at
distance 2 or less share a key. So for each segment taken as exact, the next one gives 1 or 6 fuzzy keys: at most 18
keys of 33 bits for a fingerprint, and no pair within two bits is missed.

Exact copies collapse to one fingerprint before any key is made. Fingerprints that share a key meet in one list, where links
are verified and the list's linked groups leave as stars (n - 1 links, never all pairs). A key that more than LIST fingerprints share is split
by the Golay keys of the third segment, which differs in at most two bits as well: still no pair is missed. Components join the stars in
rounds of large-star and small-star steps, each a grouped minimum and a join, with lineage cut by a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import replaced, stored
from .worker import released

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011  # fixed value: the binary Golay code's generator polynomial of degree 11
SEED, SHINGLE, MAX_BITS = 42, 3, 2
SCAN = 2048
#: Fingerprints of a key from which it is split; how many split keys are broadcast at most.
LIST, BROADCAST_KEYS = 4096, 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The text's 64-bit SimHash; 0 where there is no word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    width = min(shingle, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, n - width + 1)
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """docs without its text, with the fingerprint as a signed long in column out."""
    keep = replaced(docs, text_col, out)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, T.LongType())])
    source = docs.select(*keep, F.col(text_col))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(at)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(fps.view(np.int64))], names=[*keep, out])

    return source.mapInArrow(run, schema)


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2**23 words: how many keys it has (1 or 6), and the codeword index of the first key; see golay_keys.

    Built from the generator: syndromes of all error patterns of weight 3 or less give the nearest codeword.
    """
    syndromes = _syndromes()
    leader = np.zeros(2048, np.int32)
    weight = np.full(2048, 9, np.int8)
    masks = [0, *(1 << i for i in range(23)), *(1 << i | 1 << j for i in range(23) for j in range(i)), *(1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j))]
    for m in masks:
        s = _syndrome_of(m, syndromes)
        w = m.bit_count()
        if w < weight[s]:
            weight[s], leader[s] = w, m
    return leader, weight


def _syndromes() -> list[int]:
    out = []
    for i in range(23):
        r = 1 << i
        for j in range(22, 10, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - 11)
        out.append(r)
    return out


def _syndrome_of(word: int, syndromes: list[int]) -> int:
    s = 0
    for i in range(23):
        if word >> i & 1:
            s ^= syndromes[i]
    return s


class Golay:
    """Keys of 23-bit words."""

    def __init__(self) -> None:
        self.syndromes = np.array(_syndromes(), np.int32)
        self.leader, self.weight = golay_tables()
        # The tetrads of each weight-4 coset of the extended code: error patterns of weight 4 on 23 bits by syndrome.
        four: list[list[int]] = [[] for _ in range(2048)]
        s = [int(x) for x in self.syndromes]
        for i in range(23):
            for j in range(i):
                for k in range(j):
                    for m in range(k):
                        four[s[i] ^ s[j] ^ s[k] ^ s[m]].append(1 << i | 1 << j | 1 << k | 1 << m)
        self.four = np.zeros((2048, 5), np.int32)
        for x in range(2048):
            if self.weight[x] == 3:
                self.four[x] = four[x]

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key): one key for words within distance 2 of a codeword, six for all others. A key is the codeword's 12 information bits."""
        syn = np.zeros(len(words), np.int32)
        for i in range(23):
            syn ^= np.where(words >> i & 1, self.syndromes[i], 0).astype(np.int32)
        row = np.arange(len(words))
        near = (words ^ self.leader[syn]) >> 11
        deep = np.flatnonzero(self.weight[syn] == 3)
        more = (words[deep, None] ^ self.four[syn[deep]]) >> 11
        return np.concatenate((row, np.repeat(deep, 5))), np.concatenate((near, more.ravel()))


def fingerprint_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): 35 bits of which two say which segment is exact, its bits, and a Golay key of the next segment."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        row, fuzzy = golay.keys(seg[(i + 1) % 3])
        rows.append(row)
        keys.append(np.int64(i) << 34 | seg[i][row] << 12 | fuzzy.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def linked_stars(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """(member, root) for every linked group of two or more among distinct fingerprints; exact for any number of them."""
    left = np.sort(fps)
    links: list[tuple[int, int]] = []
    if len(left) > SCAN:
        bits = [np.uint64(1) << np.uint64(i) for i in range(64)]
        masks = np.array([*bits, *(a ^ b for i, a in enumerate(bits) for b in bits[:i])], np.uint64)
        open_ = np.ones(len(left), bool)
        for start in range(len(left)):
            if not open_[start]:
                continue
            open_[start], front = False, np.array([start])
            while len(front):
                found: list[np.ndarray] = []
                for f in front:
                    near = left[f] ^ masks
                    at = np.minimum(np.searchsorted(left, near), len(left) - 1)
                    hit = at[(left[at] == near) & open_[at]]
                    open_[hit] = False
                    found.append(hit)
                front = np.concatenate(found)
                links += [(int(left[x]), int(left[start])) for x in front]
        return links
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for f in front:
                hit |= np.bitwise_count(left ^ f) <= max_bits
            front, left = left[hit], left[~hit]
            links += [(int(x), int(root)) for x in front]
    return links


def links(distinct_fps: DataFrame, fp: str = "fp", most: int | None = None) -> DataFrame:
    """Stars (u, v) whose components are those of all links of two bits or fewer between the distinct fingerprints; keys of more than
    most (LIST) fingerprints are split."""
    most = LIST if most is None else most
    source = distinct_fps.select(F.col(fp).alias("fp"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = None
        for b in batches:
            golay = golay or Golay()
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, key = fingerprint_keys(fps, golay)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64))], names=["key", "fp"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = None
        for b in batches:
            golay = golay or Golay()
            key, fps = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            third = np.zeros(len(key), np.int64)
            for i in range(3):
                at, n = SEGMENTS[(i + 2) % 3]
                third = np.where(key >> 34 == i, (fps.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1), third)
            row, fuzzy = golay.keys(third)
            yield pa.RecordBatch.from_arrays([pa.array(1 << 60 | key[row] << 12 | fuzzy.astype(np.int64)), pa.array(fps[row])], names=["key", "fp"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for row in b.column(0) for x in linked_stars(np.asarray(row.values.to_numpy(zero_copy_only=False)).view(np.uint64))]
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    pairs = source.mapInArrow(keyed, "key long, fp long")
    hot = stored(pairs.groupBy("key").count().where(F.col("count") > most).select("key"), "hot-fingerprint-keys")
    if n_hot := hot.count():
        hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        pairs = pairs.join(hot, "key", "left_anti").unionByName(pairs.join(hot, "key", "left_semi").mapInArrow(split, "key long, fp long"))
    met = pairs.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select("fps").mapInArrow(verified, "u long, v long").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v): each node u of the links with its component's smallest node v; v itself has no row."""
    high = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    mark = None
    while True:
        high = stored(high, label)
        now = high.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or not now["n"]:
            return high
        mark = now
        both = high.unionByName(high.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        high = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long), component_id for every row of docs.

    Words are split at ASCII white space with A-Z lower-cased; a fingerprint bit is set where over half of the three-word shingles'
    XXH64 values have it. Rows whose fingerprints differ in two bits or fewer are linked; component_id is the smallest
    id that links reach. Null or empty text has fingerprint 0 and is linked like any other; repeated rows and ids each keep their
    row; a null id is never a component's id unless the component has no other (then it is null). Whole texts count, however long. An
    empty table gives an empty result; further columns are ignored.
    """
    fps = stored(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "fingerprints")
    return grouped(fps)


def component_of(fps: DataFrame) -> DataFrame:
    """(fp, component) of every distinct fp of fps; component is its group's smallest fingerprint."""
    distinct = stored(fps.select("fp").distinct(), "distinct-fingerprints")
    roots = components(links(distinct), "fingerprint-components").select(F.col("u").alias("fp"), F.col("v").alias("component"))
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def grouped(fps: DataFrame) -> DataFrame:
    """(doc_id, fp) with component_id."""
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = stored(component_of(fps).join(first, "fp"), "components-of-fingerprints")
    lowest = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    where = rooted.join(lowest, "component").select("fp", "component_id")
    return fps.join(where, "fp").select("doc_id", "fp", "component_id")
