"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each shard of documents holds, for every term that the query items use, the
ascending list of the positions where it stands. Positions count through the shard with a gap between documents, so
a phrase never reaches over a document's end. A phrase starts with its rarest term's list, shifted back by the term's offset,
and is intersected with the other terms' shifted lists from rare to frequent; what is left are its exact starts. A
proximity query asks for places where all the terms of a phrase stand within a number of consecutive words.

Query items go to the shards in chunks of bounded bytes, so nothing that grows with the benchmark is broadcast at once but its
terms' hashes. Where there is more than one chunk, the index is built and written once, each chunk reads its own terms' lists, and answers
meet by document. A shard passes over phrases that have a term it lacks all at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import parts, slices
from .storage import local, stored
from .worker import released

WINDOW = 10
#: Consecutive words in which op3_decontamination_near wants all terms of a window: up to five inserted words a window.
NEAR_SPAN = 15
CHUNK_BYTES = 2 << 20
#: So many chunks are kept by the driver between the two passes over them; more are read again.
HELD_CHUNKS = 16
SHARD_CHARS, MEMO = 16_000_000, 200_000
_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_TO_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if x in _WORD_BYTES else 32 for x in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and all that is not ASCII, with A-Z lower-cased."""
    return text.encode().translate(_TO_WORDS).split() if text else []


def phrases(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of window words; a shorter text that has words is one phrase."""
    w = words(text)
    if not w:
        return []
    return [tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))]


def term_hash(term: bytes) -> int:
    """A term's name in the index: 64 bits, signed; -1 stands for no term."""
    h = xxhash.xxh64_intdigest(term)
    return h - (1 << 64) if h >> 63 else h


class _Numbers(dict):
    """word -> its place among terms (hashes, ascending), -1 for all others; remembered, and cleared when large, so memory is bounded."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = term_hash(word)
        at = int(np.searchsorted(self.terms, h))
        n = self[word] = at if at < len(self.terms) and self.terms[at] == h else -1
        return n


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The index of (id, text) for terms (their hashes, ascending): (shard, term, positions), and for term -1 each document's (id, first position, words).

    A shard is a bounded part of a partition of the scan, so its number is the same when a lost task runs again; positions
    are packed unsigned 32-bit integers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        released()
        wanted, memo = sent.value, _Numbers(sent.value)
        for k, b in enumerate(s for whole in batches for s in slices(whole, 1, SHARD_CHARS)):
            shard = TaskContext.get().partitionId() << 32 | k
            n, first = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            # Only words that are terms are kept, in 4 bytes each for term and place.
            flat, place, at = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)], 0
            for i, t in enumerate(b.column(1)):
                w = words(t.as_py())
                term_of = np.fromiter(map(memo.__getitem__, w), np.int32, len(w))
                held = np.flatnonzero(term_of >= 0)
                flat.append(term_of[held])
                place.append((held + at).astype(np.uint32))
                first[i], n[i] = at, len(w)
                at += len(w) + 1
            flat, place = np.concatenate(flat), np.concatenate(place)
            order = np.argsort(flat, kind="stable")
            flat, place = flat[order], place[order]
            del order
            found, at = np.unique(flat, return_index=True)
            lists = np.split(place, at[1:]) if len(found) else []
            ids = b.column(0)
            head = np.concatenate((first, n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(lists) + 1, shard, np.int64)),
                    pa.array(np.concatenate(([-1], wanted[found])).astype(np.int64)),
                    pa.array([head.tobytes(), *(x.tobytes() for x in lists)], pa.binary()),
                    pa.array([np.asarray(ids.fill_null(0)).astype(np.int64).tobytes(), *repeat(None, len(lists))], pa.binary()),
                    pa.array([np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool).tobytes(), *repeat(None, len(lists))], pa.binary()),
                ],
                names=["shard", "term", "positions", "ids", "id_null"],
            )

    return docs.mapInArrow(run, "shard long, term long, positions binary, ids binary, id_null binary")


def _phrase_starts(phrase: tuple[int, ...], lists: dict[int, np.ndarray]) -> np.ndarray:
    """Offset-adjusted intersection from the rarest term on."""
    for t in phrase:
        if t not in lists:
            return np.zeros(0, np.int64)
    order = sorted(range(len(phrase)), key=lambda j: len(lists[phrase[j]]))
    starts = lists[phrase[order[0]]] - order[0]
    for j in order[1:]:
        if not len(starts):
            break
        have, want = lists[phrase[j]], starts + j
        at = np.minimum(np.searchsorted(have, want), len(have) - 1)
        starts = starts[have[at] == want]
    return starts


def _between(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Those of the ascending places that lie from low[k] to high[k], for every k."""
    start, n = np.searchsorted(places, low), np.searchsorted(places, high, side="right")
    n = n - start
    return places[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _near_spans(phrase: tuple[int, ...], lists: dict[int, np.ndarray], span: int) -> np.ndarray:
    """(first, last) of the shortest stretches of span words or fewer, from an occurrence of any term on, that hold all terms of phrase."""
    none = np.zeros((0, 2), np.int64)
    if not set(phrase) <= lists.keys():
        return none
    terms = sorted(set(phrase), key=lambda t: len(lists[t]))
    rare = terms[0]
    held = lists[rare]  # places of the rarest term that have every other term less than span words away
    for t in terms[1:]:
        at = np.searchsorted(lists[t], held - span + 1)
        held = held[(at < len(lists[t])) & (lists[t][np.minimum(at, len(lists[t]) - 1)] < held + span)]
        if not len(held):
            return none
    begin = np.unique(np.concatenate([_between(lists[t], held - span + 1, held) for t in terms]))
    at = np.searchsorted(lists[rare], begin)
    begin = begin[(at < len(lists[rare])) & (lists[rare][np.minimum(at, len(lists[rare]) - 1)] - begin < span)]
    last = begin.copy()
    for t in terms:
        at = np.searchsorted(lists[t], begin)
        last = np.maximum(last, np.where(at < len(lists[t]), lists[t][np.minimum(at, len(lists[t]) - 1)], np.iinfo(np.int64).max))
    ok = last < begin + span
    return np.stack((begin[ok], last[ok]), axis=1)


def _terms(items: list[tuple[str | None, str]]) -> np.ndarray:
    return np.array(sorted({term_hash(w) for _, t in items for w in words(t)}), np.int64)


def _answers(index: DataFrame, items: list[tuple[str | None, str]], window: int, span: int | None) -> DataFrame:
    """(doc_id, n_words, hits, items, near_items) of every document of an index for these items; hits are packed positions in the document."""
    by_phrase: dict[tuple[int, ...], set] = {}
    for i, t in items:
        for p in phrases(t, window):
            by_phrase.setdefault(tuple(term_hash(w) for w in p), set()).add(i)
    # Phrases of equal length as rows of an array, each with the items that have it.
    by_length: dict[int, list] = {}
    for p, who in by_phrase.items():
        by_length.setdefault(len(p), []).append((p, who))
    asked = [(np.array([p for p, _ in x], np.int64), [who for _, who in x]) for x in by_length.values()]
    sent = index.sparkSession.sparkContext.broadcast(asked)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])

    def answer(shard: pa.Table) -> pa.Table:
        term, packed = shard.column("term").to_pylist(), shard.column("positions").to_pylist()
        head = term.index(-1)
        lists = {t: np.frombuffer(p, np.uint32).astype(np.int64) for t, p in zip(term, packed, strict=True) if t != -1}
        have = np.array(sorted(lists), np.int64)
        first, n = np.frombuffer(packed[head], np.int64).reshape(2, -1)
        ids = np.frombuffer(shard.column("ids")[head].as_py(), np.int64)
        null = np.frombuffer(shard.column("id_null")[head].as_py(), bool)
        total = int(first[-1] + n[-1] + 1) if len(n) else 0
        hit = np.zeros(total + 1, np.int32)
        of: list[set] = [set() for _ in range(len(n))]
        near: list[set] = [set() for _ in range(len(n))]
        held = ((p[k].tolist(), who[k]) for p, who in sent.value for k in np.flatnonzero(np.isin(p, have).all(axis=1)).tolist())
        for phrase, who in held:
            starts = _phrase_starts(phrase, lists)
            if len(starts):
                np.add.at(hit, starts, 1)
                np.add.at(hit, starts + len(phrase), -1)
                for d in np.unique(np.searchsorted(first, starts, side="right") - 1):
                    of[d] |= who
            if span:
                spans = _near_spans(phrase, lists, span)
                inside = np.searchsorted(first, spans[:, 0], side="right") == np.searchsorted(first, spans[:, 1], side="right")
                for d in np.unique(np.searchsorted(first, spans[inside, 0], side="right") - 1):
                    near[d] |= who
        covered = np.flatnonzero(np.cumsum(hit, dtype=np.int32)[:total] > 0)
        cut = np.searchsorted(covered, np.append(first, total))
        hits = [(covered[cut[d] : cut[d + 1]] - first[d]).astype(np.uint32).tobytes() for d in range(len(n))]
        named = [[sorted(x for x in s if x is not None) for s in sets] for sets in (of, near)]
        return pa.table([pa.array(ids, mask=null), pa.array(n), pa.array(hits, pa.binary()), *(pa.array(x, pa.list_(pa.string())) for x in named)], schema=schema)

    return index.groupBy("shard").applyInArrow(answer, "doc_id long, n_words long, hits binary, items array<string>, near_items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near_span: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """For every row of docs (doc_id, text): n_words, hits, items, near_items.

    hits: ascending positions, packed as unsigned 32-bit integers, of the words inside an occurrence of a window of an item of
    benchmark (item_id, text). items: the ids of items with occurring windows, as strings, sorted, each once. near_items: with
    near_span, ids of items one of whose windows has all its terms within near_span consecutive words, in any order; else empty.
    Null or wordless texts, of documents or items, have no words and no windows. An item whose id is null marks words but is not named.
    Repeated rows each get a row, repeated items count once; texts count whole, however long; an empty table of items leaves every document
    clean, an empty table of documents gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    n = parts(items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0, chunk_bytes)
    if n == 1:
        few = [tuple(r) for r in items.collect()]  # at most chunk_bytes of text
        return _answers(postings(docs, _terms(few)), few, window, near_span)
    # Several chunks: rows get a number of their own, since ids may repeat, and answers meet by it.
    numbered = stored(docs.withColumn("n", F.monotonically_increasing_id()), "numbered-documents")
    chunk = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    chunks = [[tuple(r) for r in items.where(chunk == k).collect()] for k in range(n)] if n <= HELD_CHUNKS else None
    every = np.unique(np.concatenate([_terms(c) for c in chunks] if chunks else [_terms([tuple(r) for r in items.where(chunk == k).collect()]) for k in range(n)]))
    index = stored(postings(numbered.select(F.col("n").alias("doc_id"), "text"), every), "postings")
    out = None
    for k in range(n):
        part = chunks[k] if chunks else [tuple(r) for r in items.where(chunk == k).collect()]  # about chunk_bytes of text
        own = local(index.sparkSession, [(int(t),) for t in (*_terms(part), -1)], T.StructType([T.StructField("term", T.LongType())]))
        one = _answers(index.join(F.broadcast(own), "term", "left_semi"), part, window, near_span)
        out = one if out is None else out.unionByName(one)
    schema = pa.schema([("n", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary())])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in row])).tobytes() for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.binary()), b.column(3), b.column(4)], names=[*schema.names, "items", "near_items"])

    met = out.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")))
    met = met.mapInArrow(united, "n long, n_words long, hits binary, items array<string>, near_items array<string>")
    return met.join(numbered.select("n", "doc_id"), "n").select("doc_id", "n_words", "hits", "items", "near_items")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
