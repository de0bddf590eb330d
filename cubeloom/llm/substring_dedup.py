"""Removal of passages that an earlier document has too.

A passage recurs where a window of 50 words also starts in a document with a smaller id. Four exchanges find all of them:

1. Each block of documents proposes phrases: the 8-word runs whose hash is the least in some window. Equal windows propose
   equal phrases, so a window can only recur around a phrase that two documents propose.
2. Buckets of the phrases' hash space confirm which of them recur and send those, as words, to the blocks that proposed them.
3. Each block compiles the confirmed phrases it was sent into an Aho-Corasick automaton over word numbers (a shard of all phrases,
   whose size follows the block's, not the corpus's) and streams all its documents through it. The automaton alone tells
   where phrases stand: only windows around its hits are looked at. The distinct ones go, as 96-bit hashes with the block's
   smallest document, to buckets, which find each window's smallest document of all. However many documents share a window, a bucket
   gets it once a block.
4. Where another block has a smaller document, the bucket tells; the block removes the words of windows that start earlier.

Each document's text is shuffled once, by block; all steps reuse that exchange.
"""

from __future__ import annotations

from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import BLOCK, BLOCK_BYTES, BUCKET_BYTES, WordHashes, bucket_of, deal, rows, sequence_hashes, sized, text_bytes, with_blocks, word_hashes
from .storage import replaced

WINDOW, ANCHOR = 50, 8
# Phrases are words joined by spaces, one phrase a line, in the order of their keys.
_PROPOSED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("several", pa.binary()), ("phrases", pa.binary())])
_CONFIRMED = pa.schema([("block", pa.int32()), ("phrases", pa.binary())])
# A block asks a bucket about its distinct windows (keys to index) and sends itself where they stand (rows to which).
_WINDOWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), *((n, pa.binary()) for n in ("keys", "checks", "ids", "index", "rows", "starts", "which"))])
_ANSWERS = pa.schema([("block", pa.int32()), *((n, pa.binary()) for n in ("index", "ids", "rows", "starts", "which"))])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _runs_max(x: np.ndarray, width: int) -> np.ndarray:
    """The maximum of every run of width values."""
    done, size = x, 1
    while 2 * size <= width:
        done, size = np.maximum(done[: len(done) - size], done[size:]), 2 * size
    rest = width - size
    return np.maximum(done[: len(done) - rest], done[rest:]) if rest else done


def anchors_of(grams: np.ndarray, per_window: int) -> np.ndarray:
    """Where a gram is the least of some window of per_window grams."""
    if len(grams) < per_window:
        return np.zeros(0, np.int64)
    least = ~_runs_max(~grams, per_window)
    around = np.concatenate((np.zeros(per_window - 1, np.uint64), least, np.zeros(per_window - 1, np.uint64)))
    return np.flatnonzero(_runs_max(around, per_window) == grams)


def _in_order(block: pa.Table, id_col: str, text_col: str) -> pa.Table:
    """The block's rows by id and text: a shuffle delivers them in any order, and row numbers travel between two deliveries."""
    ids, texts = block.column(id_col).to_pylist(), block.column(text_col).to_pylist()
    return block.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or "")), pa.int64()))


def _texts(block: pa.Table, text_col: str) -> list[list[bytes]]:
    return [t.encode().split() if (t := x.as_py()) else [] for x in block.column(text_col)]


def _equal_runs(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, at): the stable order by key and check, and where in it each run of equal ones begins."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    return order, np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))))


def _occurrences(automaton: ahocorasick.Automaton, numbers: np.ndarray, length: int) -> np.ndarray:
    """The last word's place of every phrase of length words in a document. 0 is a word of no phrase: the automaton reads the stretches between."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], numbers > 0, [0])).astype(np.int8)))
    ends: list[int] = []
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if e - s >= length:
            ends += [s + at for at, _ in automaton.iter(tuple(numbers[s:e].tolist()))]
    return np.array(ends, np.int64)


def recurring_passages_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with n_words, n_removed and kept_text (null where nothing was removed).

    Words are runs of bytes other than ASCII white space. A word goes if a window of 50 words that covers it also starts in a row
    with a smaller id; windows are judged on the input. kept_text is the other words joined by one space (empty where all went).
    Null or empty text has no words; texts of fewer than 50 words lose none. Rows with equal ids count as one document and never take
    words from each other. A row with a null id neither gives nor loses words. Texts count whole, however long. An empty table gives an
    empty result. Input columns named like a new one give way; all others are kept.
    """
    keep = replaced(docs, "n_words", "n_removed", "kept_text", BLOCK)
    docs = docs.select(*keep)
    n_bytes = text_bytes(docs, text_col)
    n_blocks, n_buckets = sized(docs, n_bytes, block_bytes), sized(docs, n_bytes, bucket_bytes)
    dealt = with_blocks(docs, n_blocks, id_col, text_col)
    by_block = dealt.groupBy(BLOCK)
    per_window = window - anchor + 1

    def ids_of(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = block.column(id_col).combine_chunks()
        return np.asarray(ids.fill_null(0).cast(pa.int64())), np.asarray(ids.is_null())

    def propose(block: pa.Table) -> pa.Table:
        memo, keys, who, phrases = WordHashes(), [], [], []
        ids, null = ids_of(block)
        for i, w in enumerate(_texts(block, text_col)):
            if len(w) >= window and not null[i]:
                g = sequence_hashes(word_hashes(w, memo), anchor)
                at = anchors_of(g, per_window)
                g, first = np.unique(g[at], return_index=True)
                keys.append(g)
                who.append(np.full(len(g), ids[i]))
                phrases += [b" ".join(w[p : p + anchor]) for p in at[first].tolist()]
        if not keys:
            return rows(_PROPOSED, [])
        k, d = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
        number = block.column(BLOCK)[0].as_py()
        dealt_out = deal(bucket_of(k[at], n_buckets), n_buckets, k[at], several, order[at])
        return rows(_PROPOSED, [(b, number, x.tobytes(), np.packbits(s).tobytes(), b"\n".join(map(phrases.__getitem__, p.tolist()))) for b, (x, s, p) in dealt_out])

    def confirm(bucket: pa.Table) -> pa.Table:
        blocks = bucket.column("block").to_pylist()
        keys = [np.frombuffer(x, np.uint64) for x in bucket.column("keys").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(bucket.column("several").to_pylist(), keys, strict=True)]
        flat = np.sort(np.concatenate(keys))
        recur = np.unique(np.concatenate((flat[1:][flat[1:] == flat[:-1]], *(k[s] for k, s in zip(keys, several, strict=True)))))
        out = []
        for b, k, packed in zip(blocks, keys, bucket.column("phrases"), strict=True):
            hit = np.flatnonzero(np.isin(k, recur, assume_unique=True))
            if len(hit):
                phrases = packed.as_py().split(b"\n")
                out.append((b, b"\n".join([phrases[i] for i in hit.tolist()])))
        return rows(_CONFIRMED, out)

    def locate(block: pa.Table, confirmed: pa.Table) -> pa.Table:
        if not confirmed.num_rows or not block.num_rows:
            return rows(_WINDOWS, [])
        block = _in_order(block, id_col, text_col)
        ids, null = ids_of(block)
        memo, automaton, numbers = WordHashes(), ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
        for packed in confirmed.column("phrases"):
            for phrase in packed.as_py().split(b"\n"):
                automaton.add_word(tuple([numbers.setdefault(x, len(numbers) + 1) for x in phrase.split(b" ")]), True)
        automaton.make_automaton()
        key, check, row, start = [], [], [], []
        for i, w in enumerate(_texts(block, text_col)):
            if len(w) < window or null[i]:
                continue
            ends = _occurrences(automaton, np.fromiter(map(numbers.get, w, repeat(0)), np.int64, len(w)), anchor)
            if not len(ends):
                continue
            n, first = len(w) - window + 1, ends - anchor + 1
            near = np.zeros(n + 1, np.int32)
            np.add.at(near, np.clip(first - per_window + 1, 0, n), 1)
            np.add.at(near, np.minimum(first + 1, n), -1)
            s = np.flatnonzero(np.cumsum(near[:n]) > 0)
            if len(s):
                h = word_hashes(w, memo)
                key.append(sequence_hashes(h, window)[s])
                check.append((sequence_hashes(h ^ (h >> np.uint64(29)), window, 0xD6E8FEB86659FD93)[s] >> np.uint64(32)).astype(np.uint32))
                row.append(np.full(len(s), i, np.int32))
                start.append(s.astype(np.int32))
        if not key:
            return rows(_WINDOWS, [])
        key, check, row, start = map(np.concatenate, (key, check, row, start))
        # Equal windows of the block become one, numbered in the order in which they first stand.
        order, at = _equal_runs(key, check)
        which = np.empty(len(key), np.int64)
        which[order] = np.repeat(np.argsort(np.argsort(order[at])), np.diff(np.append(at, len(key))))
        first = np.sort(order[at])
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[row])
        number = block.column(BLOCK)[0].as_py()
        asked = deal(bucket_of(key[first], n_buckets), n_buckets, key[first], check[first], least, np.arange(len(first), dtype=np.int32))
        own = (number % n_buckets, number, None, None, None, None, row.tobytes(), start.tobytes(), which.astype(np.int32).tobytes())
        return rows(_WINDOWS, [own, *((b, number, *(x.tobytes() for x in sent), None, None, None) for b, sent in asked)])

    def earliest(bucket: pa.Table) -> pa.Table:
        out, asked = [], []
        for r in bucket.select([n for n in _WINDOWS.names if n != "bucket"]).to_pylist():
            if r["keys"] is None:
                out.append((r["block"], None, None, r["rows"], r["starts"], r["which"]))
            else:
                asked.append((r["block"], *(np.frombuffer(r[n], t) for n, t in (("keys", np.uint64), ("checks", np.uint32), ("ids", np.int64), ("index", np.int32)))))
        if asked:
            key, check, ids = (np.concatenate([a[k] for a in asked]) for k in (1, 2, 3))
            order, at = _equal_runs(key, check)
            least = np.empty(len(key), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.append(at, len(key))))
            done = 0
            for number, k, _, own, index in asked:
                found = least[done : done + len(k)]
                done += len(k)
                if len(lower := np.flatnonzero(found < own)):
                    out.append((number, index[lower].tobytes(), found[lower].tobytes(), None, None, None))
        return rows(_ANSWERS, out)

    def remove(block: pa.Table, removed: pa.Table) -> pa.Table:
        block = _in_order(block, id_col, text_col)
        gone: dict[int, np.ndarray] = {}
        answers = removed.to_pylist()
        for own in (a for a in answers if a["rows"] is not None):  # one, or none
            row, start, which = (np.frombuffer(own[n], np.int32) for n in ("rows", "starts", "which"))
            ids = ids_of(block)[0][row]
            least = np.full(int(which.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, which, ids)
            for a in answers:
                if a["index"] is not None:
                    least[np.frombuffer(a["index"], np.int32)] = np.frombuffer(a["ids"], np.int64)
            later = np.flatnonzero(ids > least[which])
            found, at = np.unique(row[later], return_index=True)
            gone = dict(zip(found.tolist(), np.split(start[later], at[1:]), strict=True)) if len(found) else {}
        n_words, n_removed, kept = [], [], []
        for i, w in enumerate(_texts(block, text_col)):
            n_words.append(len(w))
            if i not in gone:
                n_removed.append(0)
                kept.append(None)
                continue
            depth = np.zeros(len(w) + 1, np.int32)
            np.add.at(depth, gone[i], 1)
            np.add.at(depth, gone[i] + window, -1)
            stay = np.flatnonzero(np.cumsum(depth)[: len(w)] == 0)
            n_removed.append(len(w) - len(stay))
            kept.append(b" ".join([w[j] for j in stay.tolist()]).decode())
        return block.select(keep).append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64())).append_column("kept_text", pa.array(kept, pa.string()))

    confirmed = by_block.applyInArrow(propose, _ddl(_PROPOSED)).groupBy("bucket").applyInArrow(confirm, _ddl(_CONFIRMED))
    found = by_block.cogroup(confirmed.groupBy("block")).applyInArrow(locate, _ddl(_WINDOWS))
    removed = found.groupBy("bucket").applyInArrow(earliest, _ddl(_ANSWERS))
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return by_block.cogroup(removed.groupBy("block")).applyInArrow(remove, out)
