"""SentencePiece encoding by Viterbi over an Aho-Corasick automaton, and decoding.

The automaton holds all pieces. One pass over a text reports, at each position, every piece that ends there (the longest
first, the others along its output links); each relaxes the best score of its end from that of its start. A character
that no piece covers costs ten more than the worst piece and becomes the pieces of its UTF-8 bytes. The best path is that
of the largest sum of the model's own piece scores.

No piece reaches over the start of a word (the mark for a space stands only at a piece's front) or over a line feed, so
the best path of a text is made of the best paths of its words, which are remembered in a bounded table per task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import replaced
from .worker import kept

MARK = "▁"
_CHUNKS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
UNKNOWN_COST = 10.0


class Codec:
    """Encoder and decoder of one model file. Paths of words are kept in a table of at most memo_size words."""

    def __init__(self, model_file: str, memo_size: int = 200_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int64)
        self.automaton = ahocorasick.Automaton()
        worst = 0.0
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in p.lstrip(MARK) or "\n" in p:
                    raise ValueError(f"piece {p!r} reaches over the start of a word")
                worst = min(worst, model.get_score(i))
                self.automaton.add_word(p, (len(p), i, model.get_score(i)))
        self.automaton.make_automaton()
        self.unknown, self.unknown_id = worst - UNKNOWN_COST, model.unk_id()
        self.byte_of = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids) if i >= 0}
        self.special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        self.memo: dict[str, bytes] = {}
        self.memo_size = memo_size

    def best_path(self, text: str) -> list[int]:
        """The ids of the best path of normalised text."""
        n = len(text)
        best, came, piece = [0.0] + [None] * n, [0] * (n + 1), [-1] * (n + 1)
        at = 0  # every position up to here has its best score

        def unknowns(to: int) -> int:
            nonlocal at
            while at < to:
                at += 1
                value = best[at - 1] + self.unknown
                if not single[at] and (best[at] is None or value > best[at]):
                    best[at], came[at], piece[at] = value, at - 1, -1
            return at

        single = [False] * (n + 1)
        for end, (length, i, score) in self.automaton.iter(text):
            end += 1
            if at < end - 1:
                unknowns(end - 1)
            start = end - length
            if length == 1:
                single[end] = True
            value = best[start] + score
            if best[end] is None or value > best[end]:
                best[end], came[end], piece[end] = value, start, i
        unknowns(n)
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            elif self.byte_ids[0] >= 0:
                out += [int(self.byte_ids[b]) for b in reversed(text[n - 1].encode())]
            else:
                out.append(self.unknown_id)
            n = came[n]
        return out[::-1]

    def _packed(self, chunk: str) -> bytes:
        if len(self.memo) >= self.memo_size:
            self.memo.clear()
        if len(chunk) > 200:  # not a word: don't hold it
            return np.array(self.best_path(chunk), "<u4").tobytes()
        found = self.memo[chunk] = np.array(self.best_path(chunk), "<u4").tobytes()
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        chunks = _CHUNKS.findall(MARK + text.replace(" ", MARK))
        known = list(map(self.memo.get, chunks))
        if None in known:
            for j, k in enumerate(known):
                if k is None:
                    known[j] = self.memo.get(chunks[j]) or self._packed(chunks[j])
        return np.frombuffer(b"".join(known), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; where bytes are not UTF-8, the replacement character stands for them."""
        out, held = [], b""
        if not any(int(x) in self.byte_of or int(x) in self.special for x in np.unique(ids)):
            joined = "".join(map(self.pieces.__getitem__, ids.tolist()))
        else:
            for i in ids.tolist():
                if (b := self.byte_of.get(i)) is not None:
                    held += b
                    continue
                if held:
                    out.append(held.decode(errors="replace"))
                    held = b""
                if i not in self.special:
                    out.append(self.pieces[i])
            joined = "".join(out) + held.decode(errors="replace")
        return joined.replace(MARK, " ")[1:]


def codec_of(model_file: str) -> Codec:
    return kept(("codec", model_file), lambda: Codec(model_file))


def encoded(docs: DataFrame, model_file: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """docs with its text replaced by ids (array<int>), n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers);
    with decode, also n_decoded_chars and round_trip: whether the decoded ids equal the text.

    A literal mark character decodes as a space, as in the format itself; round_trip compares accordingly. Null and
    empty texts have no ids and round_trip true. Rows are independent: repeated rows give repeated results, an empty table an empty
    one. Input columns named like a new one give way. model_file must be readable on the executors, like the libraries.
    """
    new = [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    new += [("n_decoded_chars", T.LongType()), ("round_trip", T.BooleanType())] if decode else []
    keep = [c for c in replaced(docs, *(n for n, _ in new)) if c != text_col]
    source = docs.select(*keep, F.col(text_col))
    out = T.StructType([*source.select(keep).schema.fields, *(T.StructField(n, t) for n, t in new)])
    names, at = [f.name for f in out.fields], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_file)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                texts = b.column(at).to_pylist()
                ids = [codec.encode(t) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                columns = [
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32))),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ]
                if decode:
                    back = [codec.decode(x) for x in ids]
                    columns += [pa.array([len(x) for x in back], pa.int64()), pa.array([x == (t or "").replace(MARK, " ") for x, t in zip(back, texts, strict=True)])]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], *columns], names=names)

    return source.mapInArrow(run, out)


def decoded(tokens: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """tokens with out_col, the text of ids_col; null ids give null."""
    keep = replaced(tokens, out_col)
    at = keep.index(ids_col)
    out = T.StructType([*tokens.select(keep).schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_file)
        for b in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.uint32)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*keep, out_col])

    return tokens.select(keep).mapInArrow(run, out)
