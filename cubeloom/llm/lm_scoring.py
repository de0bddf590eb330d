"""Stupid-backoff language-model scores of documents against the rest of their corpus.

For words w1..wn, the score of a word is c(w[i-2..i]) / c(w[i-2..i-1]) where the trigram is known, else 0.4 times the
bigram's quotient, else 0.16 times the word's share of all words. A document's counts are those of all documents less its own
(leave-one-out), so a document's own n-grams don't vouch for it; an exact copy elsewhere does. Without leave_one_out the counts are
those of all documents, as for a model of the corpus: every n-gram of the corpus is known then, and no word backs off.

The count tables are relational: blocks of documents explode their texts into n-grams and fold equal ones; the folded n-grams, keyed
by a 64-bit hash, are partitioned by that hash into buckets, which sum the counts and answer each block that asked (the
join); a block then sums the logarithms per document. N-grams travel as packed arrays, one row for a block and bucket, so a
frequent n-gram is one entry of each block and no key is hot. Words and bigrams go first. A longer n-gram can only stand in
another document if both n-grams one shorter do, so only those that may are sent, order by order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import BLOCK, WordHashes, bucket_of, deal, rows, sequence_hashes, sized, text_bytes, with_blocks, word_hashes
from .storage import replaced, stored

ORDER, BACKOFF, BLOCK_BYTES, BUCKET_BYTES = 3, 0.4, 12 << 20, 4 << 20
_GRAMS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("order", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_COUNTS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("order", pa.int32()), ("known", pa.binary()), ("counts", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _packed(x: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 and more once again in full at the end."""
    large = x[x >= 255].astype(np.int64)
    return np.minimum(x, 255).astype(np.uint8).tobytes() + large.tobytes() + len(large).to_bytes(4, "little")


def _unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[-4:], "little")
    end = len(x) - 4 - 8 * n
    out = np.frombuffer(x, np.uint8, end).astype(np.int64)
    out[out == 255] = np.frombuffer(x[end:-4], np.int64)
    return out


def _sparse(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as the differences' bytes, lane by lane: the upper lanes are nearly all zero and compress away."""
    d = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def _dense(x: bytes) -> np.ndarray:
    lanes = np.frombuffer(x, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(lanes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


class _Block:
    """A block's n-grams, order by order, and what other documents know of them.

    Keys ascend, and a bucket is a range of keys, so a bucket's answer is aligned with the keys it was sent: which are
    known beyond the block, and their counts.
    """

    def __init__(self, texts: list[str | None], n_buckets: int) -> None:
        memo = WordHashes()
        self.hashes = [word_hashes(words(t), memo) for t in texts]
        self.n_buckets, self.n_docs = n_buckets, len(texts)
        self.n_words = np.array([len(h) for h in self.hashes], np.int64)
        self.others: dict[int, np.ndarray] = {}  # by order, for each n-gram: its count in all other documents
        self.all: dict[int, np.ndarray] = {}  # and in all documents

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and documents of all n-grams, one document after the other."""
        g = [sequence_hashes(h, n) for h in self.hashes]
        return np.concatenate([np.zeros(0, np.uint64), *g]), np.repeat(np.arange(self.n_docs), [len(x) for x in g])

    def shorter(self, n: int, d: np.ndarray, lead: int) -> np.ndarray:
        """For each n-gram the index of its first (lead 0) or last (lead 1) n-gram one shorter."""
        had = np.maximum(self.n_words - n + 2, 0)
        before = np.cumsum(had) - had
        mine = np.maximum(self.n_words - n + 1, 0)
        place = np.arange(len(d)) - (np.cumsum(mine) - mine)[d]
        return before[d] + place + lead

    def sent(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, documents, which): n-grams of order n that may stand in another document."""
        k, d = self.grams(n)
        if n < 3:
            return k, d, np.arange(len(k))
        near = self.others[n - 1] > 0
        which = np.flatnonzero(near[self.shorter(n, d, 0)] & near[self.shorter(n, d, 1)])
        return k[which], d[which], which

    def rows(self, n: int, block: int) -> list[tuple]:
        k, c = np.unique(self.sent(n)[0], return_counts=True)
        return [(b, block, n, _sparse(x), _packed(y)) for b, (x, y) in deal(bucket_of(k, self.n_buckets), self.n_buckets, k, c)]

    def learn(self, n: int, answers: list[tuple[int, bytes, bytes]]) -> None:
        k, d, which = self.sent(n)
        total = len(self.grams(n)[0]) if n > 2 else len(k)
        distinct, at, count = np.unique(k, return_inverse=True, return_counts=True)
        known = count.astype(np.int64)
        edges = np.searchsorted(bucket_of(distinct, self.n_buckets), np.arange(self.n_buckets + 1))
        for bucket, bits, counts in answers:
            s, e = edges[bucket], edges[bucket + 1]
            known[s + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s))] = _unpacked(counts)
        found = known[at]
        several = np.flatnonzero(found > 1)  # the others stand in this document alone
        _, pair, own = np.unique(at[several] * np.int64(self.n_docs) + d[several], return_inverse=True, return_counts=True)
        others = np.zeros(total, np.int64)
        others[which[several]] = found[several] - own[pair]
        self.others[n] = others

    def add_own(self) -> None:
        """Counts over all documents: those of the others and the document's own."""
        for n, others in self.others.items():
            k, d = self.grams(n)
            _, at = np.unique(k, return_inverse=True)
            _, pair, own = np.unique(at * np.int64(self.n_docs) + d, return_inverse=True, return_counts=True)
            self.all[n] = others + own[pair]


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, leave_one_out: bool = True) -> DataFrame:
    """docs without its text, with n_words, n_backed_off (words whose longest n-gram is unknown), log_score (the sum of natural
    logarithms) and score (its mean per word; null without words).

    Counts are over all rows; every row, repeated ones and those with equal or null ids too, is a document of its own and
    is left out of its own counts only (with leave_one_out; else counts are those of all rows). A word that no other row has counts as
    seen half a time. Null and empty texts have 0 words. An
    empty table gives an empty result. Input columns named like a new one give way.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    keep = [c for c in replaced(docs, "n_words", "n_backed_off", "log_score", "score", BLOCK) if c != text_col]
    docs = docs.select(*keep, text_col)
    n_bytes = text_bytes(docs, text_col)
    n_blocks, n_buckets = sized(docs, n_bytes, block_bytes), sized(docs, n_bytes, bucket_bytes)
    by_block = with_blocks(docs, n_blocks, id_col, text_col).groupBy(BLOCK)

    def told(block: pa.Table, answers: pa.Table, orders: range) -> tuple[_Block, int]:
        """The block with what the answers say about its n-grams, and the number of all words."""
        b = _Block(block.column(text_col).to_pylist(), n_buckets)
        by_order: dict[int, list] = {n: [] for n in range(order + 1)}
        for n, *rest in zip(*(answers.column(c).to_pylist() for c in ("order", "bucket", "known", "counts")), strict=True):
            by_order[n].append(rest)
        for n in orders:
            b.learn(n, by_order[n])
        return b, max((int(_unpacked(c)[0]) for *_, c in by_order[0]), default=0)

    def first_grams(block: pa.Table) -> pa.Table:
        number, b = block.column(BLOCK)[0].as_py(), _Block(block.column(text_col).to_pylist(), n_buckets)
        out = [r for n in range(1, min(order, 2) + 1) for r in b.rows(n, number)]
        return rows(_GRAMS, [*out, (-1, number, 0, b"", _packed(np.array([b.n_words.sum()])))])  # how many words the block has

    def longer_grams(n: int):
        def run(block: pa.Table, answers: pa.Table) -> pa.Table:
            if not block.num_rows:
                return rows(_GRAMS, [])
            b, _ = told(block, answers, range(2, n))  # what words alone are known does not matter here
            return rows(_GRAMS, b.rows(n, block.column(BLOCK)[0].as_py()))

        return run

    def summed(bucket: pa.Table) -> pa.Table:
        out = []
        number = bucket.column("bucket")[0].as_py()
        orders, blocks = np.array(bucket.column("order").to_pylist()), bucket.column("block").to_pylist()
        sent, counts = bucket.column("keys"), bucket.column("counts")
        for n in np.unique(orders):
            at = np.flatnonzero(orders == n)
            c = [_unpacked(counts[int(i)].as_py()) for i in at]
            if n == 0:
                out += [(blocks[i], 0, 0, b"", _packed(np.array([sum(int(x[0]) for x in c)]))) for i in at]
                continue
            k = [_dense(sent[int(i)].as_py()) for i in at]
            flat, inverse = np.unique(np.concatenate(k), return_inverse=True)
            every = np.concatenate(c)
            sums = np.bincount(inverse, weights=every, minlength=len(flat)).astype(np.int64)
            more = sums[inverse] != every
            done = 0
            for i, x in zip(at, k, strict=True):
                m = more[done : done + len(x)]
                if m.any():
                    out.append((blocks[i], number, int(n), np.packbits(m).tobytes(), _packed(sums[inverse[done : done + len(x)][m]])))
                done += len(x)
        return rows(_COUNTS, out)

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table([pa.array([], f.type) for f in result], schema=result)
        b, all_words = told(block, answers, range(1, order + 1))
        n_words = b.n_words
        if not leave_one_out:
            b.add_own()
        counts, corpus = (b.others, all_words - n_words) if leave_one_out else (b.all, np.full(b.n_docs, all_words))
        who = np.repeat(np.arange(b.n_docs), n_words)
        place = np.arange(len(who)) - (np.cumsum(n_words) - n_words)[who]
        log = np.log(np.maximum(counts[1], 0.5)) - np.log(np.maximum(corpus[who], 0.5))
        best = np.ones(len(log), np.int64)
        for n in range(2, order + 1):
            d = np.repeat(np.arange(b.n_docs), np.maximum(n_words - n + 1, 0))
            hit = np.flatnonzero(counts[n] > 0)
            ends = np.flatnonzero(place >= n - 1)[hit]  # n-grams stand in the order of the words that end them
            log[ends] = np.log(counts[n][hit]) - np.log(counts[n - 1][b.shorter(n, d, 0)[hit]])
            best[ends] = n
        back = np.minimum(place + 1, order) - best
        log += back * np.log(backoff)
        sums = np.bincount(who, weights=log, minlength=b.n_docs)
        missed = np.bincount(who, weights=back > 0, minlength=b.n_docs).astype(np.int64)
        some = n_words > 0
        mean = np.where(some, sums / np.maximum(n_words, 1), 0.0)
        return block.select(keep).append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_backed_off", pa.array(missed, pa.int64())).append_column("log_score", pa.array(sums)).append_column("score", pa.array(mean, mask=~some))

    out = T.StructType([*docs.select(keep).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_backed_off", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    result = pa.schema([(f.name, _arrow(f.dataType)) for f in out.fields])
    grams = by_block.applyInArrow(first_grams, _ddl(_GRAMS))
    answers = grams.groupBy("bucket").applyInArrow(summed, _ddl(_COUNTS))
    for n in range(3, order + 1):
        if n > 3:  # else plans would double with each order; below, the counts are summed twice from one exchange
            answers = stored(answers, f"ngram-answers-{n - 1}")
        grams = by_block.cogroup(answers.groupBy("block")).applyInArrow(longer_grams(n), _ddl(_GRAMS))
        answers = answers.unionByName(grams.groupBy("bucket").applyInArrow(summed, _ddl(_COUNTS)))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(scored, out)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
