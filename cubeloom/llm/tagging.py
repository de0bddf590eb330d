"""What the two chain taggers share: bounded training samples, named features, and taggers kept by a worker process."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .crf import Chain, Tagger
from .storage import local
from .worker import kept

_MARKS = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»“”„‘’‚…–—¿¡·"
_WORD = re.compile(r"\S+")


def split_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; of a null id, of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bare(word: str) -> str:
    """Without marks at its ends, in lower case."""
    return word.strip(_MARKS).lower()


def sample(docs: DataFrame, classes: DataFrame, max_rows: int, max_chars: int) -> list[tuple]:
    """(class, text) of whole documents (doc_id, text), at most max_rows of them and about max_chars of text, shared evenly by the classes of
    classes (doc_id, cls): of each, in the order of a hash of the id, its share of the rows, and no more once its share of characters is there.

    A class has a row at least (somewhat more rows than its share are drawn); of more than max_rows classes, the most frequent are taken. Rows that share an id count
    as one document, with the shortest of their texts, and are folded before anything is collected. Only counts, then ids and lengths of
    the drawn documents, then the chosen texts reach the driver; the drawn ids, bounded by max_rows, are broadcast, so only
    the drawn documents are shuffled.
    """
    classes = classes.select("doc_id", "cls").where("doc_id is not null and cls is not null")
    counts = classes.groupBy("cls").count().orderBy(F.desc("count"), "cls").limit(max_rows).collect()
    if not counts:
        return []
    rows, most = max(1, max_rows // len(counts)), max_chars / len(counts)
    shares = local(docs.sparkSession, [(r["cls"], min(1.0, (rows + 4 * math.sqrt(rows) + 8) / r["count"])) for r in counts], T.StructType([classes.schema["cls"], T.StructField("share", T.DoubleType())]))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    drawn = classes.join(F.broadcast(shares), "cls").withColumn("draw", draw).where("draw < share").select("doc_id", "cls", "draw").distinct()
    texts = docs.select("doc_id", "text").where("text is not null")
    shortest = F.min(F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("text")
    sizes = texts.join(F.broadcast(drawn), "doc_id").groupBy("cls", "draw", "doc_id").agg(shortest).select("cls", "draw", "doc_id", "text.n", "text.h").collect()
    chars: Counter = Counter()
    taken: Counter = Counter()
    chosen = []
    for r in sorted(sizes):
        if not taken[r["cls"]] or taken[r["cls"]] < rows and chars[r["cls"]] + r["n"] <= most:
            chosen.append((r["doc_id"], r["cls"], r["h"]))
            taken[r["cls"]] += 1
            chars[r["cls"]] += r["n"]
    if not chosen:
        return []
    wanted = local(docs.sparkSession, sorted(set(chosen)), T.StructType([*drawn.select("doc_id", "cls").schema, T.StructField("h", T.LongType())]))
    met = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "h"])
    found = met.groupBy("cls", "doc_id").agg(F.min("text").alias("text")).select("cls", F.xxhash64("doc_id").alias("h"), "text").collect()
    return [(r["cls"], r["text"]) for r in sorted(found)]


def split_words(texts: Iterable[str]) -> list[list[str]]:
    """Words of each text; equal words are one object, which keeps a sample small."""
    one: dict[str, str] = {}
    return [[one.setdefault(w, w) for w in t.split()] for t in texts]


class Features:
    """Numbers of the features that a fitted model knows; 0 is the feature that every word has."""

    def __init__(self, names_of, known: Iterable[str]) -> None:
        self.names_of = names_of
        self.number = {name: i for i, name in enumerate(known, 1)}

    def __call__(self, form: str) -> list[int]:
        get = self.number.get
        return [0, *(n for x in self.names_of(form) if (n := get(x)))]

    @classmethod
    def common(cls, names_of, words: Counter, least: int, most: int) -> Features:
        """The features of at least so many distinct words' occurrences, the most frequent first, at most so many."""
        n: Counter = Counter()
        for w, c in words.items():
            for name in set(names_of(bare(w))):
                n[name] += c
        return cls(names_of, [x for x, c in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:most] if c >= least])


class Model:
    """A fitted chain with its features and labels; small enough to send to every task by construction."""

    def __init__(self, chain: Chain, features: Features, labels: list) -> None:
        self.chain, self.features, self.labels, self.key = chain, features, labels, uuid.uuid4().hex
        self.edge, self.document = 0.0, None  # a language model's edge weight; a toxicity model's document weights


def fitted(texts: list[list[str]], labels: np.ndarray, n_labels: int, features: Features, steps: int, rate: float = 0.25, decay: float = 1e-5) -> Chain:
    number: dict[str, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64)
    chain = Chain(n_labels, bits=max(1, (len(features.number) + 1).bit_length()))
    if len(words):
        chain.fit(words, [features(bare(w)) for w in number], np.array([len(t) for t in texts], np.int64), labels, steps, rate, decay)
    return chain


def tagger(model: Model) -> Tagger:
    return kept(("tagger", model.key), lambda: Tagger(model.chain, model.features, bare))


def offsets(text: str, places: list[int]) -> list[tuple[int, int]]:
    """(first, last + 1) character of the words at ascending places."""
    wanted, out = set(places), []
    for i, m in enumerate(_WORD.finditer(text)):
        if i in wanted:
            out.append(m.span())
            if len(out) == len(places):
                break
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() or unicodedata.category(c)[0] == "L" for c in text)
