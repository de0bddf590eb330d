"""Toxic spans by a linear-chain conditional random field; their marginals make a document's score.

Only documents are labelled, so word labels come first: a feature (a word, or the beginning or end of one) marks toxic words if toxic
documents hold it far more often than clean ones; marks are taken greedily, each for the toxic documents that none before it explains.
In toxic documents, words with a mark are labelled 1. The chain learns from those word labels, and its forward-backward
marginals give each word's probability. A mark may stand in clean documents too, so one doubtful word must not decide: a
document's score is a logistic function of its largest marginal, of the sum of its marginals and of that sum by length, fitted on
documents that the chain has not seen.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import slices
from .storage import replaced
from .tagging import Features, Model, bare, fitted, offsets, sample, split_words, tagger
from .worker import released

THRESHOLD, SPAN_THRESHOLD = 0.7, 0.5
#: Whole texts that are tagged at once hold about so many bytes: their words as objects take some twenty times that.
TAGGED = 500_000
#: One sample text in HELD_OUT calibrates document scores; marginals under LEAST say nothing about a document.
HELD_OUT, LEAST = 5, 0.1
#: Document weights before any label is seen: one sure word is enough, doubtful ones add up.
PRIOR = (-5.0, 6.0, 1.0, 0.5)
#: Of both classes together; words of the chain's own part of the sample; features are the most frequent ones that FEW or more training words have.
MAX_ROWS, MAX_CHARS, MAX_WORDS, MAX_FEATURES, FEW, STEPS = 6000, 12_000_000, 400_000, 60_000, 3, 40


def feature_names(w: str) -> list[str]:
    """Of a word in its bare form."""
    return [f"w={w}", *(f"p={w[:k]}" for k in range(3, 9) if len(w) > k), *(f"s={w[-k:]}" for k in (3, 4, 5) if len(w) > k)]


def distinct_texts(texts: list[list[str]]) -> list[list[str]]:
    """One of each group of copies: a text goes if one of three min-hashes of its three-word runs was seen before."""
    seen: set[tuple[int, int]] = set()
    out = []
    for words in texts:
        runs = np.fromiter({zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))}, np.uint64)
        keys = {(k, int(((runs * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((2654435761, 2246822519, 3266489917))}
        if not keys & seen:
            out.append(words)
        seen |= keys
    return out


def marks(toxic: list[list[str]], clean: list[list[str]], least_share: float = 0.004, plain_share: float = 0.02, lift: float = 5.0, blame: float = 2.0) -> list[str]:
    """Features that explain toxic documents, each for more of them than chance would give: lift times the share of clean ones at least.

    The greedy cover is followed by every word of a plain_share of the toxic documents that no clean one has. Copies count once: what
    sets apart one text that was copied often is no mark.
    """
    toxic = distinct_texts(toxic)
    memo: dict[str, list[str]] = {}

    def held(words: list[str]) -> set[str]:
        out: set[str] = set()
        for w in map(bare, set(words)):
            out.update(memo.get(w) or memo.setdefault(w, feature_names(w)))
        return out

    n_clean: Counter = Counter()
    for words in clean:
        n_clean.update(held(words))
    sets = [held(words) for words in toxic]
    n_toxic: Counter = Counter()
    for s in sets:
        n_toxic.update(s)
    ratio = len(clean) / max(1, len(toxic))
    least = max(3, least_share * len(toxic))
    able = {f for f, n in n_toxic.items() if n >= least and n_clean[f] * lift <= n * ratio}
    sets = [s & able for s in sets]
    left: Counter = Counter()
    for s in sets:
        left.update(s)
    out: list[str] = []

    def worth(f: str) -> tuple:
        # New documents explained, less for clean ones it would blame; then the one that most toxic documents hold, then the shorter: it reaches further.
        return left[f] - blame * n_clean[f] / ratio, n_toxic[f], -len(f), f

    while left:
        f = max(left, key=worth)
        if left[f] < least:
            break
        out.append(f)
        for i, s in enumerate(sets):
            if f in s:
                left.subtract(s)
                sets[i] = set()
        left = Counter({f: n for f, n in left.items() if n >= least})
    plain = max(8, plain_share * len(toxic))
    return out + sorted(f for f, n in n_toxic.items() if f.startswith("w=") and len(f) > 2 and n >= plain and not n_clean[f] and f not in out)


def measures(p: np.ndarray) -> tuple[float, float, float]:
    """A document's largest marginal, and the logarithms of their sum and of their sum by thousand words; 0 without words."""
    if not len(p):
        return 0.0, 0.0, 0.0
    total = float(p[p >= LEAST].sum())
    return float(p.max()), math.log1p(total), math.log1p(1000.0 * total / len(p))


def calibrated(x: np.ndarray, y: np.ndarray, steps: int = 50, decay: float = 0.02) -> np.ndarray:
    """Weights (the constant first) of a logistic function of x for labels y, by Newton steps from PRIOR, which few labels hardly move."""
    x = np.column_stack((np.ones(len(x)), x))
    w = prior = np.array(PRIOR)
    for _ in range(steps):
        q = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30.0, 30.0)))
        hessian = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + decay * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - q) - decay * (w - prior))
        w = w + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return w


def learned(toxic: list[list[str]], clean: list[list[str]], max_words: int = MAX_WORDS, max_features: int = MAX_FEATURES, steps: int = STEPS) -> Model:
    """A model of the words of toxic and of clean texts. Without both kinds, or without a mark, nothing is learned."""
    parts = [[t for i, t in enumerate(x) if i % HELD_OUT != HELD_OUT - 1] for x in (toxic, clean)]
    found = set(marks(*parts)) if toxic and clean else set()
    texts, n_toxic = [*parts[0], *parts[1]], len(parts[0])
    words: Counter = Counter(w for t in texts for w in t)
    marked = {w for w in words if found.intersection(feature_names(bare(w)))}
    features = Features.common(feature_names, words, FEW, max_features)
    some = [i for i in range(n_toxic) if any(w in marked for w in texts[i])]
    if not some:
        return Model(fitted([], np.zeros(0, np.int64), 2, features, 0), features, ["none"])
    # As many clean texts as toxic ones with a mark, in turn, until max_words are there, are enough for the chain.
    chosen, n = [], 0
    for i in (i for pair in zip(some, range(n_toxic, len(texts)), strict=False) for i in pair):
        if not chosen or n < max_words:
            chosen.append(i)
            n += len(texts[i])
    labels = np.fromiter((i < n_toxic and w in marked for i in chosen for w in texts[i]), np.int64)
    model = Model(fitted([texts[i] for i in chosen], labels, 2, features, steps), features, [0, 1])
    held = [(t, y) for x, y in ((toxic, 1), (clean, 0)) for t in x[HELD_OUT - 1 :: HELD_OUT]]
    tags, x = tagger(model), []
    for k in range(0, len(held), 200):
        lengths = [len(t) for t, _ in held[k : k + 200]]
        p = tags.tag([t for t, _ in held[k : k + 200]])[:, 1]
        x += [measures(q) for q in np.split(p, np.cumsum(lengths)[:-1])]
    released()  # the driver needs no tagger any more
    model.document = calibrated(np.array(x).reshape(-1, 3), np.array([y for _, y in held], float))
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, max_words: int = MAX_WORDS, max_features: int = MAX_FEATURES, steps: int = STEPS) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic), from about max_rows whole texts and max_chars of text at most, shared evenly by the two
    classes; the chain itself takes about max_words words of them.

    Null texts and labels other than 0 and 1 are left out; a document with both labels counts for both. Without rows of both classes (an empty
    table too) every score is 0. Ties among marks go by name.
    """
    rows = sample(docs, labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("cls")), max_rows, max_chars)
    toxic, clean = (split_words(t for c, t in rows if c == k) for k in (1, 0))
    return learned(toxic, clean, max_words, max_features, steps)


def score_of(p: np.ndarray, document: np.ndarray | None) -> float:
    """A document's score from its marginals; less than LEAST where all of them are."""
    x = measures(p)
    if document is None or x[0] < LEAST:
        return x[0]
    return 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, float(document[0] + document[1:] @ np.array(x))))))


def scored(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """docs without its text (unless keep_text), with score (0 to 1), predicted (1 from threshold on), n_toxic_words (expected number) and spans: the
    (first, last + 1, probability) of words that reach SPAN_THRESHOLD, in characters.

    Null and empty texts score 0; long ones are tagged whole. Rows are independent of each other: repeated ones give equal results, and
    an empty table gives an empty one. Input columns named like a new one give way.
    """
    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_toxic_words", T.DoubleType()), T.StructField("spans", span)]
    keep = [c for c in replaced(docs, *(f.name for f in new)) if c != text_col]
    source = docs.select(*keep, F.col(text_col))
    at, held = len(keep), len(keep) + keep_text
    names = [*source.columns[:held], *(f.name for f in new)]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = tagger(sent.value)
        for whole in batches:
            for b in slices(whole, at, TAGGED):
                texts = b.column(at).to_pylist()
                words = [t.split() if t else [] for t in texts]
                n = np.array([len(w) for w in words], np.int64)
                p = tags.tag(words)[:, 1] if n.sum() and len(sent.value.labels) == 2 else np.zeros(n.sum())
                ends = np.cumsum(n)
                score, many, spans = np.zeros(len(n)), np.zeros(len(n)), []
                for i, (s, e) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
                    spans.append([])
                    if e > s:
                        q = p[s:e]
                        score[i], many[i] = score_of(q, sent.value.document), q.sum()
                        hit = np.flatnonzero(q >= SPAN_THRESHOLD)
                        if len(hit):
                            spans[-1] = [{"first": a, "end": z, "probability": float(q[h])} for (a, z), h in zip(offsets(texts[i], hit.tolist()), hit, strict=True)]
                columns = [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(many), pa.array(spans, spans_type)]
                yield pa.RecordBatch.from_arrays([*b.columns[:held], *columns], names=names)

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:held], *new]))
