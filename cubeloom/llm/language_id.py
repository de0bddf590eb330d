"""Word and document languages by a linear-chain conditional random field.

Features of a word: its affixes, its character n-grams and a lexicon (the language that nearly all of its training
occurrences have). Training words carry their document's language; beside the documents stand spliced ones, stretches of
documents of several languages one after the other, so the learned transitions know both staying in a language and switching, and
forward-backward labels code-switched text in runs. A document's language is the one with the largest sum of
marginals, in which its first and last words count more where that fits training documents that the chain has not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import slices
from .storage import replaced
from .tagging import Features, Model, bare, fitted, has_letter, sample, split_words, tagger
from .worker import released

#: Of all languages together; features are the most frequent ones that FEW or more training words have.
MAX_ROWS, MAX_CHARS, MAX_FEATURES, FEW, STEPS = 12_000, 1_600_000, 60_000, 3, 30
#: One spliced text for so many training texts, of stretches of between so many words; one training text in HELD_OUT chooses the edge weight.
SPLICED, STRETCH, HELD_OUT = 8, (8, 40), 5
UNDETERMINED = "und"
EDGE_WEIGHTS, EDGE_WORDS = (0.0, 0.25, 0.5, 1.0), 10


class Names:
    """The feature names of words, with a lexicon of (word, language)."""

    def __init__(self, lexicon: dict[str, str]) -> None:
        self.lexicon = lexicon

    def __call__(self, w: str) -> list[str]:
        """Of a word in its bare form."""
        if not any(map(str.isalpha, w)):
            return ["none"]
        n, m = len(w), f"^{w}$"
        out = [f"p={w[:k]}" for k in (1, 2, 4) if n >= k] + [f"s={w[-k:]}" for k in (1, 2, 4) if n >= k]
        out += {m[i : i + 3] for i in range(n)}
        if w in self.lexicon:
            out.append(f"l={self.lexicon[w]}")
        return out


def lexicon(texts: list[list[str]], langs: list[str], least: int = 4, share: float = 0.95) -> dict[str, str]:
    n: dict[str, Counter] = {}
    for t, lang in zip(texts, langs, strict=True):
        for w in t:
            n.setdefault(bare(w), Counter())[lang] += 1
    return {w: c.most_common(1)[0][0] for w, c in n.items() if w and c.total() >= least and c.most_common(1)[0][1] >= share * c.total()}


def spliced(texts: list[list[str]], labels: list[int], n: int) -> tuple[list[list[str]], list[np.ndarray]]:
    """(texts, their words' labels): n texts of up to four stretches, each of another language than the one before it; the draws are the same in each run."""
    rng, by = np.random.default_rng(7), {}
    for i, label in enumerate(labels):
        if texts[i]:
            by.setdefault(label, []).append(i)
    known, out, of = sorted(by), [], []
    if len(known) < 2:
        return [], []
    for _ in range(n):
        words, marks, at = [], [], int(rng.integers(len(known)))
        for _ in range(int(rng.integers(2, 5))):
            t = texts[by[known[at]][int(rng.integers(len(by[known[at]])))]]
            size, start = int(rng.integers(*STRETCH)), int(rng.integers(len(t)))
            some = t[start : start + size]
            words += some
            marks += [known[at]] * len(some)
            at = (at + 1 + int(rng.integers(len(known) - 1))) % len(known)
        out.append(words)
        of.append(np.array(marks, np.int64))
    return out, of


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, max_features: int = MAX_FEATURES, steps: int = STEPS) -> Model:
    """A model of labelled (doc_id, text, lang), from about max_rows whole texts and max_chars of text at most, shared evenly by the languages.

    Null texts and languages are left out; of more than max_rows languages, the most frequent are learned. Repeated rows are drawn
    together, ties among features go by name. Without rows (an empty table too), nothing is learned and every text is undetermined.
    """
    rows = sample(labelled, labelled.where("text is not null").select("doc_id", F.col("lang").alias("cls")), max_rows, max_chars)
    texts, of = split_words(t for _, t in rows), [c for c, _ in rows]
    langs = sorted(set(of))
    number = {x: i for i, x in enumerate(langs)}
    held = [i for i in range(len(texts)) if i % HELD_OUT == HELD_OUT - 1]
    kept_texts, kept_of = ([x for i, x in enumerate(xs) if i % HELD_OUT != HELD_OUT - 1] for xs in (texts, of))
    names = Names(lexicon(kept_texts, kept_of))
    features = Features.common(names, Counter(w for t in kept_texts for w in t), FEW, max_features)
    labels = [number[x] for x in kept_of]
    mixed, mixed_labels = spliced(kept_texts, labels, len(kept_texts) // SPLICED)
    flat = np.concatenate([np.zeros(0, np.int64), *(np.full(len(t), x) for t, x in zip(kept_texts, labels, strict=True)), *mixed_labels])
    model = Model(fitted([*kept_texts, *mixed], flat, max(1, len(langs)), features, steps), features, langs)
    model.edge = edge_weight(model, [texts[i] for i in held], [of[i] for i in held])
    return model


def edge_weight(model: Model, texts: list[list[str]], of: list[str]) -> float:
    """How much a document's first and last words count beside all of them: the least of EDGE_WEIGHTS that names most of these documents right.

    Code-switched text tends to begin and end in its own language. The documents are training rows that the chain was not fitted on.
    """
    right = dict.fromkeys(EDGE_WEIGHTS, 0)
    tags = tagger(model)
    for k in range(0, len(texts), 200):
        some = texts[k : k + 200]
        ends = np.cumsum([len(t) for t in some])
        p = tags.tag(some)
        for t, e, lang in zip(some, ends.tolist(), of[k : k + 200], strict=True):
            if t:
                for w in EDGE_WEIGHTS:
                    right[w] += model.labels[int(shares(p[e - len(t) : e], w).argmax())] == lang
    released()  # the driver needs no tagger any more
    return max(EDGE_WEIGHTS, key=lambda w: (right[w], -w))


def shares(p: np.ndarray, edge: float) -> np.ndarray:
    """Each language's share of a document's words (at least one), its first and last EDGE_WORDS weighed in; they sum to 1."""
    return (p.mean(axis=0) + edge * (p[:EDGE_WORDS].mean(axis=0) + p[-EDGE_WORDS:].mean(axis=0))) / (1.0 + 2.0 * edge)


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without its text, with lang_pred, score (that language's share of its words, the first and last weighed in, 0 to 1) and runs: (lang, n_words) of consecutive words.

    Null texts and those without a letter are undetermined ("und"), with score 0 and no runs. Words without a letter follow
    their neighbours in runs and don't count for the document. Whole texts count, however long; of languages with equal shares the first
    by name is taken. Rows are independent of each other, so repeated ones give equal results; an empty table gives an empty result. Input columns
    named like a new one give way.
    """
    runs = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_words", T.IntegerType())]))
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("runs", runs)]
    keep = [c for c in replaced(docs, *(f.name for f in new)) if c != text_col]
    source = docs.select(*keep, F.col(text_col))
    at, names = len(keep), [*keep, *(f.name for f in new)]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    runs_type = pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, edge = sent.value.labels, sent.value.edge
        tags = tagger(sent.value)
        for whole in batches:
            for b in slices(whole, at):
                words = [t.split() if langs and has_letter(t) else [] for t in b.column(at).to_pylist()]
                n = np.array([len(w) for w in words], np.int64)
                p = tags.tag(words) if n.sum() else np.zeros((0, max(1, len(langs))))
                lettered = {w: any(map(str.isalpha, w)) for w in set().union(*words)}
                counts = np.fromiter((lettered[w] for t in words for w in t), bool, len(p))
                best, ends = p.argmax(axis=1), np.cumsum(n)
                lang, score, stretches = [], [], []
                for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True):
                    if e == s:
                        lang.append(UNDETERMINED)
                        score.append(0.0)
                        stretches.append([])
                        continue
                    share = shares(p[s:e][counts[s:e]], edge)  # the text has a letter, so some word counts
                    lang.append(langs[int(share.argmax())])
                    score.append(float(min(1.0, share.max())))
                    cut = np.concatenate(([0], np.flatnonzero(np.diff(best[s:e])) + 1, [e - s]))
                    stretches.append([{"lang": langs[best[s + a]], "n_words": int(z - a)} for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(stretches, runs_type)], names=names)

    return source.mapInArrow(run, T.StructType([*source.select(keep).schema.fields, *new]))
