"""The chain taggers: many labels, switches between languages, marks that clean texts hold too, and samples of odd tables."""

import itertools
import math

import numpy as np

from cubeloom.llm import crf, language_id, tagging, toxicity

SYLLABLES = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]


def test_marginals_of_many_labels_are_those_of_enumeration():
    rng = np.random.default_rng(8)
    lengths, t = np.array([2, 0, 3, 1]), rng.random((9, 9)) + 0.1
    p, at = rng.random((6, 9)) + 0.1, 0
    got = crf.marginals(p, t, lengths)
    for n in lengths:
        weights = np.zeros((n, 9))
        for path in itertools.product(range(9), repeat=int(n)):
            w = math.prod(p[at + i, s] for i, s in enumerate(path)) * math.prod(t[a, b] for a, b in itertools.pairwise(path))
            for i, s in enumerate(path):
                weights[i, s] += w
        if n:
            assert np.allclose(weights / weights.sum(axis=1, keepdims=True), got[at : at + n])
        at += n


def test_both_layouts_give_the_same_messages():
    rng = np.random.default_rng(9)
    p, t, fresh = rng.random((700, 4)) + 0.1, rng.random((4, 4)) + 0.1, rng.random(700) < 0.02
    fresh[0] = True
    assert np.allclose(crf._in_lanes(p, t, fresh), crf._by_text(p, t, fresh))


def test_any_number_of_languages(spark):
    rng = np.random.default_rng(10)
    rows = [(100 * k + i, " ".join("".join([SYLLABLES[k % 70], *rng.choice(SYLLABLES, 2)]) for _ in range(30)), f"l{k:02}") for k in range(70) for i in range(4)]
    df = spark.createDataFrame([*rows, (None, "x y", "l00"), (7, None, "l00"), (8, "x y", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df, steps=10)
    assert len(model.labels) == 70
    out = language_id.identified(df, model).where("doc_id >= 100").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) > 0.9 * len(out)
    few = language_id.fit(df, max_rows=5, steps=2)  # fewer rows than languages: the most frequent, then the first by name
    assert few.labels == ["l00", "l01", "l02", "l03", "l04"]


def test_spliced_texts_switch():
    texts, labels = language_id.spliced([["a"] * 50, ["b"] * 50, ["c"] * 50, []], [0, 1, 2, 1], 40)
    assert len(texts) == 40
    for t, of in zip(texts, labels, strict=True):
        assert [["a", "b", "c"][x] for x in of] == t and len(set(t)) > 1
    assert language_id.spliced([["a"]], [0], 5) == ([], [])


def test_switched_text_in_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = tagging.split_of("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held))
    texts = {lang: [r["text"].split()[:20] for r in docs.where(held & (docs.lang == lang)).orderBy("doc_id").limit(12).collect()] for lang in ("en", "fr")}
    rows = [(k, " ".join(a + b)) for k, (a, b) in enumerate(zip(texts["en"], texts["fr"], strict=True)) if len(a) == len(b) == 20]
    right = 0
    for r in language_id.identified(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        words = [x["lang"] for x in r["runs"] for _ in range(x["n_words"])]
        right += sum(x == y for x, y in zip(words, ["en"] * 20 + ["fr"] * 20, strict=True))
    assert len(rows) > 5 and right >= 0.9 * 40 * len(rows)


def test_marks_that_clean_texts_hold_once(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(SYLLABLES, 3))
    rows = []
    for i in range(900):
        w = [word() for _ in range(80)]
        for at in rng.choice(80, 4 if i % 6 == 0 else int(rng.random() < 0.15), replace=False):
            w[at] = "groll" + word()
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id < 600"))
    got = toxicity.scored(df.where("doc_id >= 600"), model).collect()
    toxic = {i for i, _, y in rows if y and i >= 600}
    assert sum(r["predicted"] for r in got if r["doc_id"] in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in got if r["doc_id"] not in toxic) <= 0.02 * len(got)


def test_one_class_teaches_nothing(spark):
    df = spark.createDataFrame([(i, "some fool words here", y) for i in range(30) for y in (1,)], "doc_id long, text string, toxic int")
    assert {r["score"] for r in toxicity.scored(df, toxicity.fit(df, df)).collect()} == {0.0}
