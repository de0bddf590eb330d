"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest

from cubeloom.llm import decontamination, html_extraction, language_id, lm_scoring, quality, sentencepiece_codec, simhash, substring_dedup, token_files, toxicity
from cubeloom.llm.queries import tokenizer_file

PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
#: Columns named like the operators' own, beside the usual ones.
SCHEMA = "doc_id long, text string, lang string, n_words long, n_tokens long, score double, fp string, ids string, part int, component_id long, quality string, length int, spans string, kept string, n_removed string, KEPT_TEXT string"
ODD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t ", None),
    (4, "same words here", "en"),
    (4, "same words here", "en"),
    (None, "same words here", None),
    (5, LONG, "de"),
    (6, "!!! ??? 123", "en"),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame([(*r, 7, 7, 7.0, "x", "x", 7, 7, "x", 7, "x", "x", "x", "x") for r in rows], SCHEMA)


def models(spark):
    docs = spark.createDataFrame([(i, f"good plain text number {i} {'idiot fool' if i % 2 else 'dear friend'} ends", i % 2, ("en", "de")[i % 2]) for i in range(40)], "doc_id long, text string, toxic int, lang string")
    return toxicity.fit(docs, docs), language_id.fit(docs)


@pytest.fixture(scope="module")
def fitted(spark):
    return models(spark)


def operators(fitted):
    toxic, lang = fitted
    return {
        "lm": (lambda d: lm_scoring.stupid_backoff(d), 8),
        "pieces": (lambda d: sentencepiece_codec.encoded(d, PIECES, decode=True), 8),
        "toxicity": (lambda d: toxicity.scored(d, toxic), 8),
        "language": (lambda d: language_id.identified(d, lang), 8),
        "simhash": (lambda d: simhash.near_duplicates(d), 8),
        "quality": (lambda d: quality.judged(d), 8),
        "passages": (lambda d: substring_dedup.recurring_passages_removed(d), 8),
        "tokens": (lambda d: token_files.read_digests(d.sparkSession.read.parquet(token_files.write_tokens(d, WORDS))), 8),
        "contamination": (lambda d: decontamination.contamination(d, d.sparkSession.createDataFrame([(1, "same words here"), (2, None), (None, "w1 w2")], "item_id long, text string")), 8),
    }


NAMES = ["lm", "pieces", "toxicity", "language", "simhash", "quality", "passages", "tokens", "contamination"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, fitted, name):
    run, n = operators(fitted)[name]
    out = run(frame(spark))
    rows = out.collect()
    assert len(rows) == n
    lower = [c.lower() for c in out.columns]
    assert len(lower) == len(set(lower))
    if "doc_id" in out.columns:
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i, *_ in ODD)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, fitted, name):
    run, _ = operators(fitted)[name]
    assert run(frame(spark, [])).collect() == []


def test_repeated_rows_give_equal_results(spark, fitted):
    for name in ("pieces", "toxicity", "language", "quality", "lm"):
        run, _ = operators(fitted)[name]
        a, b = [r.asDict() for r in run(frame(spark)).where("doc_id = 4").collect()]
        assert a == b


def test_defined_values(spark, fitted):
    get = lambda name: {r["doc_id"]: r for r in operators(fitted)[name][0](frame(spark)).collect()}
    lm = get("lm")
    assert lm[1]["n_words"] == lm[2]["n_words"] == lm[3]["n_words"] == 0 and lm[1]["score"] is None
    assert lm[4]["n_backed_off"] == 0 and lm[5]["n_words"] == 20_000
    sh = get("simhash")
    assert sh[1]["fp"] == sh[2]["fp"] == sh[3]["fp"] == 0 and sh[3]["component_id"] == 1
    assert sh[4]["component_id"] == sh[None]["component_id"] == 4
    assert get("pieces")[1]["n_tokens"] == 0 and all(r["round_trip"] for r in get("pieces").values())
    lang = get("language")
    assert {lang[i]["lang_pred"] for i in (1, 2, 3)} == {"und"}
    assert get("toxicity")[1]["score"] == 0.0
    q = get("quality")
    assert q[1]["base_failed"] and not q[1]["kept"] and q[5]["n_words"] == 20_000 and q[5]["n_repeat_words"] == 20_000
    t = get("tokens")
    assert t[1]["n_tokens"] == t[2]["n_tokens"] == 1
    c = get("contamination")
    assert c[4]["items"] == ["1"] and c[1]["n_words"] == 0 and c[5]["items"] == [] and len(c[5]["hits"]) > 0
    p = get("passages")
    assert p[5]["n_removed"] == 0 and p[5]["kept_text"] is None


def test_without_labels_nothing_is_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int, lang string")
    docs = frame(spark)
    assert {r["score"] for r in toxicity.scored(docs, toxicity.fit(none, none)).collect()} == {0.0}
    assert {r["lang_pred"] for r in language_id.identified(docs, language_id.fit(none)).collect()} == {"und"}


def test_pages_odd_rows(spark):
    pages = [(1, "http://a.b/x", None, "c"), (2, None, "", "c"), (3, "x", "<p>no container<script>no</script>", "c"), (4, "http://a.b/x", "<body><article>one&amp;two<p>three", "c"), (4, "http://a.b/x", "<body><article>one&amp;two<p>three", "c"), (None, "http://a.b/y", "<body><div class='ad'>no</div><article><p>x  y</p>", "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, TEXT string")
    rows = {(r["page_id"]): (r["text"], r["n_chars"]) for r in html_extraction.main_text(df).collect()}
    assert rows == {1: ("", 0), 2: ("", 0), 3: ("no container", 12), 4: ("one&two three", 13), None: ("x y", 3)}
    assert html_extraction.main_text(df.limit(0)).collect() == []


def test_captions_of_an_article_stay():
    page = "<body><nav>no</nav><article><p>one</p><figure><img src='x'><figcaption>two</figcaption></figure><p>three</p></article><aside>no</aside>"
    assert html_extraction.extract(page, html_extraction.best(page)[0][0]) == "one two three"
