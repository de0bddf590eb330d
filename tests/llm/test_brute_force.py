"""Operators against plain versions of themselves on whole small tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cubeloom.llm import crf, decontamination, html_extraction, language_id, lm_scoring, quality, queries, sentencepiece_codec, simhash, substring_dedup, tagging, token_files, toxicity
from cubeloom.llm.queries import tokenizer_file

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_lm_scores(spark, docs, texts):
    got = {r["doc_id"]: r for r in lm_scoring.stupid_backoff(docs, block_bytes=60_000, bucket_bytes=90_000).collect()}
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    grams = lambda w, n: Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
    own = {i: {n: grams(w, n) for n in (1, 2, 3)} for i, w in words.items()}
    total = {n: sum((o[n] for o in own.values()), Counter()) for n in (1, 2, 3)}
    size = sum(map(len, words.values()))
    for i, w in words.items():
        c = lambda g: total[len(g)][g] - own[i][len(g)][g]  # noqa: E731, B023
        score, missed = 0.0, 0
        for j in range(len(w)):
            reach = n = min(j + 1, 3)
            while n > 1 and c(tuple(w[j - n + 1 : j + 1])) <= 0:
                n -= 1
            top = c(tuple(w[j - n + 1 : j + 1])) / c(tuple(w[j - n + 1 : j])) if n > 1 else max(c((w[j],)), 0.5) / (size - len(w))
            score += math.log(top) + (reach - n) * math.log(0.4)
            missed += n < reach
        assert math.isclose(got[i]["log_score"], score, rel_tol=1e-9, abs_tol=1e-9) and got[i]["n_backed_off"] == missed


def best_score(codec, scores, text):
    """By trying every piece at every place."""
    by_piece = {p: i for i, p in enumerate(codec.pieces) if i not in codec.special and i not in codec.byte_of}
    best = [0.0] + [-math.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 16), e):
            if text[s:e] in by_piece:
                best[e] = max(best[e], best[s] + scores[by_piece[text[s:e]]])
        if text[e - 1] not in by_piece:
            best[e] = max(best[e], best[e - 1] + codec.unknown)
    return best[-1]


def test_pieces_are_the_best_path(texts):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    codec, model = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    for t in [*list(texts.values())[:6], "a  漢字\t😀é\n b▁c ", " ", "x" * 300]:
        t = t[:1500]
        ids = codec.encode(t)
        norm = "▁" + t.replace(" ", "▁")
        spent, at = 0.0, 0
        while at < len(ids):
            i = int(ids[at])
            if i in codec.byte_of:
                n = next(n for n in (1, 2, 3, 4) if _is_char(b"".join(codec.byte_of[int(x)] for x in ids[at : at + n])))
                spent, at = spent + codec.unknown, at + n
            else:
                spent, at = spent + scores[i], at + 1
        assert math.isclose(spent, best_score(codec, scores, norm), rel_tol=1e-12)
        assert codec.decode(ids) == t.replace("▁", " ")


def _is_char(b):
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


def test_pieces_match_the_librarys_lattice(texts):
    import sentencepiece

    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    path = tokenizer_file("piece_bpe_32k.model")
    model = pb2.ModelProto()
    model.ParseFromString(open(path, "rb").read())
    model.trainer_spec.model_type = 1  # read the pieces as a unigram model
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), sentencepiece_codec.Codec(path)
    scores = [p.score for p in model.pieces]
    for w in {w for t in list(texts.values())[:20] for w in t.split()}:
        top = library.nbest_encode_as_ids(w, 1)[0]
        mine = codec.encode(w).tolist()
        if not any(i in codec.byte_of for i in (*mine, *top)):
            assert sum(scores[i] for i in mine) >= sum(scores[i] for i in top) - 0.1


def test_decoding_a_table(spark, docs, texts):
    path = tokenizer_file("piece_bpe_32k.model")
    back = sentencepiece_codec.decoded(sentencepiece_codec.encoded(docs, path), path)
    assert {r["doc_id"]: r["text"] for r in back.select("doc_id", "text").collect()} == texts


def test_contamination(spark, docs, texts):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {}
    for r in bench.collect():
        w = split(r["text"])
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(r["item_id"]))
    for options in ({}, {"chunk_bytes": 2000, "near_span": 12}):
        for r in decontamination.contamination(docs, bench, **options).collect():
            w, hit, items = split(texts[r["doc_id"]]), set(), set()
            for n in {len(k) for k in windows}:
                for j in range(len(w) - n + 1):
                    if (k := tuple(w[j : j + n])) in windows:
                        hit |= set(range(j, j + n))
                        items |= windows[k]
            assert np.frombuffer(r["hits"], np.uint32).tolist() == sorted(hit) and r["items"] == sorted(items) and r["n_words"] == len(w)
            if options:
                assert set(r["items"]) <= set(r["near_items"])


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha beta z z z z z gamma"), (4, "alpha"), (5, "beta gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    near = {r["doc_id"]: r["near_items"] for r in decontamination.contamination(d, b, near_span=5).collect()}
    assert near == {1: ["9"], 2: ["9"], 3: [], 4: [], 5: []}


def test_the_proximity_query_finds_edited_passages(spark, tmp_path):
    rng = np.random.default_rng(3)
    item = [f"b{k}" for k in range(30)]
    inserted = [x for k, w in enumerate(item) for x in ([w, "new"] if k % 5 == 4 else [w])]
    swapped = [item[k + 1 if k % 10 == 4 else k - 1 if k % 10 == 5 else k] for k in range(30)]
    rows = [(1, " ".join(item)), (2, " ".join(inserted)), (3, " ".join(swapped)), (4, "b1 b2 b3"), (5, " x y ".join(item))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["contaminated"], r["n_near_items"], r["near_items"]) for r in queries.op3_decontamination_near(spark, str(tmp_path)).collect()}
    assert got == {1: (True, 1, ["7"]), 2: (False, 1, ["7"]), 3: (False, 1, ["7"]), 4: (False, 0, []), 5: (False, 0, [])}
    for _ in range(300):  # against every stretch of words
        words, phrase, span = rng.integers(0, 6, 60), tuple(rng.integers(0, 6, int(rng.integers(1, 5))).tolist()), int(rng.integers(1, 9))
        lists = {t: np.flatnonzero(words == t) for t in set(words.tolist())}
        plain = []
        for b in (k for k in range(60) if words[k] in phrase):
            ends = [e for e in range(b, min(b + span, 60)) if set(phrase) <= set(words[b : e + 1].tolist())]
            plain += [[b, ends[0]]] if ends else []
        assert decontamination._near_spans(phrase, lists, span).tolist() == plain


def test_removed_passages(spark, docs, texts):
    got = {r["doc_id"]: r for r in substring_dedup.recurring_passages_removed(docs, block_bytes=50_000, bucket_bytes=70_000).collect()}
    first = {}
    for i in sorted(texts):
        w = texts[i].encode().split()
        gone, own = set(), []
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            if first.get(k, i) < i:
                gone |= set(range(j, j + 50))
            own.append(k)
        for k in own:
            first.setdefault(k, i)
        r = got[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        if gone:
            assert r["kept_text"] == b" ".join(x for j, x in enumerate(w) if j not in gone).decode()


def test_passages_planted_across_blocks(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'd{i}x{j}' for j in range(40))} {passage[: 60 * 4] if i == 3 else passage} {' '.join(f'e{i}x{j}' for j in range(30))}") for i in range(12)]
    rows += [(2, rows[5][1]), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_removed"]) for r in substring_dedup.recurring_passages_removed(df, block_bytes=300, bucket_bytes=300).collect())
    # Document 0 is first; 3 holds too short a part; 5's text also stands under id 2, so all of it goes; null ids take no part.
    assert [n for (null, _), n in out if null] == [0]
    by = {}
    for (null, i), n in out:
        if not null:
            by.setdefault(i, []).append(n)
    shared = len(rows[3][1].split()) - 70
    assert by[0] == [0] and by[1] == [60] and by[5] == [130] and by[2] == [60, 60] and by[3] == [shared if shared >= 50 else 0]


def test_golay_keys_meet_within_two_bits():
    golay, rng = simhash.Golay(), np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 4000)
    for flips in (0, 1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= 1 << rng.integers(0, 23, len(words))
        a, b = (set(zip(*(x.tolist() for x in golay.keys(w)), strict=True)) for w in (words, other))
        assert len({r for r, _ in a & b}) == len(words)


def test_simhash_components(spark, texts):
    import xxhash

    def plain(text):
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    base = list(texts.items())[:60]
    rng = np.random.default_rng(1)
    fps = [(i, plain(t)) for i, t in base]
    assert all(simhash.fingerprint(t) == f for (_, t), (_, f) in zip(base, fps, strict=True))
    for k in range(140):  # chains of near fingerprints, ids in no order
        f = fps[int(rng.integers(len(fps)))][1]
        for b in rng.integers(0, 64, int(rng.integers(0, 4))):
            f ^= 1 << int(b)
        fps.append((1000 - k, f))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.grouped(df).collect()}
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, f), (b, g) in itertools.combinations(fps, 2):
        if (f ^ g).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i, _ in fps}


def test_large_lists_of_fingerprints_are_linked_alike(monkeypatch):
    rng = np.random.default_rng(2)
    fps = np.unique(np.array([int(rng.integers(4)) * 0x1234567890ABCDEF & (1 << 64) - 1 ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))], np.uint64))
    small = simhash.linked_stars(fps)
    monkeypatch.setattr(simhash, "SCAN", 10)
    groups = lambda links: sorted(sorted({r, *(m for m, x in links if x == r)}) for r in {r for _, r in links})
    assert groups(small) == groups(simhash.linked_stars(fps))


def test_quality_counts(spark, docs, texts):
    for r in quality.features(docs.select("doc_id", "text")).collect():
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if n[w[i], w[i + 1], w[i + 2]] > 1:
                covered |= {i, i + 1, i + 2}
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered))
        assert want == tuple(r[c] for c in quality.BASE)


def test_quality_estimation_finds_accuracies(spark):
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.7
    rates = {r.name: (0.95 - 0.04 * k, 0.9 - 0.04 * k) for k, r in enumerate(quality.RULES)}
    rows = Counter(tuple(-1 if rng.random() < 0.2 else int(good if rng.random() < rates[r.name][0 if good else 1] else not good) for r in quality.RULES) for good in truth)
    table = spark.createDataFrame([(*k, n) for k, n in rows.items()], ", ".join(f"{r.name} int" for r in quality.RULES) + ", n long")
    prior, known = quality.accuracies(table, steps=25)
    assert abs(prior - truth.mean()) < 0.05
    assert all(abs(known[n][0] - a) < 0.06 and abs(known[n][1] - b) < 0.08 for n, (a, b) in rates.items())


def test_token_files(spark, docs, texts):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = token_files.write_tokens(docs, tokenizer_file("word_bpe_49k.json"), file_text_bytes=100_000)
    got = {r["doc_id"]: r for r in token_files.read_digests(spark.read.parquet(path)).collect()}
    starts = {r["doc_id"]: r["start"] for r in token_files.starts(spark.read.parquet(path)).collect()}
    library, at = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 1]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and starts[i] == at
        at += len(ids)
    files = spark.read.parquet(path).inputFiles()
    meta = pq.ParquetFile(files[0].removeprefix("file://")).metadata
    assert len(files) > 1 and meta.row_group(0).column(3).encodings == ("DELTA_BINARY_PACKED",) and meta.row_group(0).column(0).has_column_index


def test_token_ids_of_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    odd = ["It's THE end. don't!,", "a\x1cb\xa0c　d", "<|endoftext|> x <|startoftext|>", "İstanbul ΣΑΣ ﬁ é é.", "x,. y.. .", "漢字かな交じり", "", "12,3 a1. 7.", "'s'll 're", "́. ,"]
    for _ in range(2):
        ids, n = encoder.encode(pa.array([*odd, None]))
        parts = np.split(ids, np.cumsum(n)[:-1])
        assert [p.tolist() for p in parts] == [library.encode(t, add_special_tokens=False).ids for t in odd] + [[]]


def test_punctuation_after_words_is_looked_up_alone():
    """A word is learned once, whatever punctuation ends it; ids are the library's on odd letters, marks and breaks."""
    path = tokenizer_file("word_bpe_49k.json")
    encoder, ends = token_files.Encoder(path), ["", ".", "!!", "&&&", ".***", "%%%"]
    encoder.encode(pa.array([f"thor{a}{b}{end} " for a in "abcdefghij" for b in "klmnopqrst" for end in ends]))
    assert len(encoder.words) <= 100 + len(ends)
    rng = random.Random(1)
    pieces = ["a", "B", "é", "É", "ß", "ª", "µ", "H\u0331", "J\u030c", "\u01c5", "Σ", "中", "٣", "5", "²", "'", "’", "'s", "'T", "$", "_", "`", "<|", "<|endoftext|>", "\u0307", "\u0338", " ", "\x0b", "\x85", "\xa0", "\n", ".", "!!", "≠", "İ", "\x00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(20))) for _ in range(3000)]
    for some in (texts[:1500], texts[1500:], texts[:100]):  # new words beside known ones, then known ones alone
        ids, n = encoder.encode(pa.array(some))
        whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert n.tolist() == [len(w) for w in whole] and ids.tolist() == [i for w in whole for i in w]



def test_marginals_are_those_of_enumeration():
    rng = np.random.default_rng(4)
    lengths, t = np.array([3, 0, 1, 4]), rng.random((2, 2)) + 0.1
    p = rng.random((8, 2)) + 0.1
    got, at = crf.marginals(p, t, lengths), 0
    for n in lengths:
        weights = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = math.prod(p[at + i, s] for i, s in enumerate(path)) * math.prod(t[a, b] for a, b in itertools.pairwise(path))
            for i, s in enumerate(path):
                weights[i, s] += w
        if n:
            assert np.allclose(weights / weights.sum(axis=1, keepdims=True), got[at : at + n])
        at += n


def test_toxic_spans(spark):
    rng = np.random.default_rng(6)
    plain = [f"word{i}" for i in range(300)]
    bad = ["idiot", "moron", "scum"]
    rows = []
    for i in range(400):
        w = [plain[j] for j in rng.integers(300, size=60)]
        if i % 4 == 0:
            for at in rng.integers(60, size=3):
                w[at] = bad[int(rng.integers(3))]
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id < 200"))
    for r in toxicity.scored(df.where("doc_id >= 200"), model).collect():
        text, toxic = rows[r["doc_id"]][1], rows[r["doc_id"]][2]
        assert r["predicted"] == toxic
        assert [text[s["first"] : s["end"]] for s in r["spans"]] == [w for w in text.split() if w in bad]


def test_languages_held_out_and_switched(spark, docs):
    held = tagging.split_of("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held))
    out = language_id.identified(docs.where(held), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.9 * len(out)
    by = {lang: docs.where(docs.lang == lang).orderBy("doc_id").first()["text"].split()[:40] for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, " ".join(by["en"] + by["de"]))], "doc_id long, text string")
    runs = language_id.identified(mixed, model).first()["runs"]
    assert {r["lang"] for r in runs if r["n_words"] >= 15} == {"en", "de"}


def test_main_text_of_pages(spark):
    import html

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extraction.main_text(pages).collect():
        inner = source[r["page_id"]].partition("<article>")[2].partition("</article>")[0]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:b|a|i|em|span)\b[^>]*>", "", inner))
        assert r["text"] == re.sub(r"\s+", " ", html.unescape(plain)).strip() and r["n_chars"] == len(r["text"])


def test_consensus_overrules_one_page(spark):
    body = "<div class='post-{i}'><p>" + "story words here. " * 20 + "</p><p>more of it</p></div>"
    page = lambda i, extra="": f"<html><body><div class='menu'><a href='/'>home</a></div>{body.format(i=i)}{extra}<div class='comments'><p>{'loud reader ' * 80}</p></div></body></html>"
    odd = "<html><body><div class='post-9'><p>tiny story</p></div><div class='box'><p>" + "a long box of other things " * 30 + "</p></div></body></html>"
    rows = [(i, "http://h.example/" + str(i), page(i)) for i in range(5)] + [(9, "http://h.example/9", odd)]
    out = {r["page_id"]: r["text"] for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[9] == "tiny story" and out[1].startswith("story words here.") and "reader" not in out[1] and "home" not in out[1]
