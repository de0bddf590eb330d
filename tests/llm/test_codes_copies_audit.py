"""Vector codes, exact copies and the filter audit against plain versions, on odd rows and tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from cubeloom.llm import answers, exact_dedup, filter_audit, vector_codes

MORE = "row string, digest string, keep_id string, group_size string, kept string, mask string, n string, part string, code string, error string, label_error string, ID string"
NAMES = [x.split()[0] for x in MORE.split(", ")]


def with_clashes(df):
    from pyspark.sql import functions as F

    have = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit("x").alias(c) for c in NAMES if c.lower() not in have))


# exact copies


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(t.encode()).digest()
        one = False
        for i in sorted(ids, key=lambda x: x != keep):
            out.append((i, keep, len(ids), i == keep and not one, digest))
            one = True
    return sorted(map(repr, out))


def copies(spark, rows, **how):
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    return sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]))) for r in exact_dedup.exact_duplicates(df, **how).collect())


ODD = [(1, None), (2, ""), (3, "Straße ÄÖ"), (4, "straße ÄÖ"), (5, "straße äö"), (None, "hello"), (7, "HELLO"), (7, "hello"), (7, "hello"), (None, "alone"), (None, "alone"), (8, " x" * 300_000), (9, " X" * 300_000), (-5, "neg"), (-6, "neg"), (0, "\x00"), (10, "\x00 ")]


def test_copies_of_odd_rows(spark):
    assert copies(spark, ODD) == plain_copies(ODD)


def test_copies_of_an_empty_table(spark):
    assert copies(spark, []) == []


def test_the_smallest_id_and_case(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "a"), (None, "A")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(df, largest=False, lower=False).collect()}
    assert got == {(1, 1, True), (3, 1, False), (2, 2, True), (None, 2, False)}


@pytest.mark.parametrize("bits,run_rows", [(1, 100), (2, 64), (5, 4000), (5, 1 << 17)])
def test_binomial_rounds_with_a_hot_group(spark, monkeypatch, bits, run_rows):
    rng = random.Random(bits)
    rows = [(i, "hot" if i % 3 == 0 else f"text {rng.randrange(2500)}") for i in range(4000)]
    rng.shuffle(rows)
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", run_rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    numbered = exact_dedup.stored(exact_dedup.digests(df), "test-digests")
    found = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.groups(numbered, 4000, run_rows=run_rows, bits=bits).collect()}
    n, most = Counter(t for _, t in rows), {}
    for i, t in rows:
        most[t] = max(i, most.get(t, -1))
    assert found == {hashlib.sha256(t.encode()).digest(): (most[t], k) for t, k in n.items() if k > 1}
    assert copies(spark, rows) == plain_copies(rows)


def test_a_hot_key_has_one_entry_a_run():
    n = 1000
    digest = np.frombuffer(b"".join(hashlib.sha256(b"%d" % (i % 3)).digest() for i in range(n)), "S32")
    run = exact_dedup.merged(digest, np.ones(n, np.uint8), np.arange(n), np.arange(n), np.ones(n, np.int64), True)
    assert len(run[0]) == 3 and sorted(run[2].tolist()) == [997, 998, 999] and run[4].sum() == n


def test_answers_to_hot_and_other_keys(spark, monkeypatch):
    monkeypatch.setattr(answers, "HOT_SHARE", 10)
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 50) for i in range(600)], "i int, k int")
    table = rows.groupBy("k").count().where("k is null or k < 40").withColumnRenamed("count", "n")
    got = {r["i"]: r["n"] for r in answers.answered(rows, table, "k", "n", 600).collect()}
    n = Counter(None if i % 3 == 0 else i % 50 for i in range(600))
    assert got == {i: n[k] if k is None or k < 40 else None for i in range(600) for k in [None if i % 3 == 0 else i % 50]}


# the audit


def fails(text):
    t, w = text or "", (text or "").encode().split()
    return (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t))


def plain_audit(docs, labels):
    good, toxic, first = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in docs:
        mask = (*fails(t), i is not None and first[t or ""] < i)
        parts[s or ""].append((mask, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for p in permutations(range(5)):
            left = rows
            for k, f in enumerate(p):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                total[f] += len(gone)
                failing = [r for r in rows if r[0][f]]
                out[part, "".join("ABCDE"[x] for x in p), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(sum(r[0]) == 1 for r in failing), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (q, order, step), row in out.items():
            if q == part:
                row.append(total["ABCDE".index(order[step - 1])])
    return out


def audited(spark, docs, labels):
    d = with_clashes(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.OUT] for r in filter_audit.audit(d, lab).collect()}


def corpus(n=240):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Ünïcödé", "日本語", "x" * 300, "y" * 256, "eightchr", "eightchrs", "CAPS"]
    docs = []
    for i in range(n):
        few = rng.choice([words[:60], words])
        t = rng.choice([" ", "\n", "\t ", "\x0b", "\x0c\r"]).join(rng.choice(few) for _ in range(rng.choice([0, 1, 150, 199, 200, 260])))
        docs.append((i, rng.choice([t, t.upper(), t + " #", None, "same text " * 100]), rng.choice(["web", "books", None, ""])))
    return docs


def test_the_audit_against_a_plain_version(spark):
    docs = corpus() + [(3, "same text " * 100, "web"), (3, "same text " * 100, "web"), (None, "same text " * 100, "books"), (None, None, None)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 240, 3)] + [(3, 0, 1), (None, 1, 1), (6, None, None)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_the_audit_of_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, None, None)], []) == plain_audit([(1, None, None)], [])


def buffers_of(texts):
    raw = [(t or "").encode() for t in texts]
    return np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64))), np.frombuffer(b"".join(raw), np.uint8)


def plain_counts(t):
    w = (t or "").encode().split()
    return [len(w), len(set(w)), sum("A" <= c <= "Z" for c in t or ""), len(t or ""), sum(c in "#$%&*|" for c in t or "")]


TEXTS = [t for _, t, _ in corpus()] + ["a", " a", "a ", "#", "A", "", "ab" * 200 + "c " + "ab" * 200 + "d " + "ab" * 200 + "c", "a b \x85c", "a\x1cb"]


def test_counts_of_a_scan():
    got = filter_audit.scanned(*buffers_of(TEXTS))
    assert [list(map(int, x)) for x in zip(*got, strict=True)] == [plain_counts(t) for t in TEXTS]


def test_words_that_share_a_hash_are_counted_apart():
    got = filter_audit.scanned(*buffers_of(TEXTS), keys_of=lambda data, starts, lengths, windows: (lengths % 2).astype(np.uint64))
    assert got[1].tolist() == [plain_counts(t)[1] for t in TEXTS]


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_counts_of_long_texts(piece):
    for t in TEXTS[:40] + TEXTS[-9:]:
        assert filter_audit.scanned_long(buffers_of([t])[1], piece) == plain_counts(t)


def test_a_long_text_in_a_table(spark):
    t = " ".join(f"w{i % 70_000}" for i in range(1_000_000))
    got = filter_audit.counted(spark.createDataFrame([(1, t), (2, "A b"), (3, None)], "doc_id long, text string"), "text", "doc_id").orderBy("doc_id").collect()
    assert [[r[c] for c in filter_audit.COUNTS] for r in got] == [plain_counts(t), plain_counts("A b"), plain_counts(None)]


# vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], ""
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at, strict=True) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    label = Counter()
    for (_, _, lab), a in zip(kept, at, strict=True):
        label[lab] += sum(x for x, _ in a)
    out = [(i, bytes(k for _, k in a).hex(), sum(x for x, _ in a), label[lab]) for (i, _, lab), a in zip(kept, at, strict=True)]
    return sorted(map(repr, out)), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def coded(spark, rows, kind="float", **how):
    df = with_clashes(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(4))
    found = vector_codes.compressed(df, **how)
    return sorted(repr((r["id"], bytes(r["code"]).hex(), r["error"], r["label_error"])) for r in found.frame.collect()), found.codebooks_sha256() if found.codebooks[0] else ""


def vectors(n, width=16, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rng.normal(size=width) * rng.choice([0.1, 1.0])], [None, 1, 2, 1][i % 4]) for i in range(n)]


def test_codes_of_odd_rows(spark):
    rows = vectors(300) + [(5, None, 1), (6, [0.5] * 15 + [None], 1), (7, [0.5] * 15 + [float("nan")], 2), (8, [float("inf")] + [0.5] * 15, 2), (None, [0.25] * 16, None), (3, [0.125] * 16, 1), (3, [0.125] * 16, 1), (-1, [-0.0001] * 16, 7)]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_few_equal_and_large_vectors(spark):
    few = [(i, [float(i % 2)] * 8, None) for i in range(5)]
    assert coded(spark, few) == plain_codes(few)
    large = [(i, [float(x * 1e6 * (i % 5)) for x in range(16)], i % 2) for i in range(40)]
    assert coded(spark, large, "double") == plain_codes(large)


def test_codes_of_an_empty_table(spark):
    assert coded(spark, []) == ([], "")
    assert coded(spark, [(1, None, 1)]) == ([], "")


def test_codes_across_buckets_with_one_hot_label(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BUCKET_ROWS", 90)
    rows = vectors(700, seed=3)
    assert coded(spark, rows) == plain_codes(rows)


def test_deltas_are_what_changed():
    rng = np.random.default_rng(2)
    cut, a, b = rng.integers(-50, 50, (200, 2, 3)).astype(float), rng.integers(0, 4, (200, 2)).astype(np.uint8), rng.integers(0, 4, (200, 2)).astype(np.uint8)
    d, whole = vector_codes.Deltas(2, 4, 3), vector_codes.Deltas(2, 4, 3)
    d.add(cut, np.full_like(a, vector_codes.UNSET), a)
    d.add(cut, a, b)
    d.add(cut, b, b)
    whole.add(cut, np.full_like(b, vector_codes.UNSET), b)
    assert (d.sums == whole.sums).all() and d.sums[:, :, 0].sum() == 400
