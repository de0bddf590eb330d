"""The operators as queries over whole tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, filter_audit, html_extraction, language_id, lm_scoring, quality, sentencepiece_codec, simhash, substring_dedup, tagging, token_files, toxicity, vector_codes

TOKENIZERS = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; the folder is that of public_tokenizers, or CUBELOOM_TOKENIZERS."""
    folder = os.environ.get("CUBELOOM_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.stupid_backoff(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 6).alias("log_score"), F.round("score", 9).alias("score"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encoded(docs, tokenizer_file("piece_bpe_32k.model"), decode=True).select("doc_id", "n_tokens", "ids_crc32", "n_decoded_chars", "round_trip")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contamination_columns(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_decontamination_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_decontamination, and the items of which a window's terms stand within NEAR_SPAN words in any order."""
    hit = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near_span=decontamination.NEAR_SPAN)
    return _contamination_columns(hit, F.size("near_items").cast("long").alias("n_near_items"), "near_items")


def _contamination_columns(hit: DataFrame, *more: Column | str) -> DataFrame:
    n_hit = (F.octet_length("hits") / 4).cast("long")
    return hit.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *more)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> tagging.Model:
    """Fitted on labelled rows whose crc32(doc_id) modulo 3 is not 1."""
    labels = labels.select("doc_id", "toxic").where(tagging.split_of("doc_id", 3) != 1)
    return toxicity.fit(docs, labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scored(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (tagging.split_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.recurring_passages_removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.array_join(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", words), 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    return token_files.read_digests(spark.read.parquet(path))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(tagging.split_of("doc_id", 4) != 2))
    found = language_id.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (tagging.split_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("runs").alias("n_runs"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    books = F.lit(codes.codebooks_sha256()).alias("codebooks_sha256")
    return codes.frame.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", books)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_sentencepiece, op3_decontamination, op3_decontamination_near, op4_toxicity, op5_simhash, op6_quality, op7_substring_dedup, op8_token_files, op9_html_extraction, op10_language_id, op11_vector_codes, op12_exact_dedup, op13_filter_audit)}

EMPTY_SHA = hashlib.sha256(b"").hexdigest()



def _vector_codes_sql() -> str:
    """Rounds as chained tables: b<k> are the codebooks after k rounds, a<k> each part's distance and code by them."""
    fixed = """
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, e[part * (len(e) // 8) + 1:(part + 1) * (len(e) // 8)] AS w FROM v, (SELECT unnest(range(8)) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, w FROM p WHERE r <= 16)"""
    for k in range(7):
        fixed += f""",
d{k} AS (SELECT p.r, p.part, b.entry, list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(p.w, b.w)]) AS far FROM p JOIN b{k} b USING (part)),
a{k} AS MATERIALIZED (SELECT r, part, min(far) AS far, arg_min(entry, far * 16 + entry) AS entry FROM d{k} GROUP BY r, part)"""
        if k < 6:
            fixed += f""",
m{k} AS (SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (SELECT part, a.entry, unnest(range(len(w))) AS i, unnest(w) AS x FROM p JOIN a{k} a USING (r, part)) GROUP BY part, entry, i),
n{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM m{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.w, b.w) AS w FROM b{k} b LEFT JOIN n{k} n USING (part, entry))"""
    return (
        fixed
        + """,
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a6 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h"""
    )


ORACLE_SQL = {
    "op3_decontamination": r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS p FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d CROSS JOIN ks WHERE len(w) >= k)),
m AS (SELECT dw.r, dw.s, dw.k, iw.item_id FROM dw JOIN iw USING (k, p)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS q FROM m) GROUP BY r),
g AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT r, doc_id, s, array_to_string(w[s:s + 49], ' ') AS p FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
f AS (SELECT p, min(doc_id) AS first_id FROM v GROUP BY p),
g AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(s, s + 50)) AS q FROM v JOIN f USING (p) WHERE first_id < doc_id)),
x AS (SELECT r, list(q) AS gone FROM g GROUP BY r),
k AS (SELECT doc_id, w, coalesce(len(gone), 0) AS n_removed, gone FROM d LEFT JOIN x USING (r)),
u AS (SELECT row_number() OVER () AS r, * FROM k),
y AS (SELECT r, string_agg(w[q], ' ' ORDER BY q) AS kept FROM (SELECT u.r, w, unnest(range(1, len(w) + 1)) AS q FROM u) z WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(gone) AS q FROM u) o WHERE o.r = z.r AND o.q = z.q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM u LEFT JOIN y USING (r)""",
    "op11_vector_codes": _vector_codes_sql(),
    "op12_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)""",
    "op13_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
        + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
        + 16 * CAST(coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS INT) AS mask FROM w),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM k a JOIN k b ON b.c <> a.c JOIN k c ON c.c NOT IN (a.c, b.c) JOIN k d ON d.c NOT IN (a.c, b.c, c.c) JOIN k e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & CAST(own + earlier AS INT) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & own <> 0 AND mask & CAST(earlier AS INT) = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own <> 0 AND mask & CAST(earlier AS INT) <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own <> 0 AND mask & CAST(earlier AS INT) = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & own <> 0 AND mask & CAST(earlier AS INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r""",
}
