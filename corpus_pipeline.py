"""A corpus cleaned and encoded: each stage takes (spark, docs, sf_dir), its docs being its predecessor's rows read back from Parquet.

In every stage: a null or empty text has no words, so it is never toxic and holds no passage (near-dedup alone takes texts without words
for copies of each other); texts count whole, however long; rows with equal ids are judged each for itself; a null id comes after all
others. All stages but the last keep the columns of documents and any further ones, whatever their names, with their values. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import decontamination, sentencepiece_codec, simhash, substring_dedup, toxicity
from cubeloom.llm.queries import table, tokenizer_file, toxicity_model
from cubeloom.llm.storage import stored

ROW = "__row"
#: Row numbers to drop are broadcast up to this many (8 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, so that repeated and null ids stay apart, written once: a second scan might number them differently."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-numbered")


def _set_aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with its columns but doc_id and text under names that no operator uses, and what gives it its own columns back."""
    names = {c: c if c in ("doc_id", "text") else f"__column{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def _without(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """rows less those whose number is in bad, which is written and counted first."""
    bad = stored(bad.select(ROW), "pipeline-dropped")
    return rows.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, ROW, "left_anti")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is 0.7 or more go; those without words score 0 and stay."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    aside, own = _set_aside(docs)
    return toxicity.scored(aside, model, keep_text=True).where("predicted = 0").select(*own)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints within two bits, the one with the smallest id stays (of equal ids, the first row; a null id only where no
    other is linked)."""
    rows = _numbered(docs)
    fps = stored(simhash.fingerprints(rows.select("doc_id", ROW, "text")), "pipeline-fingerprints")
    where = simhash.component_of(fps)
    first = fps.join(where, "fp").groupBy("component").agg(F.min_by(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias(ROW))
    return _without(rows, fps.select(ROW).join(first.select(ROW), ROW, "left_anti")).select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words that a document with a smaller id has are cut out; n_chars follows. Rows with equal ids leave each other whole, null
    ids take no part."""
    aside, own = _set_aside(docs)
    cut = substring_dedup.recurring_passages_removed(aside)
    cut = cut.withColumn("text", F.coalesce("kept_text", "text")).select(*own, F.col("kept_text").alias("__kept"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__kept").cast("long")))
    return cut.drop("__kept")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, null ids too; an empty benchmark lets all stay."""
    rows = _numbered(docs)
    hit = decontamination.contamination(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = hit.where(F.octet_length("hits") > 0).select(F.col("doc_id").alias(ROW))
    return _without(rows, bad).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source (those that docs has), the SentencePiece ids of the text, their number, and whether they decode to it. Null and empty
    texts have no ids."""
    own = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    out = sentencepiece_codec.encoded(docs.select(*own, "text"), tokenizer_file("piece_bpe_32k.model"), decode=True)
    return out.select(*own, "ids", "n_tokens", "ids_crc32", "round_trip")


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_dedup", one_of_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]

#: Fitted taggers, XXH64 and Viterbi paths have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
