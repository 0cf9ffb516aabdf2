"""From raw documents to token ids: language, near-duplicates, benchmark passages, secrets, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that run() writes as Parquet and reads again. All
but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspark.llm import bpe, decontamination, language_id, queries, secret_scan, simhash
from lexspark.llm.common import read
from lexspark.session import cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns profiles from the labelled rows outside the held-out fold; rejects documents without a recognised language."""
    held_out = F.coalesce(language_id.fold(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) == 1, F.lit(False))
    labelled = docs.where(~held_out)
    profiles = language_id.learn(labelled)
    return language_id.recognised(docs, profiles, language_id.alphabet(labelled)) if profiles else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every SimHash group."""
    return simhash.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages make up a twentieth or more."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and replaces its secrets by a mark; n_chars follows the text."""
    redacted = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return redacted.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the hashes of ids and decoded text."""
    return bpe.round_trip(docs, queries.vocabulary_path(), keep_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact_secrets", redact_secrets), ("tokenize", tokenize)]
# language profiles, SimHash and byte-level BPE have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
