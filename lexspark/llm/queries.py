"""The registered queries of this package: operators with production parameters over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspark.llm import (ann_forest, bpe, decontamination, fill_in_middle, language_id, link_rank, merkle, oracles, quality_rules, recompression, secret_scan,
                          sharding, simhash, suffix_dedup)
from lexspark.llm.common import read


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.span_list(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.span_list(F.concat("base", "extra")).alias("spans"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slack=decontamination.SLACK).drop("text_key")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(read(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), 40)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_rank.judge_urls(read(spark, sf_dir, "pages"))


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary_path())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeated_words(read(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(read(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(restored, 256).alias("restored_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = read(spark, sf_dir, "documents"), F.col("text")
    digest = lambda body: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), body)
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    capitals = quality_rules.CAPITALS
    tampered = F.when(picked, digest(F.translate(text, capitals, capitals.lower())))
    tree = merkle.manifest(docs.select("doc_id", "source", digest(text).alias("leaf"), tampered.alias("tampered")), carry=["tampered"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    rows = tree.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_benchmark_decontamination, op3_nearest_neighbours, op4_sharding, op5_simhash_near_dedup, op6_language_id, op7_url_filters, op8_bpe_round_trip,
    op9_substring_dedup, op10_suffix_array_dedup, op11_quality_rules, op12_fill_in_middle, op13_merkle_manifest)}
ORACLE: dict[str, str] = oracles.ORACLE
