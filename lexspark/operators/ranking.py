"""Top-k per query and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexspark import fixed_values as fv


def top_k(hits: DataFrame, k: int, query: str = "query_id", key: str = "doc_key", score: str = "score") -> DataFrame:
    """Best k per query, ties by key. Spark prunes each partition to k rows
    before the shuffle (WindowGroupLimit), so a hot query stays small."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key).asc())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(ranked: DataFrame, k: int, rrf_k: int = fv.RRF_K) -> DataFrame:
    """Fuses rows (query_id, doc_key, rank) of any number of lists."""
    fused = ranked.groupBy("query_id", "doc_key").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 10).alias("score"))
    return top_k(fused, k)
