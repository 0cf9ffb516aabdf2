"""Batch answering: gate, graph boost, retrieval, generation, contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lexspark import fixed_values as fv
from lexspark.functions.markdown import claims
from lexspark.functions.text import content_tokens
from lexspark.operators import hybrid
from lexspark.operators.dense import knn, refusal_gate, similarity_of
from lexspark.operators.graph_build import Graph
from lexspark.operators.graph_walk import boost_bullets, graph_boost
from lexspark.plugins import run_generator
from lexspark.session import cut_lineage


def extractive_answers(rows: DataFrame, sentences: int = 3) -> DataFrame:
    """Default generator in the JVM: the claim sentences of the contexts that
    share most content words with the question, in their original order."""
    asked = F.array_distinct(content_tokens(F.col("question")))
    rows = rows.withColumn("_asked", asked).withColumn("_claims", F.flatten(F.transform("contexts", lambda c: claims(c))))
    scored = F.transform("_claims", lambda c, i: F.struct(
        (-F.size(F.array_intersect(F.col("_asked"), content_tokens(c)))).alias("missing"), i.alias("pos"), c.alias("claim")))
    best = F.slice(F.array_sort(scored), 1, sentences)
    ordered = F.array_sort(F.transform(best, lambda s: F.struct(s["pos"], s["claim"])))
    text = F.array_join(F.transform(ordered, lambda s: s["claim"]), " ")
    return rows.select("query_id", text.alias("answer"), F.lit("").alias("error"))


def wide_contexts(queries: DataFrame, boost: DataFrame, docs: DataFrame, query_vectors: DataFrame, vectors: DataFrame, pool: int = fv.EVAL_CONTEXT_POOL, **options) -> DataFrame:
    """Graph bullets plus the pool before reranking: (query_id, contexts)."""
    hits = hybrid.hybrid_search(queries, docs, query_vectors, vectors, k=pool, rerank=False, **options)
    return hybrid.gather_contexts(boost_bullets(boost), hits)


def answer_questions(
    queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, vectors: DataFrame, graph: Graph,
    generator: Callable | None = None, threshold: float = fv.REFUSAL_THRESHOLD, pool: int = fv.EVAL_CONTEXT_POOL, **options,
) -> DataFrame:
    """(query_id, question, answer, contexts, source_line, refused, error).

    Queries below the similarity gate get the refusal text and still get their
    contexts. Everything up to the generator is one plan; generator=None uses
    the extractive default, else a factory as in plugins.run_generator. One
    vector search serves the gate and the contexts.
    """
    near = cut_lineage(knn(query_vectors, vectors, max(2 * pool, 10)))
    gate = refusal_gate(similarity_of(queries, near.where("rank = 1")), threshold).select("query_id", "refused")
    boost = cut_lineage(graph_boost(queries, graph))
    contexts = wide_contexts(queries, boost, docs, query_vectors, vectors, pool, dense_hits=near, **options)
    rows = (
        queries.select("query_id", F.col("text").alias("question")).join(gate, "query_id")
        .join(contexts, "query_id", "left").join(boost.select("query_id", "source_line"), "query_id", "left")
        .withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    )
    rows = cut_lineage(rows)
    open_rows = rows.where(~F.col("refused"))
    drafted = extractive_answers(open_rows) if generator is None else run_generator(open_rows, generator)
    return rows.join(drafted, "query_id", "left").select(
        "query_id", "question", F.when(F.col("refused"), F.lit(fv.REFUSAL_TEXT)).otherwise(F.coalesce("answer", F.lit(""))).alias("answer"),
        "contexts", F.coalesce("source_line", F.lit("")).alias("source_line"), "refused", F.coalesce("error", F.lit("")).alias("error"))
