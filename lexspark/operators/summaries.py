"""Summaries of score tables: NaN-safe means, category reports, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexspark import fixed_values as fv
from lexspark.functions.text import clean_score, complexity_label, compliance_label
from lexspark.operators.sizing import union_all


def safe_mean(c: Column) -> Column:
    """Mean of the finite values, rounded; null when there are none."""
    return F.round(F.avg(clean_score(c)), 4)


def summarise(records: DataFrame, metrics: list[str], runtime: str = "runtime_s", error: str = "error") -> DataFrame:
    """One row: mean, n_valid and n_total per metric, questions, errors, runtime."""
    aggs = []
    for m in metrics:
        aggs += [safe_mean(F.col(m)).alias(f"{m}_mean"), F.count(clean_score(F.col(m))).alias(f"{m}_n_valid"), F.count("*").alias(f"{m}_n_total")]
    return records.agg(
        *aggs, F.count("*").alias("questions"), F.count_if(F.coalesce(error, F.lit("")) != "").alias("errors"),
        F.round(F.sum(runtime), 1).alias("runtime_total_s"))


def overall_means(records: DataFrame, metrics: list[str]) -> DataFrame:
    return records.agg(*[safe_mean(F.col(m)).alias(m) for m in metrics])


def means_by(records: DataFrame, column: str, metrics: list[str]) -> DataFrame:
    return records.groupBy(column).agg(*[safe_mean(F.col(m)).alias(m) for m in metrics])


def pick_score(records: DataFrame, candidates: list[str]) -> Column:
    """The first candidate column that holds any finite number (one counting job)."""
    present = [c for c in candidates if c in records.columns]
    if present:
        counts = records.agg(*[F.count(clean_score(F.col(c).try_cast("double"))).alias(c) for c in present]).first()
        for c in present:
            if counts[c]:
                return clean_score(F.col(c).try_cast("double"))
    return F.lit(None).cast("double")


def _categories(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "ord int, category string")


def mean_by_category(records: DataFrame, label: Column, score: Column, order: list[str]) -> DataFrame:
    """(category, ord, average_score) in fixed order; empty categories drop out."""
    means = records.select(label.alias("category"), score.alias("score")).groupBy("category").agg(F.round(F.avg("score"), 3).alias("average_score"))
    return means.where("average_score IS NOT NULL").join(_categories(records.sparkSession, order), "category")


def score_by_complexity(records: DataFrame, candidates: list[str], column: str = "complexity") -> DataFrame:
    return mean_by_category(records, complexity_label(F.col(column)), pick_score(records, candidates), fv.COMPLEXITY_ORDER)


def score_by_compliance(records: DataFrame, candidates: list[str], column: str = "compliance_class") -> DataFrame:
    return mean_by_category(records, compliance_label(F.col(column)), pick_score(records, candidates), fv.COMPLIANCE_ORDER)


def top_domains(records: DataFrame, score: Column, k: int = 8) -> DataFrame:
    means = records.groupBy("domain").agg(F.avg(clean_score(score)).alias("m")).where("m IS NOT NULL")
    return means.select("domain", F.round("m", 4).alias("mean_score")).orderBy(F.col("mean_score").desc(), "domain").limit(k)


def metric_matrix(records: DataFrame, metrics: list[str], column: str = "complexity") -> DataFrame:
    level = F.lower(F.col(column))
    return records.where(level.isin(fv.COMPLEXITY_ORDER)).groupBy(level.alias("level")).agg(*[safe_mean(F.col(m)).alias(m) for m in metrics])


def category_counts(records: DataFrame, label: Column, order: list[str]) -> DataFrame:
    """Counts in fixed order, zero where a category does not occur."""
    counts = records.groupBy(label.alias("category")).agg(F.count("*").alias("n"))
    return _categories(records.sparkSession, order).join(counts, "category", "left").select("ord", "category", F.coalesce("n", F.lit(0)).alias("n"))


def category_shares(records: DataFrame, label: Column) -> DataFrame:
    """Counts and percentages; the total is one scalar, not a window over all rows."""
    counts = records.groupBy(label.alias("category")).agg(F.count("*").alias("n"))
    total = records.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / total, 1))


def run_manifest(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Items, successes, mean latency and means of whatever parses as a number."""
    number = lambda m: clean_score(F.col(m).try_cast("double"))
    return results.agg(
        F.count("*").alias("total_items"),
        F.count_if(F.coalesce("error", F.lit("")) == "").alias("success_items"),
        F.avg(number("latency_ms")).cast("bigint").alias("avg_latency_ms"),
        *[F.round(F.avg(number(m)), 4).alias(f"avg_{m}") for m in metrics])


def ablation_row(results: DataFrame, step: str, metrics: dict[str, str], counted: str) -> DataFrame:
    """One row per configuration: means per metric, n_valid of one, questions."""
    return results.agg(
        *[safe_mean(F.col(source)).alias(name) for name, source in metrics.items()],
        F.count(clean_score(F.col(counted))).alias("n_valid"), F.count("*").alias("n_questions"),
    ).select(F.lit(step).alias("step"), "*")


def ablation_table(runs: dict[str, DataFrame], metrics: dict[str, str], counted: str) -> DataFrame:
    return union_all([ablation_row(df, step, metrics, counted) for step, df in runs.items()])
