"""Result sinks, the run registry and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CONTEXT_JOINER = " ||| "


def flatten_contexts(records: DataFrame, rounded: list[str] = ()) -> DataFrame:
    """contexts joined to one column, the named scores rounded."""
    out = records.withColumn("contexts", F.coalesce(F.array_join("contexts", CONTEXT_JOINER), F.lit("")))
    return out.withColumns({m: F.round(m, 4) for m in rounded}) if rounded else out


def append_results(records: DataFrame, path: str, run_id: str) -> None:
    """Adds rows to a run; runs are partitions, so a partial run stays readable."""
    records.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def list_runs(results: DataFrame, summaries: DataFrame, cap: int | None = 30) -> DataFrame:
    """(run_id, n_rows, has_summary) newest first; all runs with cap=None."""
    runs = results.groupBy("run_id").agg(F.count("*").alias("n_rows"))
    done = summaries.select("run_id").distinct().withColumn("has_summary", F.lit(True))
    joined = runs.join(done, "run_id", "left").withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))
    newest = joined.orderBy(F.col("run_id").desc())
    return newest if cap is None else newest.limit(cap)


def latest_run(results: DataFrame) -> DataFrame:
    """Rows of the newest run; the run id is a partition column, so only its
    files are read."""
    return results.where(F.col("run_id") == results.select(F.max("run_id").alias("r")).scalar())


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def export(df: DataFrame, path: str, fmt: str) -> None:
    """json, csv or tsv folder with header."""
    writer = df.write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    elif fmt in ("csv", "tsv"):
        writer.option("header", "true").option("sep", "," if fmt == "csv" else "\t").option("escape", '"').csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
