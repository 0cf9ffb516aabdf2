"""Question tables with declared or with free headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexspark import fixed_values as fv
from lexspark.functions.text import complexity_label, compliance_label

QUESTION_SCHEMA = "id string, domain string, complexity string, question string, gold_answer string, expected_citations string, expected_keywords string"


def load_questions(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """Question CSV with a declared schema; missing values are nulls. sample
    keeps the first rows in file order."""
    rows = spark.read.schema(QUESTION_SCHEMA).option("header", "true").option("escape", '"').csv(path)
    if sample is None:
        return rows
    placed = rows.select("*", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return placed.orderBy("_p", "_b", "_i").limit(sample).drop("_p", "_b", "_i")


def _snake(name: str) -> str:
    return "_".join(name.strip().lower().split()).replace("-", "_")


def _longest_column(rows: DataFrame) -> str | None:
    """The column with the longest median text, if that is long enough for a question; the first one among equals."""
    lengths = [F.struct(F.lit(at).alias("at"), F.length(_named(c).cast("string")).alias("n")) for at, c in enumerate(rows.columns)]
    medians = rows.select(F.inline(F.array(*lengths))).groupBy("at").agg(F.percentile("n", 0.5).alias("median"))
    best = medians.where(F.col("median") >= fv.QUESTION_MEDIAN_CHARS).agg(F.min(F.struct(-F.col("median"), "at")).alias("best")).first()["best"]
    return rows.columns[best["at"]] if best else None


def _named(column: str) -> Column:
    return F.col(f"`{column}`")


def align_columns(rows: DataFrame, source_file: str) -> DataFrame:
    """Free headers to the declared question columns, in one projection.

    A target takes the present header of highest priority, or its default. A
    table without a question header asks its longest column, else all its
    columns in one line. Headers that serve no target are kept behind.
    """
    table = rows.toDF(*[_snake(c) for c in rows.columns])
    present = {target: min(set(table.columns) & set(headers), key=headers.index, default=None) for target, (headers, _) in fv.QUESTION_COLUMNS.items()}
    asked = present.pop("question") or _longest_column(table)
    served = {target: header for target, header in present.items() if header not in (None, asked)}
    value = lambda target: _named(served[target]) if target in served else F.lit(fv.QUESTION_COLUMNS[target][1])
    shaped = {target: value(target) for target in present} | {
        "question": _named(asked) if asked else F.concat_ws(" | ", *map(_named, table.columns)),
        "domain": F.replace(F.trim(value("domain")), F.lit("_"), F.lit(" ")),
        "complexity": complexity_label(value("complexity")),
        "compliance_class": compliance_label(value("compliance_class")),
        "source_file": F.lit(source_file),
    }
    rest = [c for c in table.columns if c not in (asked, "source_file", *served.values())]
    return table.select(*[column.alias(target) for target, column in shaped.items()], *map(_named, rest))


def discover_files(spark: SparkSession, folder: str) -> list[str]:
    """Question files of a folder, in order of their base names: one a base name, the first extension wins. Only names are read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(fv.QUESTION_EXTENSIONS) + "}").load(folder)
    parts = listed.select("path", F.regexp_extract("path", r"([^/]+)[.][^./]+$", 1).alias("base"), F.regexp_extract("path", r"[.]([^./]+)$", 1).alias("extension"))
    priority = F.array_position(F.array(*map(F.lit, fv.QUESTION_EXTENSIONS)), F.col("extension"))
    return [r["path"] for r in parts.groupBy("base").agg(F.min_by("path", priority).alias("path")).orderBy("base").collect()]


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """One question file, or a folder of CSV parts."""
    if path.endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.option("header", "true").option("escape", '"').csv(path)
    return align_columns(raw, path.rstrip("/").rsplit("/", 1)[-1])


def read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    frames = [read_any(spark, p) for p in paths]
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
