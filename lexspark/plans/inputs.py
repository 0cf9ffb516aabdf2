"""Inputs of the registered queries, each with its DuckDB twin.

Where the driver tables have no column for a role (provisions, answers), it is
derived from a whole table by one expression that both engines share.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspark.operators.stored_index import StoredIndex
from lexspark.session import scratch_path

ROWS_A_TASK = 50_000  # rows of a table that a task turns into texts

PROVISION_EXPRS = [
    "'P' || CAST(p_partkey AS STRING) AS id",
    "CASE p_partkey % 5 WHEN 0 THEN 'FSMA 2000 s.' WHEN 1 THEN 'RAO 2001 art.' WHEN 2 THEN 'MLR 2017 reg.'"
    " WHEN 3 THEN 'PSR 2017 reg.' ELSE 'UK MAR art.' END || CAST(p_partkey % 997 AS STRING) AS cite",
    "p_name AS title",
    "'See FSMA section ' || CAST(p_partkey * 7 % 997 AS STRING) || ' and MLR reg ' || CAST(p_partkey * 13 % 997 AS STRING)"
    " || ', also COBS ' || CAST(p_partkey % 9 + 1 AS STRING) || '.2.1r. Firms apply section ' || CAST(p_partkey * 3 % 997 AS STRING)"
    " || ', article ' || CAST(p_partkey * 5 % 997 AS STRING) || ' and regulation ' || CAST(p_partkey * 11 % 997 AS STRING)"
    " || ' when they trade the ' || p_name || ' with retail clients.' AS text",
    "CASE p_partkey % 4 WHEN 0 THEN 'FCA' WHEN 1 THEN 'PRA' WHEN 2 THEN 'HMT' ELSE 'XYZ' END AS module",
    "p_brand AS domain",
    "lower(p_type) || '| ' || lower(p_brand) || ' |' AS terms",
    "CASE WHEN p_size % 3 = 0 THEN '£' || CAST(p_size AS STRING) || ',000' ELSE '' END AS threshold",
    "CASE WHEN p_size % 7 = 0 THEN CAST(p_size AS STRING) || ' days' ELSE '' END AS deadline",
    "CASE WHEN p_partkey % 13 = 0 THEN 'Other' ELSE CASE p_partkey % 5 WHEN 0 THEN 'FSMA 2000' WHEN 1 THEN 'RAO 2001'"
    " WHEN 2 THEN 'MLR 2017' WHEN 3 THEN 'PSR 2017' ELSE 'UK MAR' END END AS document",
    "CASE WHEN p_partkey % 3 = 0 THEN ' BoE ' ELSE '' END AS regulator",
    "'/part/' || CAST(p_partkey AS STRING) AS hierarchy_path",
]
PROVISIONS_SQL = "SELECT " + ", ".join(PROVISION_EXPRS) + " FROM part"

ANSWER_EXPRS = [
    "o_orderkey AS answer_id",
    "CASE o_orderkey % 4 WHEN 0 THEN 'What is the general prohibition?' WHEN 1 THEN 'Is this financial promotion fair?'"
    " WHEN 2 THEN 'Who pays for an unauthorised card payment?' ELSE 'Which audit issues matter?' END AS question",
    "CASE WHEN o_orderkey % 10 = 0 THEN 'Short.' WHEN o_orderkey % 10 = 1 THEN 'No rule is named here, yet the text is long enough to"
    " stand as an answer on its own merits.' ELSE '# Answer' || chr(10) || '- Firms apply section ' || CAST(o_custkey % 997 AS STRING) || ' when"
    " they trade with retail clients under FSMA 2000 s.' || CAST(o_orderkey % 997 AS STRING) || '. Records follow MLR 2017 reg.'"
    " || CAST(o_orderkey * 3 % 1500 AS STRING) || ' for five years [1].' || chr(10) || '> quoted line that is never a claim at all'"
    " || chr(10) || '2. See COBS ' || CAST(o_orderkey % 9 + 1 AS STRING) || '.2.1R (https://example.com/x) and the red breach, amber note.'"
    " || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'Source: FSMA 2000 s.' || CAST(o_orderkey % 997 AS STRING) || ' | COBS 4' ELSE '' END END AS answer",
    "'FSMA 2000 s.' || CAST(o_orderkey % 997 AS STRING) AS context_line",
    "'MLR 2017 reg.' || CAST(o_orderkey * 3 % 1300 AS STRING) AS chunk_line",
]
ANSWERS_SQL = "SELECT " + ", ".join(ANSWER_EXPRS) + " FROM orders"

# one record per user turn answered by the next turn of the conversation
RECORDS_SQL = (
    "SELECT CAST(u.conv_id AS STRING) || '-' || CAST(u.turn AS STRING) AS qid, 'c' || CAST(u.conv_id % 10 AS STRING) AS domain,"
    " CASE u.conv_id % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'Mid' WHEN 2 THEN 'hard' ELSE 'expert' END AS complexity,"
    " u.text AS question, u.text AS ground_truth, a.text AS answer"
    " FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1"
    " WHERE u.role = 'user' AND a.role = 'assistant'"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table about to go through text work. In one small local file it is one
    row group, hence one busy task, so it is spread over the cores first. Tables
    in many or large files split by themselves and are left as they are."""
    df, path = table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet"
    if os.path.isfile(path) and os.path.getsize(path) < 128 << 20:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of short rows, each of which becomes a text with much work of its own: dealt out so that a task has about ROWS_A_TASK
    of them, however many rows a file or a row group holds. Only the columns in use are moved."""
    df = table(spark, sf_dir, name)
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK)))


def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "part").selectExpr(*PROVISION_EXPRS)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "orders").selectExpr(*ANSWER_EXPRS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        RECORDS_SQL.replace("FROM conversations u JOIN conversations a", "FROM {c} u JOIN {c} a"),
        c=text_table(spark, sf_dir, "conversations"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("static::"), F.col("doc_id").cast("string")).alias("doc_key"), "text")


_INDEXES: dict[tuple[str, str], StoredIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The corpus as a stored index, as a service would keep it: the first query of an application that needs it writes it, later ones search it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = StoredIndex.create(corpus(spark, sf_dir), scratch_path(spark, "index"))
    return _INDEXES[key]


CORPUS_SQL = "SELECT 'static::' || CAST(doc_id AS STRING) AS doc_key, text FROM documents"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


QUESTIONS_SQL = "SELECT CAST(item_id AS STRING) AS query_id, text FROM benchmark"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("static::"), F.col("vec_id").cast("string")).alias("doc_key"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question item i is embedded as vector i."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    emb = table(spark, sf_dir, "embeddings")
    return items.join(emb, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").cast("string").alias("query_id"), "embedding")


VECTORS_SQL = "SELECT 'static::' || CAST(vec_id AS STRING) AS doc_key, embedding FROM embeddings"
QUERY_VECTORS_SQL = "SELECT CAST(item_id AS STRING) AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id"


def sql_tokens(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[a-z0-9£]+')"


def sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_in_order(items: str) -> str:
    """Distinct items of a list in order of first appearance."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"
