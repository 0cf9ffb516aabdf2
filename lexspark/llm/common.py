"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspark.session import cut_lineage


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, schema: str, fn: Callable[..., tuple]) -> DataFrame:
    """fn(value of each column) -> one output tuple per row, in Arrow batches."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            out = [fn(*(c[i].as_py() for c in columns)) for i in range(batch.num_rows)]
            if out:
                yield record_batch(names, kinds, list(zip(*out)))

    kinds = arrow_kinds(schema)
    return df.mapInArrow(run, schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(),
          "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def arrow_kinds(schema: str) -> list[pa.DataType]:
    return [_KINDS[part.split()[1]] for part in schema.split(",")]


def record_batch(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node of its component.

    Alternating large-star and small-star rounds. A round moves one row per
    edge, minima are combined before the shuffle, and every round is written to
    the shared folder, so no group is gathered and a lost executor costs one
    round. Ends when a round changes nothing.
    """
    current = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut_lineage(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        current = cut_lineage(small)
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return current.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        mark = now
