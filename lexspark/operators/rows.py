"""Array columns to rows, and running numbers.

A plain explode makes Spark test the array for emptiness in a filter below it,
which evaluates the expression behind the array again (tokenizing every text
twice). The outer form has no such filter; the null rows of empty arrays are
dropped right after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexspark.session import cut_lineage


def explode_rows(df: DataFrame, keep: list, array: Column | str, name: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def number_in_order(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Running numbers from 0 per key group in a given order.

    Rows are range-partitioned by keys and order together, so a group with a
    third of all rows is spread over many partitions. Each partition numbers its
    own stretch of a group; the stretches' sizes (one row per partition and
    group) give the offsets. The partitioned rows are written once, because the
    numbers must not change between these two uses.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    local = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)) - 1)
    sizes = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0))).drop("_size")
    same = F.col("l._part") == F.col("o._part")
    for key in keys:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"o.{key}"))
    return local.alias("l").join(offsets.alias("o"), same).select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("l._n") + F.col("o._before")).alias(name))


def posexplode_rows(df: DataFrame, keep: list, array: Column | str, pos: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
