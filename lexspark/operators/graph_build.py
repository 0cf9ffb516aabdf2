"""Provisions to node and edge tables. Nodes are DataFrames, edges are rows
(src, dst, type); a merge is one aggregation by key."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexspark import fixed_values as fv
from lexspark.functions.citations import extract_citations
from lexspark.functions.text import strip
from lexspark.operators.sizing import union_all
from lexspark.session import cut_lineage
from lexspark.operators.rows import explode_rows

STORED = ["cite", "title", "text", "module", "domain", "threshold", "deadline"]


def upsert_provisions(batches: list[DataFrame]) -> DataFrame:
    """One row per id, later batches winning; repeating a batch changes nothing."""
    columns = ["id", *STORED]
    versioned = [b.select(*columns).withColumn("version", F.lit(i)) for i, b in enumerate(batches)]
    latest = union_all(versioned).groupBy("id").agg(F.max(F.struct("version", *STORED)).alias("p"))
    return latest.select("id", *[f"p.{c}" for c in STORED])


def mentions(provisions: DataFrame) -> DataFrame:
    """(term, id) from the pipe list of terms."""
    term = F.explode(F.split(F.coalesce("terms", F.lit("")), r"\|"))
    rows = provisions.select(term.alias("t"), "id").select(F.lower(strip(F.col("t"))).alias("term"), "id")
    return rows.where("term <> ''").distinct()


def terms(provisions: DataFrame) -> DataFrame:
    return mentions(provisions).select(F.col("term").alias("name")).distinct()


def representatives(provisions: DataFrame) -> DataFrame:
    """The chunk that stands for a cite shared by several: the smallest id."""
    return provisions.groupBy("cite").agg(F.min("id").alias("rep_id"))


def defined_by(provisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links every chunk of the first cite to the representative of the second,
    which stays linear however many chunks share a cite."""
    reps = representatives(provisions)
    sources = provisions.select(F.col("id").alias("src"), F.col("cite").alias("from_cite"))
    return (
        pairs.join(sources, "from_cite").join(reps, F.col("to_cite") == F.col("cite"))
        .select("src", F.col("rep_id").alias("dst")).distinct()
    )


def default_defined_by_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.DEFINED_BY_PAIRS, "from_cite string, to_cite string")


def regulators_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.REGULATORS, "name string, full_name string")


def documents_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.DOCUMENTS, "name string, full_name string, kind string")


def sample_provisions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fv.SAMPLE_PROVISIONS, ", ".join(f"{c} string" for c in
        ["id", "cite", "title", "text", "module", "domain", "terms", "threshold", "deadline"]))


def regulator_name() -> Column:
    given = strip(F.coalesce("regulator", F.lit("")))
    return F.when(F.coalesce("regulator", F.lit("")) != "", given).otherwise(strip(F.coalesce("module", F.lit(""))))


def issued_by(provisions: DataFrame) -> DataFrame:
    """Edges to known regulators (regulator, else module). The dimension is a
    fixed list, so the lookup is a filter inside the scan."""
    known = [name for name, _ in fv.REGULATORS]
    return provisions.select("id", regulator_name().alias("regulator")).where(F.col("regulator").isin(known)).distinct()


def part_of(provisions: DataFrame) -> DataFrame:
    known = [name for name, _, _ in fv.DOCUMENTS]
    named = provisions.select("id", strip(F.coalesce("document", F.lit(""))).alias("document"))
    return named.where(F.col("document").isin(known)).distinct()


def citation_pairs(provisions: DataFrame) -> DataFrame:
    """(src, target_cite): references in a provision's text to other known cites."""
    found = explode_rows(
        provisions.where("id <> '' AND text <> ''"), [F.col("id").alias("src"), F.col("cite").alias("own")],
        extract_citations(F.col("text"), F.col("document")), "target_cite")
    known = provisions.where("cite <> ''").select(F.col("cite").alias("target_cite")).distinct()
    others = found.where(F.col("own").isNull() | (F.col("own") != F.col("target_cite")))
    return others.join(known, "target_cite", "left_semi").select("src", "target_cite").distinct()


def cites_edges(provisions: DataFrame) -> DataFrame:
    """CITES edges to one representative chunk per target cite. The join with
    the representatives also drops unknown targets, so no dangling edges.
    Links are dealt out before they are made distinct: a provision names a cite
    once, so a first round inside the scan would hold nearly all links of a
    task's provisions for nothing."""
    found = explode_rows(
        provisions.where("id <> '' AND text <> ''"), [F.col("id").alias("src"), F.col("cite").alias("own")],
        extract_citations(F.col("text"), F.col("document")), "cite")
    others = found.where(F.col("own").isNull() | (F.col("own") != F.col("cite")))
    links = others.join(representatives(provisions), "cite").select("src", F.col("rep_id").alias("dst"))
    parts = int(provisions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return links.repartition(parts, "src", "dst").distinct()


class Graph(NamedTuple):
    provisions: DataFrame
    mentions: DataFrame  # (term, id)
    links: DataFrame  # (src, dst, type) between provisions


def build_graph(provisions: DataFrame, pairs: DataFrame | None = None) -> Graph:
    """Edges are extracted once and materialised; every walk reads them several times."""
    links = cites_edges(provisions).withColumn("type", F.lit("CITES"))
    if pairs is not None:
        links = links.unionByName(defined_by(provisions, pairs).withColumn("type", F.lit("DEFINED_BY")))
    return Graph(provisions, mentions(provisions), cut_lineage(links))


def edge_table(graph: Graph) -> DataFrame:
    """All edges as (src, dst, type), for a write partitioned by type."""
    parts = [
        graph.links,
        graph.mentions.select(F.col("term").alias("src"), F.col("id").alias("dst"), F.lit("MENTIONS").alias("type")),
        issued_by(graph.provisions).select(F.col("id").alias("src"), F.col("regulator").alias("dst"), F.lit("ISSUED_BY").alias("type")),
        part_of(graph.provisions).select(F.col("id").alias("src"), F.col("document").alias("dst"), F.lit("PART_OF").alias("type")),
    ]
    return union_all(parts)


def write_graph(graph: Graph, path: str) -> None:
    graph.provisions.write.mode("overwrite").parquet(f"{path}/provisions")
    edge_table(graph).write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def key_report(spark: SparkSession, provisions: DataFrame) -> DataFrame:
    """Rows and duplicated keys per node label; all duplicates must be 0."""
    nodes = {
        "Provision": provisions.select(F.col("id").alias("key")),
        "Term": terms(provisions).select(F.col("name").alias("key")),
        "Regulator": regulators_dim(spark).select(F.col("name").alias("key")),
        "Document": documents_dim(spark).select(F.col("name").alias("key")),
    }
    parts = [
        df.groupBy("key").agg(F.count("*").alias("n")).agg(
            F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("duplicates")).select(F.lit(label).alias("label"), "n_rows", "duplicates")
        for label, df in nodes.items()
    ]
    return union_all(parts)


def collect_sources(spark: SparkSession, source: str, xml: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Provisions of 'xml', 'pdfs', 'both' or the built-in 'legacy' sample."""
    if source == "legacy":
        return sample_provisions(spark)
    chosen = [df for name, df in (("xml", xml), ("pdfs", pages)) if df is not None and source in (name, "both")]
    if not chosen:
        raise ValueError(f"no provisions for source {source!r}")
    out = chosen[0]
    for df in chosen[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
