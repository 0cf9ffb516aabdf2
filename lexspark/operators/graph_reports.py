"""Counts, rankings and lookups over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexspark import fixed_values as fv
from lexspark.functions.text import preview
from lexspark.operators.graph_build import Graph, edge_table, issued_by, part_of


def graph_summary(graph: Graph) -> DataFrame:
    """(kind, label, n): node counts per label and edge counts per type."""
    nodes = graph.provisions.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.lit("Provision").alias("label"), "n")
    terms = graph.mentions.agg(F.count_distinct("term").alias("n")).select(F.lit("node").alias("kind"), F.lit("Term").alias("label"), "n")
    fixed = graph.provisions.sparkSession.createDataFrame(
        [("node", "Regulator", len(fv.REGULATORS)), ("node", "Document", len(fv.DOCUMENTS))], "kind string, label string, n bigint")
    edges = edge_table(graph).groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("type").alias("label"), "n")
    return nodes.unionByName(terms).unionByName(fixed).unionByName(edges)


def counts_by(provisions: DataFrame, column: str) -> DataFrame:
    return provisions.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def sample_rows(provisions: DataFrame, n: int = 5) -> DataFrame:
    return provisions.orderBy("id").limit(n).select("id", "cite", "title", preview(F.col("text"), 160).alias("preview"))


def provisions_of_regulator(provisions: DataFrame, regulator: str, limit: int | None = 20) -> DataFrame:
    """The first provisions of a regulator by cite; all with limit=None."""
    ids = issued_by(provisions).where(F.col("regulator") == regulator).select("id")
    ordered = provisions.join(ids, "id", "left_semi").orderBy("cite", "id").select("id", "cite", "title")
    return ordered if limit is None else ordered.limit(limit)


def citations_out(graph: Graph) -> DataFrame:
    """Outgoing citations per document; counted per provision before the join."""
    out = graph.links.where("type = 'CITES'").groupBy("src").agg(F.count("*").alias("n"))
    joined = part_of(graph.provisions).join(out, F.col("id") == F.col("src"))
    return joined.groupBy("document").agg(F.sum("n").alias("cites_out"))


def most_cited(graph: Graph, k: int = 15) -> DataFrame:
    counted = graph.links.where("type = 'CITES'").groupBy("dst").agg(F.count("*").alias("times_cited"))
    top = counted.join(graph.provisions.select(F.col("id").alias("dst"), "cite", "title"), "dst")
    return top.orderBy(F.col("times_cited").desc(), "cite", "dst").limit(k).select(F.col("dst").alias("id"), "cite", "title", "times_cited")


def term_bridge(graph: Graph, k: int | None = 20) -> DataFrame:
    """Per term the first k provisions that share it, all with k=None (then
    without n); members are listed, not paired, so a term on a third of all
    provisions adds a row for each at most."""
    members = graph.mentions.join(graph.provisions.select("id", "cite", "title"), "id")
    if k is None:
        return members.select("term", "id", "cite", "title")
    w = Window.partitionBy("term").orderBy("cite", "id")
    return members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("term", "n", "id", "cite", "title")


def known_cites(cites: DataFrame, provisions: DataFrame) -> DataFrame:
    """The subset of cites that exist, exact match."""
    return cites.select("cite").where("cite <> ''").distinct().join(provisions.select("cite"), "cite", "left_semi")


def provision_texts(cites: DataFrame, provisions: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(cite, found_cite, title, text): one representative chunk per cite."""
    key = F.lower("cite") if ignore_case else F.col("cite")
    texts = provisions.groupBy(key.alias("key")).agg(F.min(F.struct("id", "cite", "title", "text")).alias("p"))
    wanted = cites.select("cite").where("cite <> ''").distinct().withColumn("key", F.lower("cite") if ignore_case else F.col("cite"))
    return wanted.join(texts, "key").select("cite", F.col("p.cite").alias("found_cite"), "p.title", "p.text")
