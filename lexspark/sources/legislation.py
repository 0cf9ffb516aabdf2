"""Legislation XML to provision rows. Only the walk over one document's
elements is Python; numbering, filtering and chunking are columns."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspark import fixed_values as fv
from lexspark.functions import citations as c
from lexspark.functions.chunking import chunk_recursive
from lexspark.functions.text import file_stem, is_repealed_or_empty
from lexspark.operators.rows import posexplode_rows

_SCHEMA = "path string, ord int, number string, title string, text string"
_NUMBER = re.compile(r"\d+[A-Za-z]?")
_ID_NUMBER = re.compile(r"(?:section|regulation|article|reg|art)[-_]?(\d+[A-Za-z]?)", re.I)


def _name(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _text(elem) -> str:
    return " ".join(" ".join(elem.itertext()).split()) if elem is not None else ""


def _child(elem, name: str):
    return next((e for e in elem if _name(e.tag) == name), None) if elem is not None else None


def _elements(content: bytes) -> Iterator[tuple[str, str, str]]:
    """(number, title, text) of every P1 element in document order."""
    root = ET.fromstring(content)
    group_of = {child: parent for parent in root.iter() for child in parent if _name(parent.tag) == "P1group"}
    for elem in root.iter():
        if _name(elem.tag) != "P1":
            continue
        printed = _NUMBER.search(_text(_child(elem, "Pnumber")))
        named = _ID_NUMBER.search(next((v for k, v in elem.attrib.items() if _name(k) == "id"), ""))
        number = printed.group(0) if printed else named.group(1) if named else None
        if number:
            yield number, _text(_child(group_of.get(elem), "Title")) or _text(_child(elem, "Title")), _text(elem)


def parse_files(files: DataFrame) -> DataFrame:
    """(path, ord, number, title, text) from (path, content); a file that does
    not parse yields nothing."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows.extend((path, i, *found) for i, found in enumerate(_elements(bytes(content))))
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "ord", "number", "title", "text"]).astype({"ord": "int32"})

    return files.select("path", "content").mapInPandas(parse, _SCHEMA)


def source_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.LEGISLATION_SOURCES, "slug string, document string, short_doc string, regulator string, domain string, kind string")


def provisions_from_elements(elements: DataFrame, sources: DataFrame, chunker=chunk_recursive) -> DataFrame:
    """The first element of each number per file, repealed ones dropped, long
    texts chunked; the source is found by file name."""
    first = elements.groupBy("path", "number").agg(F.min(F.struct("ord", "title", "text")).alias("e")).select("path", "number", "e.title", "e.text")
    kept = first.where(~is_repealed_or_empty(F.col("text"))).withColumn("slug", file_stem(F.col("path")))
    rows = kept.join(sources, "slug").withColumn("chunks", chunker(F.col("text")))
    rows = posexplode_rows(rows.withColumn("n_chunks", F.size("chunks")), ["*"], "chunks", "n", "chunk")
    number, many = F.col("number"), F.col("n_chunks") > 1
    cite = c.legislation_cite(F.col("short_doc"), F.col("kind"), number)
    mark = lambda prefix: F.when(many, F.concat(F.lit(prefix), F.col("n").cast("string"))).otherwise(F.lit(""))
    return rows.select(
        F.concat(c.legislation_id(F.col("slug"), F.col("kind"), number), mark("_chunk")).alias("id"), cite.alias("cite"),
        F.when(F.col("title") != "", F.col("title")).otherwise(cite).alias("title"), F.col("chunk").alias("text"), F.col("regulator").alias("module"), "domain",
        F.lit("").alias("terms"), F.lit("").alias("threshold"), F.lit("").alias("deadline"), F.col("short_doc").alias("document"), "regulator",
        F.concat(F.lit("/"), "short_doc", F.lit("/"), "kind", F.lit("."), number, mark("/chunk")).alias("hierarchy_path"))


def read_legislation(spark: SparkSession, root: str, sources: DataFrame | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(root)
    return provisions_from_elements(parse_files(files), source_dim(spark) if sources is None else sources)
