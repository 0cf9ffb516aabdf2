"""Files to documents: text, tables, pages; one reader per extension.

Every reader returns (doc_key, text). A file is one document; of a table file
every ROWS_PER_PART rows are one (`key`, `key#1`, ...), so that no single task
has to hold an arbitrarily large file and splits do not change the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexspark import fixed_values as fv
from lexspark.functions import citations as c
from lexspark.functions.chunking import chunk_recursive
from lexspark.functions.text import file_slug, file_stem, paragraphs
from lexspark.operators.sizing import union_all
from lexspark.plugins import extract_pages
from lexspark.session import cut_lineage
from lexspark.operators.rows import explode_rows, number_in_order, posexplode_rows

# rows of a table file that make one document, whatever the file's size and splits
ROWS_PER_PART = 100_000
TEXT_GLOB, TABLE_GLOB, PARQUET_GLOB, BINARY_GLOB = "*.{txt,md}", "*.csv", "*.parquet", "*.{pdf,docx,xls,xlsx,pptx}"


def _reader(spark: SparkSession, glob: str):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)


def static_key(root: str, path: Column) -> Column:
    """static::<path below root>."""
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.concat(F.lit("static::"), F.element_at(F.split(decoded, rf"\Q{base}/\E", 2), -1))


def read_texts(spark: SparkSession, root: str, glob: str = TEXT_GLOB) -> DataFrame:
    """Whole text files; bytes that are not UTF-8 are dropped."""
    files = _reader(spark, glob).text(root, wholetext=True)
    text = F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))
    return files.select(static_key(root, F.col("_metadata.file_path")).alias("doc_key"), text.alias("text"))


def _joined_in_order(cell: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "i", cell.alias("v")))), lambda s: s["v"]), " ")


def _placed(rows: DataFrame, root: str, *columns: Column) -> DataFrame:
    """Rows with their file's key (k) and their place in it (b, i)."""
    return rows.select(
        static_key(root, F.col("_metadata.file_path")).alias("k"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"), *columns)


def _listed(numbered: DataFrame, cells: list[str], rows_per_part: int) -> DataFrame:
    """Cells of each rows_per_part rows of a file, in row order (or column by
    column for several cells). Later parts of a file have #1, #2, ... in their key."""
    listed = numbered.withColumn("part", F.floor(F.col("at") / rows_per_part)).groupBy("k", "part").agg(
        *[_joined_in_order(F.col(c)).alias(f"t_{c}") for c in cells])
    key = F.when(F.col("part") == 0, F.col("k")).otherwise(F.concat("k", F.lit("#"), F.col("part").cast("string")))
    return listed.select(key.alias("doc_key"), F.concat_ws(" ", *[f"t_{c}" for c in cells]).alias("text"))


def read_tables(spark: SparkSession, root: str, glob: str = TABLE_GLOB, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """CSV files flattened row by row; files may differ in their columns. Empty
    cells are left out. Folders are listed and files opened once, however many
    there are: lines are stored with their place, blank ones left out, and the first one of a file is its header."""
    lines = _reader(spark, glob).text(root).where(F.col("value").rlike(r"[^\x00-\x20]"))
    placed = cut_lineage(_placed(lines, root, "value"))
    widest = placed.agg(F.max(F.regexp_count("value", F.lit(","))).alias("n")).first()["n"]
    schema = ", ".join(f"c{i} string" for i in range((widest or 0) + 1))
    numbered = number_in_order(placed, ["k"], ["b", "i"], "n").where("n > 0").withColumn("at", F.col("n") - 1)
    cells = numbered.withColumn("cells", F.from_csv("value", schema, {"escape": '"'}))
    return _listed(cells.select("k", "b", "i", "at", F.concat_ws(" ", "cells.*").alias("v")), ["v"], rows_per_part)


def read_parquet_texts(spark: SparkSession, root: str, glob: str = PARQUET_GLOB, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The string columns of Parquet files, one column after the other."""
    rows = _reader(spark, glob).option("mergeSchema", "true").parquet(root)
    names = [f.name for f in rows.schema.fields if f.dataType.typeName() == "string"]
    columns = [F.col(f"`{n}`").alias(f"v{i}") for i, n in enumerate(names)]
    return _listed(number_in_order(_placed(rows, root, *columns), ["k"], ["b", "i"], "at"), [f"v{i}" for i in range(len(names))], rows_per_part)


def read_pages(spark: SparkSession, root: str, extractor=None, glob: str = BINARY_GLOB) -> DataFrame:
    """(path, page_no, text) of binary documents through an extractor plug-in."""
    return extract_pages(_reader(spark, glob).format("binaryFile").load(root), extractor)


def pages_to_documents(pages: DataFrame, root: str | None = None, joiner: str = "\n") -> DataFrame:
    """Page texts of a file joined in order; unreadable files drop out."""
    grouped = pages.where("page_no >= 0 AND text <> ''").groupBy("path").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), joiner).alias("text"))
    key = static_key(root, F.col("path")) if root else F.col("path")
    return grouped.select(key.alias("doc_key"), "text")


def scan_corpus(spark: SparkSession, root: str, kinds=("text", "table", "parquet", "binary"), extractor=None) -> DataFrame:
    """All documents below a folder by file type; empty ones are skipped."""
    readers = {
        "text": lambda: read_texts(spark, root), "table": lambda: read_tables(spark, root), "parquet": lambda: read_parquet_texts(spark, root),
        "binary": lambda: pages_to_documents(read_pages(spark, root, extractor), root),
    }
    return union_all([readers[k]() for k in kinds]).where("text <> ''")


def corpus_report(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_files"), F.sum(F.length("text")).alias("n_chars"))


def page_provisions(documents: DataFrame, max_chunks: int = 0, min_chars: int = fv.MIN_FILE_CHARS, chunker=chunk_recursive) -> DataFrame:
    """Provisions from page texts (folder, name, text): cite and title come from
    the file name. max_chunks > 0 keeps that many chunks per file."""
    stem, folder = file_stem(F.col("name")), F.col("folder")
    rows = posexplode_rows(documents.where(F.length("text") >= min_chars), ["folder", "name"], chunker(F.col("text")), "n", "chunk")
    if max_chunks > 0:
        rows = rows.where(F.col("n") < max_chunks)
    number, page = F.col("n").cast("string"), (F.col("n") + 1).cast("string")
    module = c.file_module(stem, folder)
    return rows.select(
        F.concat(F.lit("PDF_"), file_slug(F.col("name")), F.lit("_c"), number).alias("id"),
        F.concat(module, F.lit(" ("), stem, F.lit(" p"), page, F.lit(")")).alias("cite"),
        F.concat(stem, F.lit(" (excerpt "), page, F.lit(")")).alias("title"), F.col("chunk").alias("text"), module.alias("module"),
        F.when(folder == "fca", "Handbook").otherwise("Rulebook").alias("domain"), F.lit("").alias("terms"), F.lit("").alias("threshold"), F.lit("").alias("deadline"),
        stem.alias("document"), c.file_regulator(folder).alias("regulator"),
        F.concat(F.lit("/"), folder, F.lit("/"), "name", F.lit("/chunk"), number).alias("hierarchy_path"))


def training_records(legislation: DataFrame, handbook: DataFrame, slices: DataFrame) -> DataFrame:
    """(text, source, type): legislation rows (text, act, section_id), handbook
    paragraphs (name, text) and slices (name, text, answer)."""
    laws = legislation.select("text", F.concat(F.coalesce("act", F.lit("")), F.lit("§"), F.coalesce("section_id", F.lit(""))).alias("source"), F.lit("legislation").alias("type"))
    paras = explode_rows(handbook, ["name"], paragraphs(F.col("text")), "text").select("text", F.col("name").alias("source"), F.lit("fca_pdf").alias("type"))
    rest = slices.select(F.coalesce(F.nullif("text", F.lit("")), "answer", F.lit("")).alias("text"), F.col("name").alias("source"), F.lit("slice").alias("type"))
    return laws.unionByName(paras).unionByName(rest)
