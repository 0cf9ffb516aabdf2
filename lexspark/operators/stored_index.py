"""A stored inverted index: written once, appended to, merged, searched without reading a text.

Folder layout, all Parquet:

* `blocks/segment=../bucket=..`: one row per token and document range. Documents are
  dealt by the hash of their key into ranges of about RANGE documents and numbered
  inside the range in key order. A row holds the documents of the range that have
  the token (number, count, length, delta-coded positions) and its impact points
  (for every count, the shortest length it occurs with), which give the block's
  largest BM25 contribution exactly, whatever N, df and average length become.
  Rows of bucket -1 hold the keys of a range.
* `terms/segment=..`: document frequency and occurrences of every token.
* `manifest`: for every version the live segments with their document counts and
  total lengths, so N, average length and df stay exact sums over segments.

A segment is never changed. append() writes a new one, merge() rewrites all live
ones as one; both count from the moment their manifest rows are written, so a
failed job leaves the last version readable. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexspark import fixed_values as fv
from lexspark.functions.text import word_tokens
from lexspark.operators.bit_counts import best_shared, bit_rows, spans
from lexspark.operators.postings import ROUNDING, best_rows, edge_tokens, phrase_search as scan_phrases
from lexspark.operators.ranking import top_k
from lexspark.operators.rows import explode_rows, number_in_order, posexplode_rows
from lexspark.operators.sizing import BROADCAST_ROWS, query_blocks, union_all
from lexspark.session import cut_lineage, shuffles_dropped

RANGE = 1024  # documents of a range, about
KEYS = -1  # bucket of the rows that hold the keys of a range
LOOKUPS = 4  # tokens of a phrase whose lists are intersected, the rarest; the text decides about the others
QUERY_ROWS = 1_000_000  # (query, token) rows searched at once; more are searched in blocks
SEEDS = 2  # ranges of the highest bounds that give a query its first threshold
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
PART = 32  # ranges whose documents are counted together by keyword_overlap
OVERLAP_ROWS = 16_000_000  # (query, token) rows that a task of keyword_overlap holds at once, 4 bytes each; more are more passes
RUN_ROWS = 8_000_000  # (query, place, token) rows that a task of phrase_documents holds at once, 12 bytes each; more are more passes
TASKS_A_CORE = 2  # tasks that share out the parts, at most
TOKENS_AT_ONCE = 500_000  # tokens sorted by one step of a build, or one longer document

BLOCK_SCHEMA = ("range_no long, tok string, docs array<int>, tfs array<int>, lens array<int>, positions array<array<int>>, impact_tf array<int>,"
                " impact_len array<int>, keys array<string>, chars long, segment string, bucket int")
MOVES_AT_ONCE = 16_000_000  # documents whose new places a task of a merge holds at once, 8 bytes each; more are more passes
MOVED_SCHEMA = "range_no long, pieces binary"
PACKED_SCHEMA = BLOCK_SCHEMA.replace(", segment string, bucket int", "")
TERM_SCHEMA = "tok string, df long, occurrences long, segment string"
MANIFEST_SCHEMA = "version long, segment string, ranges long, buckets int, n_docs long, total_len long, floor double"


class Totals(NamedTuple):
    n_docs: int
    avgdl: float
    floor: float  # epsilon x mean raw idf, the idf of tokens in over half of the documents


def _raw_idf(n: int) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds for one write."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class StoredIndex:
    """An index in a folder that all executors see. The object holds the manifest rows of one version (a row per segment)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.path}/manifest")
        latest = rows.agg(F.max("version")).first()[0]
        self.segments = rows.where(F.col("version") == latest).collect()
        self.version, self.buckets = latest, self.segments[0]["buckets"]
        live = [s for s in self.segments if s["segment"]]
        n, length = sum(s["n_docs"] for s in live), sum(s["total_len"] for s in live)
        self.live = [s["segment"] for s in live]
        self.totals = Totals(n, length / n if n else 0.0, self.segments[0]["floor"])

    # --- writing -------------------------------------------------------------
    @classmethod
    def create(cls, docs: DataFrame, path: str, buckets: int | None = None) -> StoredIndex:
        """Indexes docs (doc_key, text) in a new folder. Null texts are empty documents. Buckets are files of the token space: one for
        every 50 million tokens is a good size, and the default follows it."""
        spark = docs.sparkSession
        if buckets is None:
            chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
            buckets = int(min(4096, max(8, chars // 300_000_000)))
        empty = spark.createDataFrame([(0, "", 1, buckets, 0, 0, 0.0)], MANIFEST_SCHEMA)
        empty.coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/manifest")
        return cls(spark, path).append(docs)

    def append(self, docs: DataFrame) -> StoredIndex:
        """Adds the documents whose keys are not stored yet, as a new segment; gives the index of the new version."""
        if self.live:
            docs = docs.join(self.document_keys().select("doc_key"), "doc_key", "left_anti")
        n = docs.count()
        if not n:
            return self
        ranges = 1 << max(0, (-(-n // RANGE) - 1).bit_length())
        placed = docs.select("doc_key", "text").withColumn("range_no", F.pmod(F.xxhash64("doc_key"), F.lit(ranges)))
        # texts move once, ordered by range and key; a range is indexed where it lies, so postings are never rows
        ordered = placed.repartition("range_no").sortWithinPartitions("range_no", "doc_key")
        toks = ordered.select("range_no", "doc_key", F.length("text").cast("long").alias("chars"), word_tokens(F.col("text")).alias("toks"))
        return self._commit(toks.mapInArrow(_blocks_of_ranges, PACKED_SCHEMA), ranges, keep=self.live)

    def merge(self) -> StoredIndex:
        """Rewrites all live segments as one, from postings alone. Segments of older versions stay until remove_old().

        A stored row is cut where its documents part into new ranges and moved once, as a list, packed with others of its range; a new
        range is put together and written where it lies, as in a build. Where documents go is known to every task, MOVES_AT_ONCE
        documents at a time."""
        if len(self.live) < 2:
            return self
        n = self.totals.n_docs
        ranges = 1 << max(0, (-(-n // RANGE) - 1).bit_length())
        names = self.document_keys().withColumn("new_range", F.pmod(F.xxhash64("doc_key"), F.lit(ranges)))
        in_range = Window.partitionBy("new_range").orderBy("doc_key")
        names = cut_lineage(names.withColumn("new_doc", F.row_number().over(in_range) - 1))
        stored = self._blocks("segment", "range_no", "tok", "docs", "positions").where(F.col("bucket") != KEYS).drop("bucket")
        stripes = -(-n // MOVES_AT_ONCE)
        in_stripe = lambda df, i: df.where(F.pmod(F.xxhash64("segment", "range_no"), F.lit(stripes)) == i) if stripes > 1 else df
        moved = union_all([in_stripe(stored, i).mapInArrow(_mover(in_stripe(names, i)), MOVED_SCHEMA) for i in range(stripes)])
        fresh = names.select(F.col("new_range").alias("range_no"), F.col("new_doc").alias("doc"), "len", "doc_key", "chars")
        packed = moved.groupBy("range_no").cogroup(fresh.groupBy("range_no")).applyInArrow(_merged_range, PACKED_SCHEMA)
        return self._commit(packed, ranges, keep=[])

    def _commit(self, packed: DataFrame, ranges: int, keep: list[str]) -> StoredIndex:
        """Writes packed rows (PACKED_SCHEMA) as a segment and a manifest version of it and the kept segments. Every task writes the rows
        it holds, a file a bucket, so lists are not exchanged on their way from a range to its buckets."""
        segment = uuid.uuid4().hex
        rows = packed.withColumn("segment", F.lit(segment)).withColumn("bucket", self._bucket_of_row())
        with _setting(self.spark, _OPEN_FILES, str(self.buckets + 1)), shuffles_dropped(self.spark):
            rows.write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.path}/blocks")
        written = self._read_blocks().where(F.col("segment") == segment)
        occurrences = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
        terms = written.where(F.col("bucket") != KEYS).groupBy("tok").agg(F.sum(F.size("docs")).alias("df"), F.sum(occurrences).alias("occurrences"))
        with shuffles_dropped(self.spark):
            terms.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(f"{self.path}/terms")
        size = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
        new = written.where(F.col("bucket") == KEYS).agg(F.sum(F.size("docs")), F.sum(size)).first()
        kept = [s for s in self.segments if s["segment"] in keep]
        n = sum(s["n_docs"] for s in kept) + new[0]
        merged = self._read_terms([*keep, segment]).groupBy("tok").agg(F.sum("df").alias("df"))
        floor = merged.agg(F.avg(_raw_idf(n)) * fv.BM25_EPSILON).first()[0] or 0.0
        version = self.version + 1
        lines = [(version, s["segment"], s["ranges"], self.buckets, s["n_docs"], s["total_len"], floor) for s in kept]
        lines.append((version, segment, ranges, self.buckets, new[0], new[1], floor))
        self.spark.createDataFrame(lines, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return StoredIndex(self.spark, self.path)

    # --- reading -------------------------------------------------------------
    def _bucket(self, tok: Column) -> Column:
        return F.pmod(F.xxhash64(tok), F.lit(self.buckets)).cast("int")

    def _bucket_of_row(self) -> Column:
        return F.when(F.col("keys").isNotNull(), F.lit(KEYS)).otherwise(self._bucket(F.col("tok")))

    def _read_blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCK_SCHEMA).parquet(f"{self.path}/blocks")

    def _read_terms(self, segments: list[str]) -> DataFrame:
        return self.spark.read.schema(TERM_SCHEMA).parquet(f"{self.path}/terms").where(F.col("segment").isin(segments))

    def _blocks(self, *columns: str) -> DataFrame:
        return self._read_blocks().where(F.col("segment").isin(self.live)).select(*columns, "bucket")

    def document_keys(self) -> DataFrame:
        """(segment, range_no, doc, doc_key, len, chars): chars only as a sum per range, on its first document."""
        if not self.live:
            return self.spark.createDataFrame([], "segment string, range_no long, doc int, doc_key string, len int, chars long")
        rows = self._blocks("segment", "range_no", "keys", "lens", "chars").where(F.col("bucket") == KEYS)
        each = rows.select("segment", "range_no", "lens", "chars", F.posexplode("keys").alias("doc", "doc_key"))
        return each.select("segment", "range_no", "doc", "doc_key", F.element_at("lens", F.col("doc") + 1).alias("len"), F.when(F.col("doc") == 0, F.col("chars")).alias("chars"))

    def terms(self) -> DataFrame:
        """(tok, df, occurrences, idf) over all live segments."""
        n, _, floor = self.totals
        if not self.live:
            return self.spark.createDataFrame([], "tok string, df long, occurrences long, idf double")
        rows = self._read_terms(self.live).groupBy("tok").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))
        raw = _raw_idf(n)
        return rows.select("tok", "df", "occurrences", F.when(raw < 0, F.lit(floor)).otherwise(raw).alias("idf"))

    def postings(self) -> DataFrame:
        """(doc_key, tok, tf, first_pos), a row per document and token."""
        rows = self._blocks("segment", "range_no", "tok", "docs", "tfs", "positions").where(F.col("bucket") != KEYS)
        keys = self._blocks("segment", "range_no", "keys").where(F.col("bucket") == KEYS).drop("bucket")
        each = rows.join(keys, ["segment", "range_no"]).select("tok", "keys", F.explode(F.arrays_zip("docs", "tfs", "positions")).alias("p"))
        return each.select(F.element_at("keys", F.col("p.docs") + 1).alias("doc_key"), "tok", F.col("p.tfs").alias("tf"), F.element_at("p.positions", 1).alias("first_pos"))

    def token_summary(self) -> DataFrame:
        """(tok, docs, occurrences, earliest): documents, occurrences and smallest position of every token, from the postings."""
        rows = self._blocks("tok", "docs", "tfs", "positions").where(F.col("bucket") != KEYS)
        total = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
        earliest = F.array_min(F.transform("positions", lambda p: F.element_at(p, 1)))
        return rows.groupBy("tok").agg(F.sum(F.size("docs")).alias("docs"), F.sum(total).alias("occurrences"), F.min(earliest).alias("earliest"))

    def stats(self) -> DataFrame:
        """num_docs, total_chars, uploads, statics and num_tokens, as postings.index_stats gives them from texts."""
        rows = self._blocks("keys", "chars").where(F.col("bucket") == KEYS)
        starts = lambda prefix: F.sum(F.size(F.filter("keys", lambda key: key.startswith(prefix)))).alias("n")
        base = rows.agg(F.sum(F.size("keys")).alias("num_docs"), F.sum("chars").alias("total_chars"), starts("upload::").alias("uploads"), starts("static::").alias("statics"))
        return base.withColumn("num_tokens", self.terms().agg(F.count("*")).scalar())

    def _lists(self, asked: _Asked, *columns: str) -> DataFrame:
        """Rows of the tokens asked for, with their users; only the buckets of these tokens are read."""
        rows = self._blocks("segment", "range_no", "tok", *columns).where(F.col("bucket").isin(asked.buckets)).drop("bucket")
        return rows.join(F.broadcast(asked.users) if asked.small else asked.users, "tok")

    # --- ranking -------------------------------------------------------------
    def bm25(self, queries: DataFrame, k: int, k1: float = fv.BM25_K1, b: float = fv.BM25_B) -> DataFrame:
        """(query_id, doc_key, score, rank), the same rows as postings.bm25_scores over the indexed texts."""
        if not self.live:
            return self.spark.createDataFrame([], "query_id string, doc_key string, score double, rank int")
        n, _, floor = self.totals
        asked = _query_tokens(queries).groupBy("query_id", "tok").agg(F.count("*").alias("qtf"))
        counted = asked.join(self._read_terms(self.live), "tok").groupBy("query_id", "tok").agg(F.first("qtf").alias("qtf"), F.sum("df").alias("df"))
        raw = _raw_idf(n)
        weights = counted.select("query_id", "tok", (F.col("qtf") * F.when(raw < 0, F.lit(floor)).otherwise(raw)).alias("w"))
        return self._ranked(weights, k, lambda raw: F.round(raw, 4), (k1, b))

    def keyword_overlap(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_key, score, rank): distinct shared tokens, as postings.keyword_overlap over the indexed texts.

        All questions meet the lists of PART ranges at once and are counted there in bits (bit_counts). Lists are moved once, without
        their users; questions are not moved at all, every task has a copy of them, OVERLAP_ROWS tokens at a time. A task counts its
        parts one after the other and gives at most k rows a question, so what is written grows with questions and tasks, not with
        questions and parts. More questions are more passes, each finished before the next begins.
        """
        if not self.live:
            return self.spark.createDataFrame([], "query_id string, doc_key string, score double, rank int")
        asked = cut_lineage(_query_tokens(queries).distinct())
        numbers, buckets = self._numbers(asked.select("tok"))
        # parts are numbered over all segments and dealt out evenly
        part, parts = F.lit(0).cast("long"), 0
        for s in self.segments:
            if s["segment"]:
                part = F.when(F.col("segment") == s["segment"], F.floor(F.col("range_no") / PART) + parts).otherwise(part)
                parts += -(-s["ranges"] // PART)
        tasks = min(parts, max(1, int(TASKS_A_CORE * self.spark.sparkContext.defaultParallelism)))
        stored = self._blocks("segment", "range_no", "tok", "docs").where(F.col("bucket").isin(buckets))
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        lists = stored.join(numbers, "tok").select(part.alias("part"), "range_no", "no", "docs", none("array<string>", "keys"))
        lists = lists.unionByName(self._keys().select(part.alias("part"), "range_no", none("int", "no"), none("array<int>", "docs"), "keys"))
        dealt = lists.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part")
        wanted = asked.join(numbers, "tok").select("query_id", "no")
        found = []
        blocks = query_blocks(cut_lineage(wanted), "query_id", OVERLAP_ROWS)
        for block in blocks:
            met = dealt.mapInArrow(_counter(block.rows.groupBy("query_id").agg(F.collect_list("no").alias("nos")), k), "query_id string, doc_key string, score long")
            found.append(top_k(met, k) if len(blocks) == 1 else cut_lineage(top_k(met, k)))
        return union_all(found)

    def _numbers(self, toks: DataFrame) -> tuple[DataFrame, list[int]]:
        """(tok, no), a number for every stored one of the tokens, broadcast if they are few enough, and the buckets they are in."""
        known = toks.distinct().join(self._read_terms(self.live), "tok", "left_semi")
        numbers = cut_lineage(number_in_order(known, [], ["tok"], "no").select("tok", F.col("no").cast("int").alias("no"), self._bucket(F.col("tok")).alias("of")))
        n, buckets = numbers.agg(F.count("*"), F.collect_set("of")).first()  # at most as many numbers as the index has buckets
        numbers = numbers.drop("of")
        return F.broadcast(numbers) if n <= BROADCAST_ROWS else numbers, buckets

    def _ranked(self, weights: DataFrame, k: int, score, saturation: tuple[float, float]) -> DataFrame:
        if not self.live:
            return self.spark.createDataFrame([], "query_id string, doc_key string, score double, rank int")
        hits = [self._walk(asked, k, score, saturation) for asked in self._asked(weights, ["w"])]
        return union_all(hits)

    def _asked(self, rows: DataFrame, fields: list[str]) -> list[_Asked]:
        """Query rows (query_id, tok, *fields) by token, in blocks of about QUERY_ROWS rows, usually one."""
        users = F.collect_list(F.struct("query_id", *fields)).alias("users")
        by_token = lambda part: cut_lineage(part.groupBy("tok").agg(users).withColumn("bucket", self._bucket(F.col("tok"))))
        whole = by_token(rows)
        size, buckets = whole.agg(F.sum(F.size("users")), F.collect_set("bucket")).first()  # at most as many numbers as the index has buckets
        if (size or 0) <= QUERY_ROWS:
            return [_Asked(whole.select("tok", "users"), buckets, True)]
        return [_Asked(by_token(block.rows).select("tok", "users"), buckets, block.small) for block in query_blocks(rows, "query_id", QUERY_ROWS)]

    def _walk(self, asked: _Asked, k: int, score, saturation: tuple[float, float]) -> DataFrame:
        """Exact top k of a block of queries, scoring only ranges that can still hold one of them.

        Bounds come from impact points, without postings. The ranges with the
        best bounds are scored first; the k-th score found there is a threshold
        below the final one, and ranges bounded below it are never scored.
        Inside a range the lists are added in order of their bounds, and a query
        stops where the lists left cannot lift any document over the threshold.
        """
        points = F.transform(F.arrays_zip("impact_tf", "impact_len"), lambda p: self._impact(p["impact_tf"], p["impact_len"], saturation))
        light = self._lists(asked, "impact_tf", "impact_len").select("segment", "range_no", F.array_max(points).alias("top"), F.explode("users").alias("u"))
        bound = F.sum(F.greatest(F.lit(0.0), F.col("u.w") * F.col("top")))
        # a query with a negative weight has no lower bound from partial sums: all its ranges are scored in full
        free = F.min("u.w") < 0
        ranges = light.groupBy(F.col("u.query_id").alias("query_id"), "segment", "range_no").agg(bound.alias("bound"), free.alias("free"))
        by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range_no")
        ranges = cut_lineage(ranges.withColumn("place", F.row_number().over(by_bound)).withColumn("any_free", F.max("free").over(Window.partitionBy("query_id"))))
        lowest = F.lit(float("-inf"))
        first = cut_lineage(self._score(asked, ranges.where(F.col("place") <= SEEDS).withColumn("theta", lowest), k, saturation))
        best = Window.partitionBy("query_id").orderBy(F.desc("raw"))
        floor = first.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("query_id", (F.col("raw") - ROUNDING).alias("theta"))
        rest = ranges.where(F.col("place") > SEEDS).join(floor, "query_id", "left")
        rest = rest.withColumn("theta", F.when(F.col("any_free"), lowest).otherwise(F.coalesce("theta", lowest))).where(F.col("bound") >= F.col("theta"))
        found = first.unionByName(self._score(asked, rest, k, saturation)).withColumn("score", score(F.col("raw")))
        near = found.withColumn("at", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("at") <= k)
        named = near.join(self._keys(), ["segment", "range_no"])
        return top_k(named.select("query_id", F.element_at("keys", F.col("doc") + 1).alias("doc_key"), "score"), k)

    def _keys(self) -> DataFrame:
        return self._blocks("segment", "range_no", "keys").where(F.col("bucket") == KEYS).drop("bucket")

    def _impact(self, tf: Column, length: Column, saturation: tuple[float, float]) -> Column:
        k1, b = saturation
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / self.totals.avgdl))

    def _score(self, asked: _Asked, pairs: DataFrame, k: int, saturation: tuple[float, float]) -> DataFrame:
        """(query_id, segment, range_no, doc, raw) of the pairs (query_id, segment, range_no, theta): at least all documents that can be among the k best."""
        pairs = pairs.select("query_id", "segment", "range_no", "theta")
        # an inner join with distinct ranges, not a semi join: that one would be moved below the token join and exchange whole buckets
        lists = self._lists(asked, "docs", "tfs", "lens").join(pairs.select("segment", "range_no").distinct(), ["segment", "range_no"])
        avgdl = self.totals.avgdl

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return _score_range(key, left, right, k, saturation, avgdl)

        cogrouped = lists.groupBy("segment", "range_no").cogroup(pairs.groupBy("segment", "range_no"))
        return cogrouped.applyInArrow(run, "query_id string, segment string, range_no long, doc int, raw double")

    # --- phrases ---------------------------------------------------------------
    def phrase_search(self, queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_key, hit_pos, rank), the same rows as postings.phrase_search over the indexed texts.

        The rarest whole tokens of a phrase must stand at their distances, which
        positions tell; a phrase of one or two tokens, cut at its ends, is looked up by the
        stored tokens its ends can be part of. What is left, separators and cut
        ends, is tested in the texts of the first candidates by key, until a
        query has k hits or no candidates. Candidates are broadcast to the
        texts, so no text is exchanged. Only phrases without any token read the
        texts from the start. Empty phrases match nothing.
        """
        phrases = cut_lineage(queries.select("query_id", F.lower("text").alias("phrase")).where("phrase <> ''"))
        toks = F.regexp_extract_all("phrase", F.lit(fv.WORD_PATTERN), F.lit(0))
        cut_start, cut_end = (F.col("phrase").rlike(p).cast("int") for p in ("^[a-z0-9£]", "[a-z0-9£]$"))
        shaped = phrases.select("query_id", "phrase", toks.alias("toks"), cut_start.alias("cut_start"), cut_end.alias("cut_end"))
        inner = F.slice("toks", F.col("cut_start") + 1, F.greatest(F.lit(0), F.size("toks") - F.col("cut_start") - F.col("cut_end")))
        shaped = shaped.withColumn("inner", inner)
        runs = self._rarest(posexplode_rows(shaped, ["query_id"], F.col("inner"), "place", "tok"))
        short = shaped.where((F.size("inner") == 0) & (F.size("toks") > 0))
        kind = F.when(F.size("toks") == 1, F.when((F.col("cut_start") == 1) & (F.col("cut_end") == 1), "inside").when(F.col("cut_start") == 1, "head").otherwise("tail"))
        ends = short.select("query_id", F.posexplode("toks").alias("place", "anchor"), kind.alias("only")).withColumn(
            "kind", F.coalesce("only", F.when(F.col("place") == 0, "head").otherwise("tail"))).drop("only")
        if not ends.isEmpty():
            runs = runs.unionByName(edge_tokens(ends, self.terms().select("tok")).select("query_id", "place", "tok"))
        found = self.phrase_documents(runs).join(phrases, "query_id")
        by_key = Window.partitionBy("query_id").orderBy("doc_key")
        candidates = cut_lineage(found.withColumn("place", F.row_number().over(by_key)))
        hits = self._verified(candidates, texts, k)
        marks = shaped.where(F.size("toks") == 0).select("query_id", F.col("phrase").alias("text"))
        if not marks.isEmpty():
            hits = hits.unionByName(scan_phrases(marks, texts, k).select("query_id", "doc_key", "hit_pos"))
        return hits.withColumn("rank", F.row_number().over(by_key)).where(F.col("rank") <= k)

    def _rarest(self, runs: DataFrame) -> DataFrame:
        """The LOOKUPS places of every run (query_id, place, tok) whose tokens fewest documents hold, in all segments together; a run with
        an unknown token has no rows, as no text can hold it."""
        if not self.live:
            return runs.where("1 = 0")
        known = runs.join(self._read_terms(self.live), "tok", "left").groupBy("query_id", "place", "tok").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df"))
        by_df = Window.partitionBy("query_id").orderBy("df", "place")
        rare = known.withColumn("at", F.row_number().over(by_df)).withColumn("least", F.min("df").over(Window.partitionBy("query_id")))
        return rare.where((F.col("at") <= LOOKUPS) & (F.col("least") > 0)).select("query_id", "place", "tok")

    def _verified(self, candidates: DataFrame, texts: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_key, hit_pos) of the first k candidates (query_id, phrase, doc_key, place) whose text holds the phrase."""
        low = texts.select("doc_key", F.lower("text").alias("low"))
        done, width, hits = 0, 4 * k, []
        open_rows = candidates
        while not hits or not open_rows.isEmpty():
            batch = cut_lineage(open_rows.where(F.col("place") <= done + width))
            for block in query_blocks(batch, "doc_key", QUERY_ROWS):
                near = low.join(block.hint(block.rows), "doc_key").where(F.contains("low", F.col("phrase")))
                hits.append(cut_lineage(near.select("query_id", "doc_key", (F.position("phrase", "low") - 1).alias("hit_pos"))))
            done, width = done + width, width * 4
            full = union_all(hits).groupBy("query_id").count().where(F.col("count") >= k)
            open_rows = candidates.where(F.col("place") > done).join(full, "query_id", "left_anti")
        return union_all(hits)

    def phrase_documents(self, runs: DataFrame) -> DataFrame:
        """(query_id, doc_key) of the documents with a token of every place of a run (query_id, place, tok) at these distances.

        A place may have several tokens. In each range the lists
        are intersected on position minus place, from the shortest list up; a
        range that lacks a place is left at once. Lists are moved without their
        users: every task has a copy of the runs, RUN_ROWS rows at a time.
        """
        if not self.live:
            return self.spark.createDataFrame([], "query_id string, doc_key string")
        sized = cut_lineage(runs.withColumn("size", F.size(F.collect_set("place").over(Window.partitionBy("query_id")))))
        numbers, buckets = self._numbers(sized.select("tok"))
        stored = self._blocks("segment", "range_no", "tok", "docs", "tfs", "positions").where(F.col("bucket").isin(buckets))
        groups = stored.join(numbers, "tok").select("segment", "range_no", "no", "docs", "tfs", F.flatten("positions").alias("deltas")).groupBy("segment", "range_no")
        out = []
        blocks = query_blocks(cut_lineage(sized.join(numbers, "tok").select("query_id", "place", "size", "no")), "query_id", RUN_ROWS)
        for block in blocks:
            found = groups.applyInArrow(_intersecter(block.rows), "query_id string, segment string, range_no long, doc int")
            named = found.join(self._keys(), ["segment", "range_no"]).select("query_id", F.element_at("keys", F.col("doc") + 1).alias("doc_key"))
            out.append(named if len(blocks) == 1 else cut_lineage(named))
        return union_all(out)


class _Asked(NamedTuple):
    users: DataFrame  # (tok, users): the query rows of each token
    buckets: list[int]
    small: bool


def _query_tokens(queries: DataFrame) -> DataFrame:
    return explode_rows(queries, ["query_id"], word_tokens(F.col("text")), "tok")


def _blocks_of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (range_no, doc_key, chars, toks), ordered by range and key, to the rows of every range."""
    held, at = [], None
    for batch in batches:
        for number, rows in _groups(batch["range_no"].to_numpy()):
            if held and number != at:
                yield from _range_rows(at, held)
                held = []
            held.append(batch.slice(rows.start, rows.stop - rows.start))
            at = number
    if held:
        yield from _range_rows(at, held)


def _range_rows(number: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range from its documents."""
    docs = pa.Table.from_batches(batches).combine_chunks()
    keys, chars = (docs[c].combine_chunks() for c in ("doc_key", "chars"))
    toks = docs["toks"].combine_chunks()
    lens = pc.list_value_length(toks).to_numpy(zero_copy_only=False)
    null = np.isnan(lens) if lens.dtype.kind == "f" else np.zeros(len(lens), dtype=bool)
    own = np.where(null, 0, lens).astype(np.int64)
    stored = pa.array(own.astype(np.int32), mask=null)
    encoded = toks.flatten().dictionary_encode()
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    code, doc = encoded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(own), dtype=np.int32), own)
    at = (np.arange(len(code)) - np.repeat(np.cumsum(own) - own, own)).astype(np.int32)
    order = np.argsort(code, kind="stable")  # documents and positions ascend already
    code, doc, at = code[order], doc[order], at[order]
    fresh = np.append(True, (np.diff(doc) != 0) | (np.diff(code) != 0))[: len(code)]
    deltas = np.where(fresh, at, np.diff(at, prepend=np.int32(0))).astype(np.int32)
    first = np.flatnonzero(fresh)  # of every posting
    tf = np.diff(np.append(first, len(code)))
    yield from _packed_rows(number, keys, stored, pc.sum(chars).as_py() or 0, encoded.dictionary, code[first], doc[first], tf, deltas)


def _packed_rows(number: int, keys: pa.Array, lens: pa.Array, chars: int, toks: pa.Array, of_tok: np.ndarray, posted: np.ndarray, tf: np.ndarray, deltas: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The row of keys of a range and one row per token, TOKENS_AT_ONCE occurrences or one longer row at a time. Postings (number of the
    token, document, count) are ordered by token and document, and so are their deltas."""
    whole = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
    schema = pa.schema([("range_no", pa.int64()), ("tok", pa.string()), *((c, pa.list_(pa.int32())) for c in ("docs", "tfs", "lens")), ("positions", pa.list_(pa.list_(pa.int32()))),
                        *((c, pa.list_(pa.int32())) for c in ("impact_tf", "impact_len")), ("keys", pa.list_(pa.string())), ("chars", pa.int64())])

    def rows(**columns) -> pa.RecordBatch:
        size = len(columns["tok"])
        columns["range_no"] = pa.array(np.full(size, number, dtype=np.int64))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    yield rows(tok=pa.array([""]), docs=whole(pa.array(np.arange(len(keys))), pa.int32()), lens=whole(lens, pa.int32()), keys=whole(keys, pa.string()), chars=pa.array([chars]))
    if not len(of_tok):
        return
    length = lens.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[posted]
    starts = np.append(np.flatnonzero(np.diff(of_tok, prepend=-1)), len(of_tok))  # postings of every token
    by = np.lexsort((length, tf, of_tok))  # the shortest length of every count comes first
    best = by[np.append(True, (np.diff(tf[by]) != 0) | (np.diff(of_tok[by]) != 0))]
    points = np.append(np.searchsorted(of_tok[best], of_tok[starts[:-1]]), len(best))
    opened = np.append(0, np.cumsum(tf))  # occurrences of every posting
    stretch = opened[starts[:-1]] // TOKENS_AT_ONCE
    for _, part in _groups(stretch):
        p, own_points = starts[part.start : part.stop + 1], points[part.start : part.stop + 1]
        inside, near = slice(p[0], p[-1]), slice(own_points[0], own_points[-1])
        listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), values)
        numbers = lambda values: pa.array(values.astype(np.int32))
        places = listed(opened[p[0] : p[-1] + 1], numbers(deltas[opened[p[0]] : opened[p[-1]]]))
        yield rows(tok=toks.take(pa.array(of_tok[p[:-1]])), docs=listed(p, numbers(posted[inside])), tfs=listed(p, numbers(tf[inside])), lens=listed(p, numbers(length[inside])),
                   positions=listed(p, places), impact_tf=listed(own_points, numbers(tf[best[near]])), impact_len=listed(own_points, numbers(length[best[near]])))


def _mover(names: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From names (segment, range_no, doc, new_range, new_doc), a function that cuts stored rows (segment, range_no, tok, docs, positions)
    into pieces, one for every new range that documents of a row go to, packed by range (MOVED_SCHEMA)."""
    place = F.struct("doc", F.col("new_range").cast("int").alias("to"), F.col("new_doc").cast("int").alias("no"))
    ranges = names.groupBy("segment", "range_no").agg(F.sort_array(F.collect_list(place)).alias("places"))
    each = lambda name: F.transform("places", lambda p: p[name]).alias(name)
    rows = ranges.select("segment", "range_no", each("to"), each("no")).toArrow()
    (offsets, to), (_, no) = _flat_list(rows["to"]), _flat_list(rows["no"])
    firsts: dict[str, np.ndarray] = {}  # by segment: of every range, its first entry in to and no
    for segment in pc.unique(rows["segment"]).to_pylist():
        mine = np.flatnonzero(pc.equal(rows["segment"], segment).to_numpy())
        numbers = rows["range_no"].to_numpy()[mine]
        firsts[segment] = np.zeros(numbers.max() + 1, dtype=np.int64)
        firsts[segment][numbers] = offsets[mine]
    plain = lambda values: values.to_numpy(zero_copy_only=False).astype(np.int32)
    shared = names.sparkSession.sparkContext.broadcast((firsts, plain(to), plain(no)))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, to, no = shared.value
        for batch in batches:
            first = np.zeros(batch.num_rows, dtype=np.int64)
            for segment in pc.unique(batch["segment"]).to_pylist():
                mine = pc.equal(batch["segment"], segment).to_numpy(zero_copy_only=False)
                first[mine] = firsts[segment][batch["range_no"].to_numpy()[mine]]
            if batch.num_rows:
                yield _pieces(batch, first, to, no)

    return move


def _pieces(rows: pa.RecordBatch, first: np.ndarray, to: np.ndarray, no: np.ndarray) -> pa.RecordBatch:
    """Pieces (tok, docs, tfs, deltas) of stored rows by new range, compressed; document d of row i goes to range to[first[i] + d] as
    number no[first[i] + d]."""
    offsets, docs = _flat_list(pa.chunked_array([rows["docs"]]))
    opened, deltas = _flat_list(pa.chunked_array([_flat_list(pa.chunked_array([rows["positions"]]))[1]]))
    own, tf = np.diff(offsets), np.diff(opened).astype(np.int64)
    row, entry = np.repeat(np.arange(rows.num_rows), own), np.repeat(first, own) + docs.to_numpy(zero_copy_only=False)
    order = np.lexsort((row, to[entry]))
    row, entry, tf, begin = row[order], entry[order], tf[order], opened[:-1][order].astype(np.int64)
    starts = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(to[entry]) != 0))[: len(row)])
    bounds, ends = np.append(starts, len(row)), np.append(0, np.cumsum(tf))
    listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))
    toks = rows["tok"].cast(pa.string()).take(pa.array(row[starts]))
    pieces = pa.table({"tok": toks, "docs": listed(bounds, no[entry]), "tfs": listed(bounds, tf), "deltas": listed(ends[bounds], deltas.to_numpy(zero_copy_only=False)[spans(begin, tf)])})
    numbers, packed = [], []
    for number, part in _groups(to[entry[starts]]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pieces.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pieces.slice(part.start, part.stop - part.start))
        numbers.append(number)
        packed.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(packed, pa.binary())], names=["range_no", "pieces"])


def _merged_range(key: tuple, moved: pa.Table, names: pa.Table) -> pa.Table:
    """The rows of a new range from the pieces of stored rows (MOVED_SCHEMA) and the names of its documents (doc, len, doc_key, chars)."""
    names = names.sort_by("doc").combine_chunks()
    whole = lambda name: names[name].combine_chunks()
    toks, code, docs, tf, deltas = pa.array([], pa.string()), *(np.zeros(0, dtype=np.int64) for _ in range(4))
    if moved.num_rows:
        rows = pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in moved["pieces"]]).combine_chunks()
        encoded = rows["tok"].combine_chunks().dictionary_encode()
        offsets, docs = _flat_list(rows["docs"])
        docs, tf, deltas = (x.to_numpy(zero_copy_only=False) for x in (docs, _flat_list(rows["tfs"])[1], _flat_list(rows["deltas"])[1]))
        toks, code, tf = encoded.dictionary, np.repeat(encoded.indices.to_numpy(zero_copy_only=False), np.diff(offsets)), tf.astype(np.int64)
        order = np.lexsort((docs, code))
        deltas = deltas[spans((np.cumsum(tf) - tf)[order], tf[order])]
        code, docs, tf = code[order], docs[order], tf[order]
    return pa.Table.from_batches(list(_packed_rows(key[0].as_py(), whole("doc_key"), whole("len").cast(pa.int32()), pc.sum(names["chars"]).as_py() or 0, toks, code, docs, tf, deltas)))


def _flat_list(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column in one piece."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    if not len(whole):
        return np.zeros(1, dtype=np.int32), whole.flatten()
    return whole.offsets.to_numpy() - whole.offsets[0].as_py(), whole.flatten()


def _user_rows(users: pa.ChunkedArray, wanted: list[str], *fields: str) -> tuple[np.ndarray, ...]:
    """For the wanted queries' entries in the lists of users, in order of the query: place of the query in wanted, row, and the fields."""
    offsets, values = _flat_list(users)
    query = pc.index_in(values.field("query_id"), pa.array(wanted, pa.string())).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    known = np.flatnonzero(~np.isnan(query)) if query.dtype.kind == "f" else np.arange(len(query))
    query = query[known].astype(np.int64)
    order = np.argsort(query, kind="stable")
    known = known[order]
    return (query[order], rows[known], *(values.field(f).to_numpy(zero_copy_only=False)[known] for f in fields))


def _groups(sorted_numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Every number of a sorted array with the stretch it fills."""
    if len(sorted_numbers):
        cuts = [0, *(np.flatnonzero(np.diff(sorted_numbers)) + 1).tolist(), len(sorted_numbers)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield int(sorted_numbers[lo]), slice(lo, hi)


def _score_range(key: tuple, lists: pa.Table, pairs: pa.Table, k: int, saturation: tuple[float, float], avgdl: float) -> pa.Table:
    asked, theta = pairs["query_id"].to_pylist(), pairs["theta"].to_numpy()
    out_q, out_doc, out_raw = [], [], []
    if len(asked) and lists.num_rows:
        offsets, docs = _flat_list(lists["docs"])
        docs = docs.to_numpy(zero_copy_only=False)
        k1, b = saturation
        tfs, lens = (_flat_list(lists[c])[1].to_numpy(zero_copy_only=False) for c in ("tfs", "lens"))
        impact = tfs * (k1 + 1) / (tfs + k1 * (1 - b + b * lens / avgdl))
        tops, size = np.maximum.reduceat(impact, offsets[:-1]), int(docs.max()) + 1
        starts, ends = offsets[:-1].tolist(), offsets[1:].tolist()

        def add(rows: list[int], weights: list[float]) -> np.ndarray:
            at = np.concatenate([docs[starts[r] : ends[r]] for r in rows])
            return np.bincount(at, np.concatenate([w * impact[starts[r] : ends[r]] for r, w in zip(rows, weights)]), minlength=size)

        queries, rows, weights = _user_rows(lists["users"], asked, "w")
        for q, own in _groups(queries):
            bound = np.maximum(0.0, weights[own] * tops[rows[own]])
            order = np.argsort(-bound, kind="stable")
            mine, w, left = rows[own][order].tolist(), weights[own][order].tolist(), np.cumsum(bound[order][::-1])[::-1]
            need = theta[q]
            if left[0] < need:
                continue
            # lists that alone cannot lift a document over the threshold come second, and only if some document is near it
            essential = int(np.count_nonzero(left >= need))
            total = add(mine[:essential], w[:essential])
            if essential < len(mine):
                if total.max() + left[essential] < need:
                    continue
                total += add(mine[essential:], w[essential:])
            if need == -np.inf or min(w) <= 0:
                seen = np.zeros(size, dtype=bool)
                seen[np.concatenate([docs[starts[r] : ends[r]] for r in mine])] = True
                found = np.flatnonzero(seen & (total >= need))
            else:
                found = np.flatnonzero(total >= max(need, np.nextafter(0, 1)))
            found, raw = best_rows(found, total, k)
            out_q += [asked[q]] * len(found)
            out_doc.append(found)
            out_raw.append(raw)
    flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, dtype=kind)
    return _found(key, out_q, flat(out_doc, np.int32), raw=pa.array(flat(out_raw, np.float64), pa.float64()))


def _counter(questions: DataFrame, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that counts the questions (query_id, nos) in lists (part, range_no, no, docs) and keys (part, range_no, keys) ordered by
    part, and gives the k best documents of all its parts for every question."""
    rows = questions.toArrow()
    offsets, nos = _flat_list(rows["nos"])
    ids = pa.concat_arrays([c.cast(pa.string()) for c in rows["query_id"].chunks] or [pa.array([], pa.string())])
    shared = questions.sparkSession.sparkContext.broadcast((ids, offsets, nos.to_numpy(zero_copy_only=False)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offsets, nos = shared.value
        best = _Best(k)
        for part in _parts(batches):
            best.add(*_overlap_of_part(part, offsets, nos, k))
        if len(best.query):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.query)), best.keys, pa.array(best.score, pa.int64())], names=["query_id", "doc_key", "score"])

    return count


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of every part, of batches ordered by part."""
    held, at = [], None
    for batch in batches:
        for number, rows in _groups(batch["part"].to_numpy()):
            if held and number != at:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(rows.start, rows.stop - rows.start))
            at = number
    if held:
        yield pa.Table.from_batches(held)


class _Best:
    """The k best documents of every question so far: those of highest score, among equal ones the first by key."""

    def __init__(self, k: int):
        self.k, self.query, self.score, self.keys = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), pa.array([], pa.string())

    def add(self, query: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        query, score = np.append(self.query, query), np.append(self.score, score)
        keys = pa.concat_arrays([self.keys, keys])
        names = keys.dictionary_encode()
        order = pc.array_sort_indices(names.dictionary, null_placement="at_start").to_numpy()
        places = np.empty(len(order), dtype=np.int64)
        places[order] = np.arange(len(order))
        code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.where(code < 0, -1, places[code]) if len(order) else code
        ranked = np.lexsort((place, -score, query))
        query = query[ranked]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.query, self.score, self.keys = query[kept], score[ranked[kept]], keys.take(pa.array(ranked[kept]))


def _overlap_of_part(lists: pa.Table, offsets: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(question, score, key) of the k best documents of a part for every question, from its lists (range_no, no, docs) and the keys of its
    ranges; question q has the tokens asked[offsets[q] : offsets[q + 1]]."""
    empty = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), pa.array([], pa.string())
    names, lists = (lists.filter(pc.is_valid(lists[c])) for c in ("keys", "docs"))
    if not names.num_rows or not lists.num_rows or not len(asked):
        return empty
    names = names.sort_by("range_no")
    opened, keys = _flat_list(names["keys"])
    by_key = pc.array_sort_indices(keys, null_placement="at_start").to_numpy()
    place = np.empty(len(keys), dtype=np.int32)
    place[by_key] = np.arange(len(keys), dtype=np.int32)
    starts, docs = _flat_list(lists["docs"])
    own = np.diff(starts)
    start = opened[np.searchsorted(names["range_no"].to_numpy(), lists["range_no"].to_numpy())]
    doc = place[np.repeat(start, own) + docs.to_numpy(zero_copy_only=False)]
    toks, tok = np.unique(lists["no"].to_numpy(), return_inverse=True)
    words = -(-len(keys) // 64)
    rows = bit_rows(np.repeat(tok.astype(np.int32), own), doc, len(toks), words)
    at = np.minimum(np.searchsorted(toks, asked), len(toks) - 1)
    here = toks[at] == asked
    out = list(best_shared(at[here], np.append(0, np.cumsum(here))[offsets], rows, words, k))
    if not out:
        return empty
    query, best, score = (np.concatenate(part) for part in zip(*out))
    return query, score, keys.cast(pa.string()).take(pa.array(by_key[best]))


def _found(key: tuple, queries: list[str], docs: np.ndarray | list[int], **more: pa.Array) -> pa.Table:
    return pa.table({"query_id": pa.array(queries, pa.string()), "segment": pa.array([key[0].as_py()] * len(queries), pa.string()),
                     "range_no": pa.array([key[1].as_py()] * len(queries), pa.int64()), "doc": pa.array(docs, pa.int32()), **more})


def _intersecter(runs: DataFrame) -> Callable[[tuple, pa.Table], pa.Table]:
    """A function that gives the documents of a range, from its lists (no, docs, tfs, deltas), that hold runs (query_id, place, size, no)."""
    rows = runs.toArrow()
    ids = pa.concat_arrays([c.cast(pa.string()) for c in rows["query_id"].chunks] or [pa.array([], pa.string())]).dictionary_encode(null_encoding="encode")
    query, place, size, no = ids.indices.to_numpy(), *(rows[c].to_numpy() for c in ("place", "size", "no"))
    order = np.lexsort((no, place, query))
    query, place, size, no = (x[order].astype(np.int32) for x in (query, place, size, no))
    starts = np.flatnonzero(np.append(True, np.diff(query) != 0)[: len(query)])  # of every query
    places = np.flatnonzero(np.append(True, (np.diff(query) != 0) | (np.diff(place) != 0))[: len(query)])
    shared = runs.sparkSession.sparkContext.broadcast((ids.dictionary, place, size[starts], no, np.append(starts, len(query)), places, np.searchsorted(places, starts)))
    return lambda key, lists: _intersect_range(key, lists, *shared.value)


def _intersect_range(key: tuple, rows: pa.Table, ids: pa.Array, place: np.ndarray, size: np.ndarray, no: np.ndarray, starts: np.ndarray, places: np.ndarray, first_place: np.ndarray) -> pa.Table:
    """Runs are ordered by query and place: those of query q lie at starts[q] : starts[q + 1], its places begin at places[first_place[q]] and on."""
    if not len(no) or not rows.num_rows:
        return _found(key, [], [])
    offsets, docs = _flat_list(rows["docs"])
    docs, own, deltas = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (docs, _flat_list(rows["tfs"])[1], _flat_list(rows["deltas"])[1]))
    opened, sums = np.append(0, np.cumsum(own)), np.cumsum(deltas)
    base = sums[opened[:-1]] - deltas[opened[:-1]]  # every posting has a position
    keyed = (np.repeat(docs, own) << 32) + sums - np.repeat(base, own)
    bounds = opened[offsets].tolist()
    toks = rows["no"].to_numpy()
    by_tok = np.argsort(toks, kind="stable")
    at = np.minimum(np.searchsorted(toks, no, sorter=by_tok), len(toks) - 1)
    row = by_tok[at]
    here = toks[row] == no
    held = np.add.reduceat(np.logical_or.reduceat(here, places).astype(np.int32), first_place)
    out_q, out_doc = [], []
    for q in np.flatnonzero(held == size).tolist():
        mine = slice(starts[q], starts[q + 1])
        by_place: dict[int, list] = {}
        for r, p, stored in zip(row[mine].tolist(), place[mine].tolist(), here[mine].tolist()):
            if stored:
                by_place.setdefault(p, []).append((r, p))
        width = lambda parts: sum(bounds[r + 1] - bounds[r] for r, _ in parts)
        alive = None
        for parts in sorted(by_place.values(), key=width):
            at = np.concatenate([keyed[bounds[r] : bounds[r + 1]] - p for r, p in parts])
            alive = at if alive is None else alive[np.isin(alive, at)]
            if not len(alive):
                break
        found = np.unique(alive >> 32)
        # a start before its text falls to the text before it, which can only make a candidate more
        found = found[found >= 0]
        out_q += [ids[q].as_py()] * len(found)
        out_doc += found.tolist()
    return _found(key, out_q, out_doc)
