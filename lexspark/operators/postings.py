"""Postings, BM25, keyword overlap and phrase search: query table x corpus table.

Corpora are (doc_key, text), queries are (query_id, text). The corpus side is
never broadcast and its text is never shuffled for ranking: ranking works on
(doc_key, token) rows, and text joins back for the few ranked rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexspark import fixed_values as fv
from lexspark.functions.text import word_tokens
from lexspark.operators.ranking import top_k
from lexspark.operators.sizing import Block, query_blocks, union_all
from lexspark.session import cut_lineage
from lexspark.operators.rows import explode_rows, posexplode_rows

SCAN_ROWS = 500_000  # (query, token) rows that every task of a scan holds
ROUNDING = 1e-4  # scores are compared after rounding to four places


def build_postings(docs: DataFrame, vocabulary_cap: int | None = None) -> DataFrame:
    """(doc_key, tok, tf, first_pos). The optional cap keeps the first distinct
    tokens of each document; the default indexes whole texts."""
    words = posexplode_rows(docs, ["doc_key"], word_tokens(F.col("text")), "pos", "tok")
    grouped = words.groupBy("doc_key", "tok").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))
    if vocabulary_cap is None:
        return grouped
    w = Window.partitionBy("doc_key").orderBy("first_pos")
    return grouped.withColumn("n", F.row_number().over(w)).where(F.col("n") <= vocabulary_cap).drop("n")


def corpus_stats(docs: DataFrame) -> DataFrame:
    lengths = docs.select(F.size(word_tokens(F.col("text"))).alias("n"))
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("n").alias("avgdl"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """One row per token; distinct within the row first, so the shuffle only
    carries map-side combined counts."""
    words = explode_rows(docs, [], F.array_distinct(word_tokens(F.col("text"))), "tok")
    return words.groupBy("tok").agg(F.count("*").alias("df"))


class Bm25Index(NamedTuple):
    terms: DataFrame  # (tok, df, idf)
    n_docs: Column
    avgdl: Column


def bm25_index(docs: DataFrame, epsilon: float = fv.BM25_EPSILON) -> Bm25Index:
    """Statistics of a corpus from one pass over its texts.

    Every document adds one row per distinct token and one row without a token
    that carries its length, so document count, average length and document
    frequencies come out of a single aggregation. The result (one row per
    vocabulary token) is materialised because ranking uses it several times.
    Tokens in over half of the documents get epsilon x the mean idf.
    """
    toks = docs.select(word_tokens(F.col("text")).alias("toks"))
    entries = F.array_append(F.array_distinct("toks"), F.lit(None).cast("string"))
    rows = toks.select(F.size("toks").alias("n"), entries.alias("entries")).select("n", F.explode_outer("entries").alias("tok"))
    total = F.sum(F.when(F.col("tok").isNull(), F.col("n")))
    counted = cut_lineage(rows.groupBy("tok").agg(F.count("*").alias("df"), total.alias("total_len")))
    totals = counted.where("tok IS NULL")
    n = totals.select("df").scalar()
    avgdl = totals.select((F.col("total_len") / F.col("df")).alias("avgdl")).scalar()
    raw = counted.where("tok IS NOT NULL").select(
        "tok", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((F.avg("raw") * epsilon).alias("f")).scalar()
    terms = raw.select("tok", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(terms, n, avgdl)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, tok, qtf): repeated query tokens count as often as they occur."""
    words = explode_rows(queries, ["query_id"], word_tokens(F.col("text")), "tok")
    return words.groupBy("query_id", "tok").agg(F.count("*").alias("qtf"))


def _score_documents(tokens: DataFrame, block: Block, k: int, saturation: tuple[float, float, float] | None) -> DataFrame:
    """(query_id, doc_key, raw): at least all documents that can be among the k
    best of a query by the sum of w x impact over shared tokens.

    Tasks hold the block's query rows (SCAN_ROWS at most, unless one query alone
    has more). Tokens outside their vocabulary are dropped and the others
    counted in the scan, so a document crosses the network as one short row.
    Rows of one key meet there; scores are summed a batch of documents at a time
    and only those that can still be among the k best leave the task, so
    (query, document) pairs are never rows.
    """
    spark = tokens.sparkSession
    terms = block.rows.select("query_id", "tok", F.col("w").cast("double").alias("w")).toArrow()
    names, vocabulary = pc.unique(terms["query_id"]), pc.unique(terms["tok"])
    asked = pc.index_in(terms["query_id"], names).to_numpy().astype(np.int64)
    order = np.argsort(asked, kind="stable")
    rows = pc.index_in(terms["tok"], vocabulary).to_numpy().astype(np.int64)[order]
    shared = spark.sparkContext.broadcast((names, vocabulary, asked[order], rows, terms["w"].to_numpy()[order]))
    kind = lambda df, name: df.schema[name].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value[1]
        for batch in batches:
            lists = batch["toks"]
            doc = pc.list_parent_indices(lists).to_numpy()
            tok = pc.index_in(lists.flatten(), vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = tok >= 0
            pair, tf = np.unique(doc[known] * len(vocabulary) + tok[known], return_counts=True)
            if len(pair):
                doc, first = np.unique(pair // len(vocabulary), return_index=True)
                offsets = pa.array(np.append(first, len(pair)).astype(np.int32))
                listed = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch["doc_key"].take(pa.array(doc)), batch["doc_len"].take(pa.array(doc)), listed(pair % len(vocabulary)), listed(tf)],
                                                 ["doc_key", "doc_len", "toks", "tfs"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _, asked, rows, weights = shared.value
        theta = np.full(len(names), -np.inf)
        for keys, doc_len, doc, tok, tf in _documents(batches):
            if saturation is None:
                impact = tf.astype(np.float64)
            else:
                k1, b, avgdl = saturation
                impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len[doc] / avgdl))
            by_tok = np.argsort(tok, kind="stable")
            tok, doc, impact = tok[by_tok], doc[by_tok], impact[by_tok]
            starts, ends = np.searchsorted(tok, rows, side="left"), np.searchsorted(tok, rows, side="right")
            held = np.flatnonzero(ends > starts)
            cuts = np.append(np.flatnonzero(np.diff(asked[held], prepend=-1)), len(held))
            found = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                q, own = asked[held[lo]], held[lo:hi]
                at = np.concatenate([doc[starts[r] : ends[r]] for r in own])
                total = np.bincount(at, np.concatenate([weights[r] * impact[starts[r] : ends[r]] for r in own]), minlength=len(keys))
                near = total >= theta[q]
                if theta[q] <= 0 or weights[own].min() <= 0:
                    seen = np.zeros(len(keys), dtype=bool)
                    seen[at] = True
                    near &= seen
                best, raw = best_rows(np.flatnonzero(near), total, k)
                if len(best) >= k:
                    theta[q] = max(theta[q], raw[k - 1] - ROUNDING)
                found.append((np.full(len(best), q), best, raw))
            if found:
                q, best, raw = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), keys.take(pa.array(best)), pa.array(raw)], ["query_id", "doc_key", "raw"])

    key = kind(tokens, "doc_key")
    packed = tokens.select("doc_key", "doc_len", "toks").mapInArrow(pack, f"doc_key {key}, doc_len int, toks array<int>, tfs array<int>")
    return packed.repartition("doc_key").sortWithinPartitions("doc_key").mapInArrow(score, f"query_id {kind(block.rows, 'query_id')}, doc_key {key}, raw double")


def best_rows(found: np.ndarray, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows found, best first, less those that k others outrank for sure:
    better by more than rounding can level, or equal with a smaller number."""
    found = found[np.lexsort((found, -total[found]))]
    raw = total[found]
    better = np.searchsorted(-raw, -(raw + ROUNDING), side="right")
    equal = np.arange(len(raw)) - np.searchsorted(-raw, -raw, side="left")
    keep = better + equal < k
    return found[keep], raw[keep]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Packed rows, ordered by key, as (keys, doc_len, doc, tok, tf): rows of one key are one document, also over the ends of batches."""
    left = None
    for batch in _then_none(batches):
        rows = batch if left is None else left if batch is None else pa.concat_batches([left, batch])
        if rows is None or not rows.num_rows:
            continue
        code = rows["doc_key"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.append(True, np.diff(code) != 0)
        end = len(code) if batch is None else int(np.flatnonzero(fresh)[-1])
        left = rows.slice(end)
        if not end:
            continue
        rows, fresh = rows.slice(0, end), fresh[:end]
        first, number = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        width = pc.list_value_length(rows["toks"]).to_numpy(zero_copy_only=False)
        doc, tok, tf = np.repeat(number, width), rows["toks"].flatten().to_numpy(zero_copy_only=False).astype(np.int64), rows["tfs"].flatten().to_numpy(zero_copy_only=False)
        if len(first) < end:
            pair, place = np.unique(doc * (int(tok.max()) + 1) + tok, return_inverse=True)
            tf = np.bincount(place, tf).astype(np.int64)
            doc, tok = np.divmod(pair, int(tok.max()) + 1)
        at = pa.array(first)
        yield rows["doc_key"].take(at), rows["doc_len"].take(at).to_numpy(zero_copy_only=False), doc, tok, tf


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def bm25_scores(
    queries: DataFrame, docs: DataFrame, k: int, index: Bm25Index | None = None, k1: float = fv.BM25_K1, b: float = fv.BM25_B
) -> DataFrame:
    """(query_id, doc_key, score, rank) for documents sharing a token."""
    index = index or bm25_index(docs)
    # one small row per query token; written out because the size check, the
    # vocabulary filter and the scoring join all read it
    weighted = cut_lineage(
        query_terms(queries).join(index.terms, "tok").select("query_id", "tok", (F.col("qtf") * F.col("idf")).alias("w")))
    avgdl = docs.sparkSession.range(1).select(index.avgdl).first()[0] or 1.0
    tokens = docs.select("doc_key", word_tokens(F.col("text")).alias("toks")).withColumn("doc_len", F.size("toks"))
    hits = [
        top_k(_score_documents(tokens, block, k, (k1, b, avgdl)).withColumn("score", F.round("raw", 4)), k)
        for block in query_blocks(weighted, "query_id", SCAN_ROWS)
    ]
    return union_all(hits).select("query_id", "doc_key", "score", "rank")


def with_zero_fill(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Adds zero-score documents (smallest keys first) where a query has fewer
    than k hits. Only 2k candidate keys per query can ever be needed: at most k
    of them are hits already."""
    fillers = docs.select("doc_key").orderBy("doc_key").limit(2 * k).agg(F.sort_array(F.collect_list("doc_key")).alias("fill"))
    short = queries.select("query_id").withColumn("fill", fillers.scalar())
    rows = short.select("query_id", F.explode("fill").alias("doc_key")).join(hits.select("query_id", "doc_key"), ["query_id", "doc_key"], "left_anti")
    both = hits.select("query_id", "doc_key", "score").unionByName(rows.withColumn("score", F.lit(0.0)))
    return top_k(both, k)


def keyword_overlap(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Distinct shared tokens as score, over whole texts."""
    terms = cut_lineage(query_terms(queries).select("query_id", "tok", F.lit(1.0).alias("w")))
    tokens = docs.select("doc_key", F.array_distinct(word_tokens(F.col("text"))).alias("toks")).withColumn("doc_len", F.size("toks"))
    hits = [
        top_k(_score_documents(tokens, block, k, None).withColumn("score", F.col("raw").cast("long")), k)
        for block in query_blocks(terms, "query_id", SCAN_ROWS)
    ]
    return union_all(hits).select("query_id", "doc_key", "score", "rank")


# --- phrase search -------------------------------------------------------
_INNER = r"(?<=[^a-z0-9£])[a-z0-9£]+(?=[^a-z0-9£])"


def _anchor_candidates(phrases: DataFrame) -> DataFrame:
    """Every way a phrase can be looked up through whole tokens of a text.

    A token with separators on both sides inside the phrase must be a whole
    token of any text holding the phrase ('inner'). A phrase without such a
    token starts with the end of a token ('head') when a separator follows,
    ends with the start of one ('tail'), lies inside one ('inside'), or holds
    separators only ('mark').
    """
    p = F.col("phrase")
    inner = F.regexp_extract_all(p, F.lit(_INNER), F.lit(0))
    head = F.regexp_extract(p, r"^([a-z0-9£]+)[^a-z0-9£]", 1)
    tail = F.regexp_extract(p, r"[^a-z0-9£]([a-z0-9£]+)$", 1)
    kind = (
        F.when(F.size(inner) > 0, "inner")
        .when(head != "", "head")
        .when(tail != "", "tail")
        .when(p.rlike("^[a-z0-9£]+$"), "inside")
        .when(p != "", "mark")
    )
    anchors = (
        F.when(kind == "inner", F.array_distinct(inner))
        .when(kind == "head", F.array(head))
        .when(kind == "tail", F.array(tail))
        .when(kind == "inside", F.array(p))
        .when(kind == "mark", F.array(F.substr(p, F.lit(1), F.lit(1))))
    )
    return phrases.select("query_id", "phrase", kind.alias("kind"), F.explode(anchors).alias("anchor"))


def token_grams(vocabulary: DataFrame) -> DataFrame:
    """Vocabulary rows with every gram of one, two and three characters, so that
    any string up to its first three characters can be joined on equality."""
    tok = F.col("tok")
    at = lambda i: F.array(*[F.substr(tok, i, F.lit(n)) for n in (1, 2, 3)])
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(tok)), at)))
    return vocabulary.select("*", F.explode(grams).alias("gram"))


def substring_tokens(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, tok): vocabulary tokens that contain a word."""
    keyed = words.withColumn("gram", F.substr("word", F.lit(1), F.lit(3)))
    return keyed.join(token_grams(vocabulary), "gram").where(F.contains("tok", F.col("word"))).select("word", "tok")


def _rarest_inner(inner: DataFrame, docs: DataFrame) -> DataFrame:
    """The inner token of each phrase that fewest documents hold; only tokens
    of phrases are counted."""
    words = explode_rows(docs, [], F.array_distinct(word_tokens(F.col("text"))), "tok")
    asked = inner.select(F.col("anchor").alias("tok")).distinct()
    df = words.join(asked, "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("df"))
    found = inner.join(df, F.col("anchor") == F.col("tok"))
    return found.groupBy("query_id", "phrase").agg(F.min_by("tok", F.struct("df", "tok")).alias("tok"))


def edge_tokens(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """edges (anchor, kind, ...) with every vocabulary token that the edge of a
    phrase can be part of, joined on equality of a short gram."""
    keyed = edges.withColumn("gram", F.substr("anchor", F.lit(1), F.lit(3)))
    a, t = F.col("anchor"), F.col("tok")
    fits = F.when(F.col("kind") == "head", t.endswith(a)).when(F.col("kind") == "tail", t.startswith(a)).otherwise(F.contains(t, a))
    return keyed.join(token_grams(vocabulary), "gram").where(fits)


def _edge_matches(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, phrase, tok) over the tokens of docs."""
    vocabulary = explode_rows(docs, [], F.array_distinct(word_tokens(F.col("text"))), "tok").distinct()
    return edge_tokens(edges, vocabulary).select("query_id", "phrase", "tok")


def phrase_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Case-insensitive literal substring search, first k keys per query.

    Instead of testing every text against every phrase, each phrase is looked up
    by its rarest inner token (or, for one- and two-token phrases, by the corpus
    tokens its edge can be part of), and only those texts are tested. Exact: a
    text holding the phrase always holds the looked-up token. Empty phrases
    match nothing. Kinds of phrases that do not occur cost nothing.
    """
    phrases = queries.select("query_id", F.lower("text").alias("phrase"))
    anchors = cut_lineage(_anchor_candidates(phrases))
    kinds = {r["kind"] for r in anchors.select("kind").distinct().collect()}  # five at most
    parts = [anchors.where("kind = 'mark'").select("query_id", "phrase", F.col("anchor").alias("tok"))]
    if "inner" in kinds:
        parts.append(_rarest_inner(anchors.where("kind = 'inner'"), docs))
    if kinds & {"head", "tail", "inside"}:
        parts.append(_edge_matches(anchors.where("kind IN ('head', 'tail', 'inside')"), docs))
    lookups = cut_lineage(union_all(parts))
    low = docs.select("doc_key", F.lower("text").alias("low"))
    keys = F.array_distinct(word_tokens(F.col("low")))
    if "mark" in kinds:
        keys = F.concat(keys, F.array_distinct(F.regexp_extract_all("low", F.lit(r"[^a-z0-9£]"), F.lit(0))))
    words = explode_rows(low, ["doc_key"], keys, "tok")
    pairs = words.join(lookups, "tok").select("query_id", "phrase", "doc_key").distinct()
    verified = pairs.join(low, "doc_key").where(F.contains("low", F.col("phrase")))
    hits = verified.select("query_id", "doc_key", (F.position("phrase", "low") - 1).alias("hit_pos"))
    w = Window.partitionBy("query_id").orderBy("doc_key")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def index_stats(docs: DataFrame) -> DataFrame:
    """Documents, vocabulary, characters, uploads and statics of a corpus."""
    key = F.col("doc_key")
    base = docs.agg(
        F.count("*").alias("num_docs"),
        F.sum(F.length("text")).alias("total_chars"),
        F.count_if(key.startswith("upload::")).alias("uploads"),
        F.count_if(key.startswith("static::")).alias("statics"),
    )
    return base.withColumn("num_tokens", document_frequency(docs).agg(F.count("*").alias("n")).scalar())


def upload_keys(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_key").startswith("upload::")).select("doc_key")


def lookup_documents(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """Text per requested key, empty where the key is unknown."""
    return keys.join(docs, "doc_key", "left").select("doc_key", F.coalesce("text", F.lit("")).alias("text"))
