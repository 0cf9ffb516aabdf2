"""Gold-answer curation: source texts by priority, drafts, statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexspark.functions.markdown import claims
from lexspark.functions.text import is_placeholder, strip
from lexspark.operators.graph_build import Graph
from lexspark.operators.graph_reports import provision_texts
from lexspark.operators.graph_walk import search_provisions
from lexspark.operators.postings import substring_tokens
from lexspark.operators.ranking import top_k
from lexspark.operators.sizing import BROADCAST_ROWS, query_blocks, union_all
from lexspark.session import cut_lineage
from lexspark.operators.rows import explode_rows, posexplode_rows

_WORDS = "[a-z0-9]+"
FIRST_KEYS = 1_000  # documents of the first search, by key


def prefix_words(weighed: DataFrame, min_words: int) -> DataFrame:
    """(query_id, word, common) of weighed (query_id, word, weight): the
    min_words - 1 heaviest words of a question are common. Whatever shares
    min_words words with it holds one of the others, so only those need to find
    candidates. Questions with fewer than min_words words are left out."""
    w = Window.partitionBy("query_id")
    ranked = weighed.withColumn("_r", F.row_number().over(w.orderBy(F.col("weight").desc(), "word"))).withColumn("_m", F.count("*").over(w))
    return ranked.where(F.col("_m") >= min_words).select("query_id", "word", (F.col("_r") < min_words).alias("common"))


def documents_sharing_words(questions: DataFrame, docs: DataFrame, min_words: int = 4, k: int = 2) -> DataFrame:
    """First k documents (by key) holding at least min_words distinct question
    words as substrings. Documents are searched in key order: the FIRST_KEYS
    smallest keys, then the others for the questions that have not found k yet.
    Later documents cannot displace earlier ones, so nothing is lost."""
    smallest = docs.select("doc_key").where("doc_key IS NOT NULL").distinct().orderBy("doc_key").limit(FIRST_KEYS)
    last = smallest.agg(F.max("doc_key")).first()[0]
    early = F.col("doc_key").isNull() | (F.col("doc_key") <= F.lit(last) if last is not None else F.lit(False))
    questions = cut_lineage(questions.select("query_id", "text"))
    hits = cut_lineage(_sharing_words(questions, cut_lineage(docs.select("doc_key", "text").where(early)), min_words, k))
    full = hits.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    left = cut_lineage(questions.join(full, "query_id", "left_anti"))
    if left.isEmpty():
        return hits
    later = _sharing_words(left, docs.select("doc_key", "text").where(~early), min_words, k)
    return top_k(hits.drop("rank").unionByName(later.drop("rank")).withColumn("score", F.lit(0)), k).select("query_id", "doc_key", "rank")


def _sharing_words(questions: DataFrame, docs: DataFrame, min_words: int, k: int) -> DataFrame:
    """The first k of these documents for every question. Words are matched against the vocabulary first. A
    document becomes a candidate of a question by its rarer words only (see
    prefix_words); the common ones are gathered once a document, whatever the
    number of questions, and counted for candidates. All of it happens in one
    partitioning by document."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(_WORDS), F.lit(0)))
    asked = explode_rows(questions, ["query_id"], words(F.col("text")), "word").distinct()
    tokens = docs.select("doc_key", words(F.col("text")).alias("toks"))
    vocabulary = cut_lineage(explode_rows(tokens, [], "toks", "tok").groupBy("tok").agg(F.count("*").alias("held_by")))
    pairs = cut_lineage(substring_tokens(asked.select("word").distinct(), vocabulary.select("tok")))
    weights = pairs.join(vocabulary, "tok").groupBy("word").agg(F.sum("held_by").alias("weight"))
    roles = cut_lineage(prefix_words(asked.join(weights, "word"), min_words))
    rare = cut_lineage(roles.where("NOT common").join(pairs, "word").select("query_id", "word", "tok"))
    common = cut_lineage(roles.where("common").select("word").distinct().join(pairs, "word").select("word", "tok"))
    few_common = common.count() <= BROADCAST_ROWS
    hint = lambda df, small: F.broadcast(df) if small else df
    hits = []
    for block in query_blocks(rare, "query_id"):
        needed = hint(block.rows.select("tok").unionByName(common.select("tok")).distinct(), block.small and few_common)
        kept = explode_rows(tokens, ["doc_key"], "toks", "tok").join(needed, "tok", "left_semi").repartition("doc_key")
        shared = kept.join(block.hint(block.rows), "tok").select("doc_key", "query_id", "word").distinct()
        found = shared.groupBy("doc_key", "query_id").agg(F.count("*").alias("n"))
        held = kept.join(hint(common, few_common), "tok").groupBy("doc_key").agg(F.collect_set("word").alias("held"))
        usual = roles.where("common").join(block.rows.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id").agg(F.collect_set("word").alias("usual"))
        none = F.array().cast("array<string>")
        more = F.size(F.array_intersect(F.coalesce("held", none), F.coalesce("usual", none)))
        enough = found.join(held, "doc_key", "left").join(block.hint(usual), "query_id", "left").where(F.col("n") + more >= min_words).select("query_id", "doc_key")
        hits.append(top_k(enough.withColumn("score", F.lit(0)), k))
    return union_all(hits).select("query_id", "doc_key", "rank")


def gather_sources(questions: DataFrame, graph: Graph, docs: DataFrame) -> DataFrame:
    """(query_id, layer, pos, label, body) for questions (query_id, text,
    expected_citations): cited provisions, else the three best provisions of a
    search, else up to two documents. Later layers see only unanswered rows."""
    cites = F.filter(F.transform(F.split(F.coalesce("expected_citations", F.lit("")), "[|,]"), strip), lambda c: c != "")
    wanted = posexplode_rows(questions, ["query_id"], cites, "pos", "cite")
    texts = provision_texts(wanted, graph.provisions, ignore_case=True).where("text <> ''")
    cited = wanted.join(texts, "cite").select(
        "query_id", F.lit("cites").alias("layer"), "pos", F.col("found_cite").alias("label"),
        F.concat(F.lit("["), "found_cite", F.lit("] "), "title", F.lit("\n"), "text").alias("body"))
    cited = cut_lineage(cited)
    left = questions.join(cited.select("query_id"), "query_id", "left_anti")
    searched = search_provisions(left.select("query_id", "text"), graph, 3).where("text <> ''").select(
        "query_id", F.lit("search").alias("layer"), F.col("rank").alias("pos"), F.col("cite").alias("label"),
        F.concat(F.lit("["), "cite", F.lit("] "), "title", F.lit("\n"), "text").alias("body"))
    searched = cut_lineage(searched)
    left = left.join(searched.select("query_id"), "query_id", "left_anti")
    found = documents_sharing_words(left.select("query_id", "text"), docs).join(docs, "doc_key")
    loose = found.select(
        "query_id", F.lit("documents").alias("layer"), F.col("rank").alias("pos"), F.col("doc_key").alias("label"),
        F.concat(F.lit("["), "doc_key", F.lit("]\n"), "text").alias("body"))
    return union_all([cited, searched, loose])


def extractive_draft(sources: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Default drafter: the first sentence of the first source that reads as a
    claim; (query_id, draft) only where there is one. max_chars limits what is
    read of a source."""
    first = sources.groupBy("query_id").agg(F.min_by("body", "pos").alias("body"))
    if max_chars is not None:
        first = first.withColumn("body", F.substr("body", F.lit(1), F.lit(max_chars)))
    drafted = first.select("query_id", F.try_element_at(claims(F.regexp_replace("body", r"^\[[^\]]*\][^\n]*\n", "")), F.lit(1)).alias("draft"))
    return drafted.where("draft IS NOT NULL")


def curate(questions: DataFrame, graph: Graph, docs: DataFrame, limit: int | None = None, dry_run: bool = False, drafter=extractive_draft) -> DataFrame:
    """Questions (query_id, text, gold_answer, expected_citations) with a drafted
    gold answer for placeholder rows, curation_status and curation_source_cites."""
    marked = questions.withColumn("_ph", is_placeholder(F.col("gold_answer")))
    todo = marked.where("_ph").select("query_id", "text", "expected_citations")
    if limit is not None:
        todo = todo.orderBy("query_id").limit(limit)
    if dry_run:
        skipped = todo.select("query_id", F.lit(True).alias("_todo"))
        return marked.join(skipped, "query_id", "left").select(
            *questions.columns, F.when(F.col("_todo"), "dry_run_skip").otherwise("kept_original").alias("curation_status"),
            F.when(F.col("_ph"), "").otherwise(F.coalesce("expected_citations", F.lit(""))).alias("curation_source_cites"))
    sources = cut_lineage(gather_sources(todo, graph, docs))
    labels = sources.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]), " | ").alias("_labels"))
    joined = marked.join(todo.select("query_id", F.lit(True).alias("_todo")), "query_id", "left").join(labels, "query_id", "left").join(drafter(sources), "query_id", "left")
    status = F.when(F.col("_todo").isNull(), "kept_original").when(F.col("draft").isNotNull(), "llm_drafted").otherwise("needs_manual")
    used = F.when(~F.col("_ph"), F.coalesce("expected_citations", F.lit(""))).otherwise(F.coalesce("_labels", F.lit("")))
    return joined.select(
        *[F.coalesce("draft", "gold_answer").alias("gold_answer") if c == "gold_answer" else c for c in questions.columns],
        status.alias("curation_status"), used.alias("curation_source_cites"))
