"""Recall diagnosis: stratified sampling, n-gram containment, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexspark import fixed_values as fv
from lexspark.functions.citations import first_citation
from lexspark.functions.text import citation_folded, is_placeholder, let
from lexspark.operators.postings import phrase_search
from lexspark.session import cut_lineage
from lexspark.operators.rows import explode_rows


def stratified_sample(rows: DataFrame, k: int, seed: int, stratum: str = "domain", key: str = "qid") -> DataFrame:
    """k rows spread over the strata: max(1, k // strata) each, the rest drawn
    from all remaining rows, in a seeded order that does not depend on
    partitioning."""
    strata = rows.select(stratum).where(F.col(stratum).isNotNull()).distinct().count()
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    drawn = rows.withColumn("_order", order)
    if strata == 0:
        return drawn.orderBy("_order", key).limit(k).drop("_order")
    w = Window.partitionBy(stratum).orderBy("_order", key)
    picked = (
        drawn.where(F.col(stratum).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(1, k // strata))
        .orderBy(stratum, "_r").limit(k)
    )
    rest = drawn.join(picked.select(key), key, "left_anti").orderBy("_order", key).limit(k)
    both = picked.drop("_r").withColumn("_part", F.lit(0)).unionByName(rest.withColumn("_part", F.lit(1)))
    return both.orderBy("_part", "_order", key).limit(k).drop("_order", "_part")


def sample_per_source(rows: DataFrame, n: int, seed: int, source: str = "source_file", key: str = "qid") -> DataFrame:
    """n random rows per source (all of them if there are fewer)."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    w = Window.partitionBy(source).orderBy(order, key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def _starts(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))


def _windows(words: Column, n: int) -> Column:
    return F.transform(_starts(words, n), lambda i: F.slice(words, i, n))


def _folded_words(c: Column) -> Column:
    return F.filter(F.split(citation_folded(c), " "), lambda w: w != "")


def _keyed_windows(words: Column, n: int) -> Column:
    """Windows as (inner words, first word, last word)."""
    return F.transform(_starts(words, n), lambda i: F.struct(
        F.array_join(F.slice(words, i + 1, n - 2), " ").alias("inner"), F.get(words, i - 1).alias("first"), F.get(words, i + (n - 2)).alias("last")))


def ngram_in_corpus(needles: DataFrame, docs: DataFrame, n: int = fv.NGRAM_WORDS) -> DataFrame:
    """(qid) of needles with an n-word window that is a substring of some text.

    A window of a needle lies in a text exactly where n neighbouring words of it
    agree on the inner words, the first ends with the window's first word and
    the last starts with the window's last. So both sides are joined on the
    inner words and the two touching letters - no text is tested against all
    needles, and windows of the texts are not shuffled while the needles' are few.
    A window that many needles or texts share is matched as one window. Needles shorter than n words are searched as whole strings.
    """
    if n < 3:
        raise ValueError("windows need at least three words")
    words = cut_lineage(needles.select("qid", _folded_words(F.col("text")).alias("words")))
    windows = explode_rows(words, ["qid"], _keyed_windows(F.col("words"), n), "w").select(
        "qid", "w.inner", F.col("w.first").alias("n_first"), F.col("w.last").alias("n_last"))
    wanted = windows.select("inner", "n_first", "n_last").distinct().withColumns({"a": F.right("n_first", F.lit(1)), "b": F.left("n_last", F.lit(1))})
    held = docs.select(_folded_words(F.col("text")).alias("words"))  # a column of its own: split once per text
    held = explode_rows(held, [], _keyed_windows(F.col("words"), n), "w").select("w.inner", "w.first", "w.last")
    held = held.select("inner", "first", "last", F.right("first", F.lit(1)).alias("a"), F.left("last", F.lit(1)).alias("b"))
    met = wanted.join(held, ["inner", "a", "b"]).where(F.col("first").endswith(F.col("n_first")) & F.col("last").startswith(F.col("n_last")))
    long_hits = windows.join(met.select("inner", "n_first", "n_last").distinct(), ["inner", "n_first", "n_last"]).select("qid")
    short = words.where((F.size("words") > 0) & (F.size("words") < n)).select(F.col("qid").alias("query_id"), F.array_join("words", " ").alias("text"))
    if short.isEmpty():
        return long_hits.distinct()
    folded = docs.select("doc_key", citation_folded(F.col("text")).alias("text"))
    short_hits = phrase_search(short, folded, 1).select(F.col("query_id").alias("qid"))
    return long_hits.unionByName(short_hits).distinct()


def ngram_in_text(needle: Column, text: Column, n: int = fv.NGRAM_WORDS) -> Column:
    """The same test of one needle against its own text."""

    def test(s: Column) -> Column:
        windows = F.transform(_windows(s["words"], n), lambda w: F.array_join(w, " "))
        whole = (F.size(s["words"]) > 0) & F.contains(s["body"], s["needle"])
        return F.when(F.size(s["words"]) < n, whole).otherwise(F.exists(windows, lambda w: F.contains(s["body"], w)))

    parts = F.struct(_folded_words(needle).alias("words"), citation_folded(needle).alias("needle"), citation_folded(text).alias("body"))
    return let(parts, test)


def diagnose(sample: DataFrame, docs: DataFrame) -> DataFrame:
    """Per row (qid, domain, ground_truth, contexts_text, answer): placeholder,
    gold text in corpus, in the retrieved contexts, first citation."""
    real = sample.where(~is_placeholder(F.col("ground_truth")))
    found = ngram_in_corpus(real.select("qid", F.col("ground_truth").alias("text")), docs).withColumn("hit", F.lit(True))
    ph = is_placeholder(F.col("ground_truth"))
    return sample.join(found, "qid", "left").select(
        "qid", "domain", ph.alias("is_placeholder"), F.coalesce("hit", F.lit(False)).alias("gt_in_corpus"),
        (~ph & ngram_in_text(F.col("ground_truth"), F.col("contexts_text"))).alias("gt_in_retrieved"),
        first_citation(F.col("answer")).alias("top1_citation"))


def verdict(diagnosed: DataFrame, questions: DataFrame, threshold: int = 2) -> DataFrame:
    """One row: counts of the sample, placeholder share of the full set, recall
    floor, and whether the test set (not retrieval) is the problem."""
    ph = F.col("is_placeholder")
    counts = diagnosed.agg(
        F.count("*").alias("n"), F.count_if(ph).alias("placeholders"),
        F.count_if(~ph & ~F.col("gt_in_corpus")).alias("corpus_misses"), F.count_if(~ph & ~F.col("gt_in_retrieved")).alias("retrieved_misses"))
    total = questions.agg(F.struct(F.count("*").alias("n"), F.count_if(is_placeholder(F.col("gold_answer"))).alias("ph")).alias("t")).scalar()
    issues = F.col("placeholders") + F.col("corpus_misses")
    return counts.withColumn("t", total).select(
        "n", "placeholders", "corpus_misses", "retrieved_misses", issues.alias("quality_issues"), (issues > threshold).alias("stop"),
        F.col("t.ph").alias("set_placeholders"), F.col("t.n").alias("set_total"),
        F.floor(F.try_divide(F.col("t.ph") * 100, F.col("t.n"))).alias("set_percent"),
        F.round(F.try_divide(F.col("t.n") - F.col("t.ph"), F.col("t.n")), 4).alias("recall_floor"))
