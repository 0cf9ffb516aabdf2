"""Relaxed answer scores: expanded keywords, partial credit, source lines."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from lexspark import fixed_values as fv
from lexspark.functions import citations as c
from lexspark.functions.text import lemma, lemma_tokens, let, plain_words
from lexspark.operators.lexical_scores import count_true, jaccard, pipe_items
from lexspark.operators.rows import posexplode_rows


def frequent_tokens(records: DataFrame, key: str = "qid", text: str = "ground_truth") -> DataFrame:
    """(key, top, long_top): the 12 most frequent lemma tokens of a text and the
    10 most frequent of length >= 3, earlier ones first among equals."""
    toks = posexplode_rows(records, [key], lemma_tokens(F.col(text)), "pos", "tok")
    counted = toks.groupBy(key, "tok").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "pos")
    wide = Window.partitionBy(key).orderBy((F.length("tok") >= 3).desc(), F.col("n").desc(), "pos")
    ranked = counted.withColumn("r", F.row_number().over(w)).withColumn("rl", F.row_number().over(wide))
    top, long_top = F.col("r") <= fv.RELAXED_TOP_TOKENS, (F.col("rl") <= 10) & (F.length("tok") >= 3)
    return ranked.where(top | long_top).groupBy(key).agg(
        F.collect_list(F.when(top, F.col("tok"))).alias("top"), F.collect_list(F.when(long_top, F.col("tok"))).alias("long_top"))


def _with_synonyms(items: Column) -> Column:
    extra = F.array().cast("array<string>")
    for phrase, others in fv.RELAXED_SYNONYMS.items():
        extra = F.when(F.array_contains(items, phrase), F.concat(extra, F.array(*[F.lit(o) for o in others]))).otherwise(extra)
    return F.concat(items, extra)


def with_expanded_keywords(records: DataFrame, key: str = "qid") -> DataFrame:
    """Adds keys: given keywords, synonyms and frequent gold tokens."""
    joined = records.join(frequent_tokens(records, key), key, "left")
    given = _with_synonyms(F.transform(pipe_items(F.col("expected_keywords")), F.lower))
    none = F.array().cast("array<string>")
    base = F.array_distinct(F.concat(given, F.coalesce("top", none)))
    kept = F.filter(base, lambda k: (F.length(k) >= 3) & ~k.rlike(r"^\p{N}+$"))
    return joined.withColumn("keys", kept).withColumn("long_top", F.coalesce("long_top", none)).drop("top")


def presence(tokens: Column, keys: Column) -> Column:
    """1 per keyword fully in the answer, 0.5 for a partly present phrase."""

    def credit(k: Column) -> Column:
        parts = F.array_distinct(F.transform(F.filter(F.split(plain_words(k), " "), lambda w: w != ""), lemma))
        return let(parts, lambda p: F.when(F.size(F.array_except(p, tokens)) == 0, F.lit(1.0))
                   .when((F.size(p) > 1) & F.arrays_overlap(p, tokens), F.lit(0.5)).otherwise(F.lit(0.0)))

    return F.aggregate(F.transform(keys, credit), F.lit(0.0), lambda a, x: a + x)


def terminology(answer: Column) -> Column:
    """Phrases and acronyms in the answer over 8, 1 at most. Words are parted by single blanks here, so an acronym with no letter,
    digit or _ beside it is one between blanks once £ is parted off as well."""

    def share(text: Column) -> Column:
        parted = F.replace(text, F.lit("£"), F.lit(" £ "))
        return let(parted, lambda marked: F.least(F.lit(1.0), count_true(
            [F.contains(text, F.lit(p)) for p in fv.RELAXED_PHRASES] + [F.contains(marked, F.lit(f" {p} ")) for p in fv.RELAXED_ACRONYMS]) / 8.0))

    return let(F.concat(F.lit(" "), plain_words(answer), F.lit(" ")), share)


@F.pandas_udf(DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def similarity(rows: DataFrame, answer: str = "answer", gold: str = "ground_truth") -> DataFrame:
    """Adds semantic_similarity: the larger of Jaccard and sequence ratio, the
    latter at least .6 where the gold text lies inside the answer."""
    rows = rows.withColumn("_a", lemma_tokens(F.col(answer))).withColumn("_g", lemma_tokens(F.col(gold)))
    rows = rows.withColumn("_ta", F.array_join("_a", " ")).withColumn("_tg", F.array_join("_g", " "))
    rows = rows.withColumn("_r", _sequence_ratio("_ta", "_tg"))
    ratio = F.when(F.contains("_ta", F.col("_tg")) & (F.col("_r") < 0.6), F.lit(0.6)).otherwise(F.col("_r"))
    best = F.greatest(jaccard(F.array_distinct("_a"), F.array_distinct("_g")), ratio)
    empty = (F.col("_ta") == "") | (F.col("_tg") == "")
    return rows.withColumn("semantic_similarity", F.when(empty, F.lit(0.0)).otherwise(F.round(best, 4))).drop("_a", "_g", "_ta", "_tg", "_r")


def keyword_scores(records: DataFrame, key: str = "qid") -> DataFrame:
    """Adds legal_completeness, keyword_f1_score and n_keys."""
    rows = with_expanded_keywords(records, key).withColumn("_toks", lemma_tokens(F.col("answer")))
    rows = rows.withColumn("_set", F.array_distinct("_toks")).withColumn("_tp", presence(F.col("_set"), F.col("keys")))
    tp, n = F.col("_tp"), F.size("keys")
    fallback = F.when(F.size("long_top") == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), presence(F.col("_set"), F.col("long_top")) / F.size("long_top")))
    completeness = F.when(n > 0, F.least(F.lit(1.0), tp / F.greatest(F.lit(1), n))).otherwise(fallback)
    fp = F.greatest(F.lit(0.0), F.size("_toks") * 0.02 - tp * 0.1)
    fn = F.greatest(F.lit(0.0), n - tp)
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return rows.withColumns({
        "legal_completeness": F.round(completeness, 4),
        "keyword_f1_score": F.when(n == 0, F.lit(0.0)).otherwise(F.round(f1, 4)),
        "n_keys": n,
    }).drop("_toks", "_set", "_tp", "long_top")


def source_scores(rows: DataFrame, answer: str = "answer", meta_ok: str = "citations_ok") -> DataFrame:
    """Adds source_line, source_accuracy, citation_quality and the debug lists."""
    rows = rows.withColumn("source_line", c.source_line(F.col(answer)))
    pieces = F.filter(F.split("source_line", fv.SOURCE_SPLIT), lambda p: F.trim(p) != "")
    rows = rows.withColumn("citations_all", F.transform(pieces, c.normalise_source_token))
    rows = rows.withColumn("citations_valid", F.filter("citations_all", lambda p: c.on_allow_list(p, "relaxed")))
    accuracy = F.when(F.coalesce(F.col(meta_ok), F.lit(False)), F.lit(1.0)).when(c.has_relaxed_match(F.col(answer)), F.lit(0.85)).otherwise(F.lit(0.0))
    n = F.size("citations_valid")
    quality = F.when(n > 0, F.least(F.lit(1.0), 0.6 + 0.1 * (n - 1))).otherwise(F.lit(0.0))
    return rows.withColumns({"source_accuracy": accuracy, "citation_quality": F.round(quality, 4)})
