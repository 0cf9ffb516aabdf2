"""Lexical answer scores: the plain family and the phrase-aware family.

Everything is computed inside the row except ROUGE-L, whose longest common
subsequence is an Arrow-batched helper.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from lexspark import fixed_values as fv
from lexspark.functions import citations as c
from lexspark.functions.text import let, stem_tokens, strip, word_tokens


def pipe_items(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip), lambda x: x != "")


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Share of common tokens; one empty side gives 0, two give both_empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence, bit-parallel over the first sequence."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    row = mask
    for word in b:
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def _rouge_l(answers: pd.Series, references: pd.Series) -> pd.Series:
    def one(answer, reference):
        if answer is None or reference is None or not len(answer) or not len(reference):
            return 0.0
        common = lcs_length(list(reference), list(answer))
        return 2.0 * common / (len(answer) + len(reference))

    return pd.Series([one(a, r) for a, r in zip(answers, references)], dtype="float64")


def rouge_l(answer: Column, reference: Column) -> Column:
    """F1 of the longest common word subsequence."""
    return _rouge_l(word_tokens(answer), word_tokens(reference))


def citation_match(answer: Column, expected: Column) -> Column:
    parts = F.struct(pipe_items(expected).alias("items"), F.lower(F.coalesce(answer, F.lit(""))).alias("low"))
    return let(parts, lambda s: F.when(F.size(s["items"]) == 0, F.lit(0.0)).otherwise(
        F.size(F.filter(s["items"], lambda x: F.contains(s["low"], F.lower(x)))) / F.size(s["items"])))


def keyword_hits(answer: Column, expected: Column) -> Column:
    """Share of expected keywords that are single answer tokens (precision and
    recall coincide, so this is the F1 too)."""
    wanted = F.array_distinct(F.transform(pipe_items(expected), F.lower))
    return let(wanted, lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(w, word_tokens(answer))) / F.size(w)))


def lexical_scores(records: DataFrame) -> DataFrame:
    """The four lexical columns added to records with answer, ground_truth,
    expected_citations and expected_keywords."""
    a, g = F.col("answer"), F.col("ground_truth")
    return records.withColumns({
        "lex_jaccard": F.round(jaccard(F.array_distinct(word_tokens(a)), F.array_distinct(word_tokens(g))), 4),
        "lex_rouge_l": F.round(rouge_l(a, g), 4),
        "lex_citation_match": F.round(citation_match(a, F.col("expected_citations")), 4),
        "lex_keyword_f1": F.round(keyword_hits(a, F.col("expected_keywords")), 4),
    })


# --- phrase-aware family -------------------------------------------------
def _stems_of(phrase: str) -> list[str]:
    return [re.sub(r"(ing|ed|es|s)$", "", w) for w in re.findall(fv.WORD_PATTERN, phrase.lower())]


def _literal_phrases(phrases: Sequence[str]) -> Column:
    return F.array(*[F.array(*[F.lit(w) for w in _stems_of(p)]) for p in phrases])


def _holds(tokens: Column, stems: Column) -> Column:
    return F.size(F.array_except(stems, tokens)) == 0


def phrase_hits(tokens: Column, keywords: Column) -> Column:
    """Number of keywords present as phrases, synonyms counting as well."""

    def present(k: Column) -> Column:
        found = _holds(tokens, stem_tokens(k))
        for phrase, others in fv.KEYWORD_SYNONYMS.items():
            other = F.exists(_literal_phrases(others), lambda s: _holds(tokens, s))
            found = found | ((F.lower(k) == phrase) & other)
        return found

    return F.size(F.filter(keywords, present))


def phrase_keyword_f1(answer: Column, expected: Column) -> Column:
    return let(F.struct(F.array_distinct(stem_tokens(answer)).alias("toks"), pipe_items(expected).alias("kws")), lambda s: F.when(
        F.size(s["kws"]) == 0, F.lit(1.0)).otherwise(phrase_hits(s["toks"], s["kws"]) / F.size(s["kws"])))


def phrase_completeness(answer: Column, expected: Column) -> Column:
    raw = F.filter(F.split(F.coalesce(expected, F.lit("")), r"\|"), lambda k: k != "")
    return let(F.struct(F.array_distinct(stem_tokens(answer)).alias("toks"), raw.alias("kws")), lambda s: F.when(
        F.size(s["kws"]) == 0, F.lit(1.0)).otherwise(phrase_hits(s["toks"], s["kws"]) / F.size(s["kws"])))


_ASCII_BREAKS = "".join(x for x in map(chr, range(1, 128)) if not re.match(r"[a-z0-9]", x)) + chr(0)


def count_true(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t.cast("int") for t in tests])


def legal_terminology(answer: Column) -> Column:
    """Share of the legal terms whose stems all are stems of the answer's tokens. The stems stand in one text, a blank around
    each, so that a row costs two patterns and not one per token."""
    suffixless = F.regexp_replace(F.lower(F.coalesce(answer, F.lit(""))), r"(ing|ed|es|s)(?![a-z0-9£])", "")
    blanked = F.regexp_replace(F.translate(suffixless, _ASCII_BREAKS, " " * len(_ASCII_BREAKS)), r"[^\x00-\x7F£]+", " ")
    stems = F.concat(F.lit(" "), blanked, F.lit(" "))
    held = lambda text, term: reduce(lambda a, b: a & b, [F.contains(text, F.lit(f" {s} ")) for s in _stems_of(term)])
    return let(stems, lambda text: count_true([held(text, t) for t in fv.LEGAL_TERMS]) / len(fv.LEGAL_TERMS))


def blended_similarity(rouge: Column, overlap: Column, semantic: Column | None = None) -> Column:
    """.7 ROUGE + .3 Jaccard; with a semantic score .6 of it, .3 ROUGE, .1 blend."""
    blend = F.when(rouge.isNull(), overlap).otherwise(0.7 * rouge + 0.3 * overlap)
    if semantic is None:
        return blend
    return F.when(semantic.isNull(), blend).otherwise(0.6 * semantic + 0.3 * F.coalesce(rouge, F.lit(0.0)) + 0.1 * blend)


def citation_quality(invalid: Column, penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - 0.1 * F.size(invalid) - penalty)


def source_accuracy(meta_ok: Column, invalid: Column, penalty: Column) -> Column:
    good = F.coalesce(meta_ok, F.lit(False)) & (F.size(invalid) == 0) & (penalty == 0.0)
    return F.when(good, F.lit(1.0)).otherwise(F.lit(0.0))


def citation_scores(rows: DataFrame, answer: str = "answer", meta_ok: Column | None = None) -> DataFrame:
    """citation_quality and source_accuracy added to rows."""
    checked = rows.withColumn("_invalid", c.invalid_citations(F.col(answer), "lenient")).withColumn("_penalty", c.policy_penalty(F.col(answer)))
    ok = F.lit(True) if meta_ok is None else meta_ok
    return checked.withColumns({
        "citation_quality": F.round(citation_quality(F.col("_invalid"), F.col("_penalty")), 4),
        "source_accuracy": source_accuracy(ok, F.col("_invalid"), F.col("_penalty")),
    }).drop("_invalid", "_penalty")


def risk_found(answer: Column, expected_risk: Column) -> Column:
    return F.contains(F.lower(answer), F.lower(strip(expected_risk)))


def bullet_structure(answer: Column) -> Column:
    return F.least(F.lit(1.0), F.regexp_count(answer, F.lit(r"(?md)^\s*[-•*]")) / 4.0)


def invalid_audit(answers: DataFrame) -> DataFrame:
    """Total invalid citations, and rows minus one if there is any."""
    total = answers.agg(F.sum(F.size(c.invalid_citations(F.col("answer"), "lenient"))).alias("invalid_total"), F.count("*").alias("n"))
    return total.select("invalid_total", (F.col("n") - F.signum("invalid_total").cast("bigint")).alias("valid_estimate"))
