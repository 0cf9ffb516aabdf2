"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document whose value lies above a cutoff. Cutoffs come from
fixed grids, most lenient first. For every stratum and rule a cutoff counts as
certified when the labelled good documents it would reject are so few that an
exact binomial test refutes a false rejection rate above the rule's share of
`alpha`. The tests of all strata and rules share `delta` (Bonferroni); along one
grid the rejected documents only grow, so the cutoffs are tested in order and
the first failure ends the walk (fixed sequence, no further correction). With
probability 1 - delta or more, no stratum loses over `alpha` of its good
documents to all rules together. Among certified cutoffs the one that removes
most labelled bad documents, less the good ones it costs, is taken; any choice
among certified cutoffs keeps the guarantee.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexspark.session import cut_lineage

# fixed values of the contract: blanks between words, symbols, size of repeated windows
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHA, DELTA = 0.05, 0.05
# a sum of binomial terms stops here; the rest is bounded by a geometric series, so p-values are never too small
TERMS = 4096
# rows of the thresholds are repeated this often, so that a stratum with a third of all documents is this many keys
SALTS = 32


class Rule(NamedTuple):
    name: str
    value: str  # SQL over the features; null never rejects
    grid: tuple[float, ...]  # cutoffs, most lenient first


RULES = (
    Rule("symbols", "100.0 * n_symbols / nullif(n_words, 0)", (200, 150, 100, 75, 50, 40, 30, 20, 15, 10, 5)),
    Rule("long_words", "1.0 * word_chars / nullif(n_words, 0)", (15, 12, 10, 9, 8, 7.5, 7, 6.5, 6)),
    Rule("short_words", "-1.0 * word_chars / nullif(n_words, 0)", (-1, -1.5, -2, -2.5, -3, -3.5, -4)),
    Rule("duplicate_lines", "100.0 * n_dup_lines / nullif(n_lines, 0)", (90, 75, 60, 50, 40, 30, 25, 20, 15, 10)),
    Rule("repeated_words", "100.0 * n_repeat_words / nullif(n_words, 0)", (30, 25, 20, 15, 10, 5)),
    Rule("capitals", "100.0 * n_capitals / nullif(word_chars, 0)", (90, 75, 60, 50, 40, 30, 20, 15)),
)


def features(docs: DataFrame, stratum: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_capitals, n_repeat_words, base_failed), a row per row.

    Everything is counted inside the row, over the whole text. A null text is
    empty: all counts 0, base_failed true. Other columns are ignored.
    """
    blanks = F.lit(BLANKS)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"), body.alias("body"))
    rows = rows.select("key", "stratum", "body", F.btrim("body", blanks).alias("trimmed"))
    words = F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", f"[{BLANKS}]+"))
    lines = F.filter(F.split("body", "\n"), lambda line: F.btrim(line, blanks) != "")
    rows = rows.select("key", "stratum", "body", words.alias("words"), lines.alias("lines"))
    gone = lambda chars: F.char_length("body") - F.char_length(F.translate("body", chars, ""))
    rows = rows.select(
        "key", "stratum", "words", F.size("words").cast("long").alias("n_words"), F.char_length(F.translate("body", BLANKS, "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), gone(CAPITALS).cast("long").alias("n_capitals"),
    )
    counted = with_repeated_words(rows)
    few, repeats = F.col("n_words") < 20, 100 * F.col("n_repeat_words") > 30 * F.col("n_words")
    return counted.withColumn("base_failed", few | repeats).drop("words")


def _twins(sorted_pairs: Column) -> Column:
    """Places `at` of the (w, at) pairs whose w equals a neighbour's in the sorted array."""
    same = lambda p, j, by: p["w"] == F.get(sorted_pairs, j + by)["w"]
    return F.transform(F.filter(sorted_pairs, lambda p, j: same(p, j, -1) | same(p, j, 1)), lambda p: p["at"])


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside windows that occur twice or more in the row's words.

    Windows are compared by hash first. Most texts have no equal hashes and stop
    there; in the others the windows behind equal hashes are compared as words.
    """
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("hashes", F.when(F.col("n_words") > WINDOW, hashes))
    starts = F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int"))
    rows = rows.withColumn("windows", F.when(F.col("hashes").isNotNull(), F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))))
    rows = rows.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows")).drop("hashes")
    pairs = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    rows = rows.withColumn("pairs", F.when(F.col("repeats"), pairs)).drop("windows")
    rows = rows.withColumn("maybe", F.when(F.col("repeats"), _twins(F.col("pairs")))).drop("pairs")
    spelled = F.sort_array(F.transform("maybe", lambda i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("w"), i.alias("at"))))
    rows = rows.withColumn("spelled", F.when(F.col("repeats"), spelled)).drop("maybe")
    rows = rows.withColumn("places", F.when(F.col("repeats"), F.sort_array(_twins(F.col("spelled"))))).drop("spelled")
    reach = F.transform("places", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("places", j + 1) - p, F.lit(WINDOW))).cast("long"))
    total = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.when(F.col("repeats"), total).otherwise(F.lit(0).cast("long"))).drop("places", "repeats")


def _log_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(21)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) where k < n * p, else 1 (it is over a half there).

    Terms fall from k downwards, so the sum starts there; from TERMS terms on,
    a geometric series bounds the rest from above.
    """
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = lambda i: (k - i) * (1 - p) / ((n - k + i + 1) * p)
    zero = F.struct(F.exp(top).alias("term"), F.exp(top).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * ratio(i)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    steps = F.least(k, F.lit(TERMS)).cast("int")
    rest = ratio(steps) / (1 - ratio(steps))
    summed = F.aggregate(F.slice(F.sequence(F.lit(0), F.greatest(steps, F.lit(1))), F.lit(1), steps), zero, step, lambda s: s["total"] + s["term"] * rest)
    return F.when(k < n * p, F.least(F.lit(1.0), summed)).otherwise(F.lit(1.0))


def certified_cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(stratum, rule, cutoff, n_good, good_rejected, bad_rejected, p_value): the chosen cutoff of each stratum and rule that has one.

    labels is (key, quality); repeated labels of a key count once, and as good
    where they disagree, null qualities not at all. A null stratum is a stratum
    of its own. A stratum with too few good documents for any proof has no
    cutoff, so nothing is rejected there. Counts cover all labelled rows.
    """
    known = labels.where("key IS NOT NULL AND quality IS NOT NULL").groupBy("key").agg((F.max("quality") > 0).alias("good"))
    above = lambda r: F.size(F.filter(F.lit([float(c) for c in r.grid]), lambda cutoff: F.expr(r.value) > cutoff))
    levels = F.array(*[F.struct(F.lit(i).alias("rule"), above(r).alias("above")) for i, r in enumerate(rules)])
    marked = rows.join(known, "key").select("stratum", "good", F.explode(levels).alias("at")).select("stratum", "good", "at.*")
    bins = marked.groupBy("stratum", "rule", "above").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # level i stands for the cutoff that is i-th from the strict end: it rejects what lies above i cutoffs or more; level 0 counts all rows
    each = bins.select("stratum", "rule", "good", "bad", F.explode(F.sequence(F.lit(0), F.col("above"))).alias("i"))
    tested = cut_lineage(each.groupBy("stratum", "rule", "i").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    tests = tested.select("stratum").distinct().agg(F.count("*")).scalar() * len(rules)
    grid = Window.partitionBy("stratum", "rule")
    tested = tested.withColumn("n_good", F.max(F.when(F.col("i") == 0, F.col("good"))).over(grid)).where("i > 0")
    tested = tested.withColumn("p_value", binomial_tail(F.col("good"), F.col("n_good"), alpha / len(rules)))
    walked = tested.withColumn("worst", F.max("p_value").over(grid.orderBy(F.desc("i"))))
    gain = F.struct((F.col("bad") - F.col("good")).alias("gain"), F.col("i"))
    passed = walked.where(F.col("worst") <= delta / tests).where("bad > good")
    best = passed.withColumn("place", F.row_number().over(grid.orderBy(gain.desc()))).where("place = 1")
    cutoff = F.element_at(F.element_at(F.lit([[float(c) for c in r.grid] for r in rules]), F.col("rule") + 1), -F.col("i"))
    name = F.element_at(F.lit([r.name for r in rules]), F.col("rule") + 1)
    return best.select("stratum", name.alias("rule"), cutoff.alias("cutoff"), "n_good", F.col("good").alias("good_rejected"),
                       F.col("bad").alias("bad_rejected"), "p_value")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The features of every row of docs with `failed` (names of the rules that reject it) and `kept`.

    docs holds doc_id, text and the stratum, labels doc_id and quality; other
    columns are ignored. Null, empty and blank texts fail the base rule. Repeated rows are
    judged one by one and alike; a null doc_id has no label but a verdict. No
    labels: only the base rule rejects. Empty docs give no rows. Texts are read
    once; from then on rows hold counts only.
    """
    rows = cut_lineage(features(docs, stratum))
    chosen = certified_cutoffs(rows, labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("quality")), alpha, delta, rules)
    limit = lambda r: F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"max_{r.name}")
    limits = chosen.groupBy("stratum").agg(*[limit(r) for r in rules])
    limits = cut_lineage(limits.select(F.col("stratum").alias("of"), *[f"max_{r.name}" for r in rules], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = salted.join(limits, F.col("stratum").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")), "left")
    failed = F.array_compact(F.array(*[F.when(F.expr(f"{r.value} > max_{r.name}"), F.lit(r.name)) for r in rules]))
    out = joined.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return out.select(F.col("key").alias("doc_id"), "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_capitals", "n_repeat_words",
                      "base_failed", "failed", "kept")
