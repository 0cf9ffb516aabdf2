"""Benchmark decontamination over a positional inverted index of the training texts."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexspark.llm.common import unused
from lexspark.operators.sizing import BROADCAST_ROWS
from lexspark.session import cut_lineage

WINDOW = 13
# places by which the words of a proximity match may stray at each side
SLACK = 2
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# letters that lower() would change beyond A-Z
_OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. lower() does the same, and faster, where no other capital occurs."""
    return F.when(text.rlike(_OTHER_CAPITALS), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def test_windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(phrase array<string>, items array<string>): distinct windows of `size` words, or a shorter item's words as a whole."""
    split = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    rows = split.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("phrase")).distinct()
    return rows.groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS // 20 else df


def text_key(key: str, text: str) -> Column:
    """Tells rows apart whose keys repeat with other texts."""
    return F.xxhash64(F.col(text), F.col(key))


def phrase_matches(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", slack: int = 0) -> DataFrame:
    """(key, text_key, start, n, items, exact): occurrences of the phrases (column phrase array<string>, items) in docs.

    Occurrences of the test vocabulary are counted first; every phrase is then
    looked up by its rarest word. The stored posting of such a word is (word,
    document, position, the terms around it): the lists of the other terms,
    shifted by their offsets, are intersected with it by comparing those terms,
    from the phrase's rarest term outwards, so common words are never gathered.
    With slack, proximity matches are returned too, with exact = false: an
    occurrence of the rarest word (the first place of it in the phrase) says
    where the phrase would start, and every word of the phrase, as often as it
    stands there, lies within its length plus `slack` places on each side, in
    any order. Places before the text are cut off; start is 0 at least.
    """
    phrases = cut_lineage(phrases.select("phrase", "items", F.size("phrase").alias("n")))
    terms = phrases.select("phrase", F.posexplode("phrase").alias("at", "word"))
    vocabulary = cut_lineage(terms.select("word").distinct())
    n_words, n_phrases = vocabulary.count(), phrases.count()
    occurrences = docs.select(F.explode_outer(words(F.col(text))).alias("word")).join(hinted(vocabulary, n_words), "word").groupBy("word").agg(F.count("*").alias("seen"))
    ranked = terms.join(hinted(occurrences, n_words), "word")  # a phrase with a word that never occurs has no match
    complete = ranked.groupBy("phrase").agg(F.count("*").alias("found"), F.min(F.struct("seen", "word", "at")).alias("rare")).where(F.col("found") == F.size("phrase"))
    rare = complete.join(phrases, "phrase").select(F.col("rare.word").alias("word"), F.col("rare.at").alias("at"), "phrase", "items", "n")
    lookup = cut_lineage(rare.groupBy("word").agg(
        F.max("at").alias("before"), F.max(F.col("n") - F.col("at")).alias("after"), F.collect_list(F.struct("at", "n", "phrase", "items")).alias("entries")))

    split = docs.select(F.col(key), text_key(key, text).alias("text_key"), words(F.col(text)).alias("w"))
    postings = split.select(key, "text_key", "w", F.posexplode_outer("w").alias("pos", "word"))
    near = postings.join(hinted(lookup.select("word", "before", "after"), n_phrases), "word").select(
        key, "text_key", "word", "pos", F.greatest(F.lit(0), F.col("pos") - F.col("before") - slack).alias("base"),
        F.slice("w", F.greatest(F.lit(0), F.col("pos") - F.col("before") - slack) + 1, F.col("before") + F.col("after") + 2 * slack).alias("around"))
    met = near.join(hinted(lookup.select("word", "entries"), n_phrases), "word").select(key, "text_key", "pos", "base", "around", F.inline("entries"))
    start = F.col("pos") - F.col("at")
    if not slack:
        own = F.slice("around", start - F.col("base") + 1, F.col("n"))
        found = met.where(start >= 0).select(key, "text_key", start.alias("start"), "n", "items", (own == F.col("phrase")).alias("exact"))
        return found.where("exact")
    placed = met.withColumn("start", start)
    first = F.greatest(F.lit(0), F.col("start") - slack)
    wide = F.slice("around", first - F.col("base") + 1, F.col("start") + F.col("n") + slack - first)
    held = placed.withColumn("wide", wide).where(F.size(F.array_except("phrase", "wide")) == 0)
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    held = held.where(F.forall(F.array_distinct("phrase"), lambda w: times(F.col("wide"), w) >= times(F.col("phrase"), w)))
    own = F.slice("wide", F.greatest(F.lit(0), F.least(F.col("start"), F.lit(slack))) + 1, F.col("n"))
    return held.select(key, "text_key", F.greatest(F.lit(0), "start").alias("start"), "n", "items", ((F.col("start") >= 0) & (own == F.col("phrase"))).alias("exact"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  size: int = WINDOW, slack: int = 0) -> DataFrame:
    """(key, text_key, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of docs.

    With slack, n_near (long) and near_sha256 follow: the items that have
    proximity matches (see phrase_matches) in the document and no exact one.
    They do not count as contamination. A word inside any occurrence of a test window is hit; a document is
    contaminated if at least a twentieth of its words are. Null and empty texts
    have no words and no hits, null and empty items no windows. Rows with equal
    key and text share their result; other columns are ignored.
    """
    found = cut_lineage(phrase_matches(docs, test_windows(items, item_key, item_text, size), key, text, slack).select(
        key, "text_key", "start", "n", "items", "exact").distinct())
    matches = found.where("exact")
    before = Window.partitionBy(key, "text_key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    reach = F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), F.col("start"))
    hits = matches.groupBy(key, "text_key", "start").agg(F.max("n").alias("n")).withColumn("own", F.greatest(F.lit(0), end - reach)).groupBy(key, "text_key").agg(F.sum("own").alias("n_hit"))
    item = found.select(key, "text_key", F.explode("items").alias("item"), "exact").groupBy(key, "text_key", "item").agg(F.max("exact").alias("exact"))
    listed = lambda wanted: F.array_sort(F.collect_list(F.when(wanted, F.col("item"))))
    named = item.groupBy(key, "text_key").agg(listed(F.col("exact")).alias("names"), listed(~F.col("exact")).alias("near"))
    per = hits.alias("h").join(named.alias("o"), F.col(f"h.{key}").eqNullSafe(F.col(f"o.{key}")) & (F.col("h.text_key") == F.col("o.text_key")), "full").select(
        F.coalesce(f"h.{key}", f"o.{key}").alias(key), F.coalesce("h.text_key", "o.text_key").alias("text_key"), "n_hit", "names", "near")
    base = docs.select(F.col(key), text_key(key, text).alias("text_key"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    names, near = (F.coalesce(c, F.array().cast("array<string>")) for c in ("names", "near"))
    nearby = [F.size(near).cast("long").alias("n_near"), F.sha2(F.array_join(near, ","), 256).alias("near_sha256")] if slack else []
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    joined = base.alias("d").join(per.alias("m"), (F.col(f"d.{key}").eqNullSafe(F.col(f"m.{key}"))) & (F.col("d.text_key") == F.col("m.text_key")), "left")
    return joined.select(
        F.col(f"d.{key}").alias(key), F.col("d.text_key"), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *nearby)


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                    size: int = WINDOW) -> DataFrame:
    """Rows of docs, all columns kept, that are not contaminated (see contamination)."""
    mark, one = unused(docs, "text_hash"), unused(docs, "contaminated_one")
    bad = contamination(docs, items, key, text, item_key, item_text, size).where("contaminated").select(
        F.struct(F.col(key).alias("key"), F.col("text_key").alias("text")).alias(one)).distinct()
    tagged = docs.withColumn(mark, text_key(key, text))
    return tagged.join(bad, (F.col(mark) == F.col(one)["text"]) & F.col(key).eqNullSafe(F.col(one)["key"]), "left_anti").select(*docs.columns)
