"""Shared tokens counted in bits: against plain counting, part by part."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import bit_counts, hybrid, postings, ranking, stored_index
from lexspark.operators.stored_index import StoredIndex
from lexspark.session import scratch_path


@pytest.mark.parametrize("k, cells", [(1, 8), (3, 1 << 20), (200, 64)])
def test_counts_equal_plain_counting(k, cells, monkeypatch):
    monkeypatch.setattr(bit_counts, "CELLS", cells)
    rng = np.random.default_rng(5)
    held = rng.random((40, 150)) < rng.random((40, 1)) ** 2  # tokens x documents
    held[7] = True
    questions = [np.sort(rng.choice(40, size, replace=False)) for size in (0, 1, 2, 3, 7, 25, 40)]
    tok, doc = np.nonzero(held)
    shuffled = rng.permutation(len(tok))
    rows = bit_counts.bit_rows(tok[shuffled], doc[shuffled], 40, 3)
    starts = np.append(0, np.cumsum([len(q) for q in questions]))
    got = set()
    for batch in bit_counts.best_shared(np.concatenate(questions), starts, rows, 3, k):
        got |= set(zip(*(part.tolist() for part in batch)))
    want = set()
    for q, toks in enumerate(questions):
        counts = held[toks].sum(axis=0)
        want |= {(q, int(d), int(counts[d])) for d in sorted(np.flatnonzero(counts), key=lambda d: (-counts[d], d))[:k]}
    assert got == want


def test_overlap_scores_no_question_on_its_own(spark, monkeypatch):
    """Questions meet the lists of many ranges at once; before, every (question, range) was bounded and scored."""
    monkeypatch.setattr(stored_index, "RANGE", 8)
    monkeypatch.setattr(stored_index, "PART", 2)
    monkeypatch.setattr(stored_index, "OVERLAP_ROWS", 40)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(f"d{i:03d}", " ".join(rng.choices(words[: rng.randint(1, 30)], k=rng.randint(0, 12)))) for i in range(120)] + [(None, "w0 w1"), ("empty", None)], "doc_key string, text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(25)] + [("q0", "w1 w29"), (None, "w0"), ("none", "nope")], "query_id string, text string")
    index = StoredIndex.create(docs, scratch_path(spark, "overlap"))
    index = index.append(docs.limit(3).withColumn("doc_key", F.concat(F.lit("z"), "doc_key")))
    texts = docs.unionByName(docs.limit(3).withColumn("doc_key", F.concat(F.lit("z"), "doc_key")).where("doc_key IS NOT NULL"))

    def fail(*_):
        raise AssertionError("scored one by one")

    monkeypatch.setattr(StoredIndex, "_walk", fail)
    row = lambda df: sorted(map(tuple, df.select("query_id", "doc_key", "score", "rank").collect()), key=str)
    assert row(index.keyword_overlap(asked, 4)) == row(postings.keyword_overlap(asked, texts, 4))


def test_hit_text_is_blanked_once(spark, monkeypatch):
    """A text that many questions hit is blanked once, before it meets them."""
    docs = spark.createDataFrame([("a", "One, two; THREE"), ("b", "five"), ("c", None)], "doc_key string, text string")
    asked = spark.createDataFrame([(f"q{i}", "nope three one") for i in range(20)], "query_id string, text string")
    hits = asked.select("query_id", F.lit("a").alias("doc_key"), F.lit(1).alias("rank"))
    written = []
    cut = hybrid.cut_lineage
    monkeypatch.setattr(hybrid, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    got = hybrid.keyword_snippets(hits, asked, docs).collect()
    assert len(got) == 20 and {r["snippet"] for r in got} == {"One, two; THREE"}
    assert [w.count() for w in written if "blanked" in w.columns] == [1]


def test_questions_are_not_sent_to_every_part(spark, monkeypatch):
    """Questions times parts are never rows: parts meet a copy of the questions, and a task gives k rows a question for all its parts."""
    monkeypatch.setattr(stored_index, "RANGE", 8)
    monkeypatch.setattr(stored_index, "PART", 1)
    monkeypatch.setattr(stored_index, "TASKS_A_CORE", 0.25)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(20)]
    docs = spark.createDataFrame([(f"d{i:03d}", " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(120)], "doc_key string, text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(15)], "query_id string, text string")
    found = []
    monkeypatch.setattr(stored_index, "top_k", lambda hits, k: found.append(hits) or ranking.top_k(hits, k))
    row = lambda df: sorted(map(tuple, df.select("query_id", "doc_key", "score", "rank").collect()))
    hits = StoredIndex.create(docs, scratch_path(spark, "overlap")).keyword_overlap(asked, 2)
    assert row(hits) == row(postings.keyword_overlap(asked, docs, 2))
    assert "Join Cross" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert found[0].count() <= 15 * 2  # one task here: before, up to two rows for each of 16 parts


def test_a_text_that_comes_twice_gives_two_rows(spark):
    """Every row of a hit document counts once."""
    docs = spark.createDataFrame([("a", "One two"), ("a", "One two"), ("a", "three"), ("b", "five")], "doc_key string, text string")
    asked = spark.createDataFrame([("q", "two")], "query_id string, text string")
    hits = asked.select("query_id", F.lit("a").alias("doc_key"), F.lit(1).alias("rank"))
    assert sorted(r["snippet"] for r in hybrid.keyword_snippets(hits, asked, docs).collect()) == ["One two", "One two", "three"]
