import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import postings, stored_index
from lexspark.operators.stored_index import StoredIndex
from lexspark.session import scratch_path

WORDS = [f"w{i}" for i in range(60)] + ["the"] * 40 + ["of", "£5", "x1"]


def frame(spark, rows, name="doc_key"):
    return spark.createDataFrame(rows, f"{name} string, text string")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(f"d{i:04d}", " ".join(rng.choices(WORDS, k=rng.choice([3, 20, 80])))) for i in range(300)]
    out += [(f"copy{i:03d}", "the w1 w2 the w3 of") for i in range(80)]
    return [*out, ("e0", ""), ("e1", None), ("e2", "?!"), ("upload::7", "Zebra the w59, w59! THE-END"), ("k", "the " * 500)]


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 8))) for _ in range(25)]
    return frame(spark, [(f"q{i}", t) for i, t in enumerate([*texts, "the", "the the of", "nothing known", "", "zebra the", "w1 w2 the w3"])], "query_id")


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(stored_index, "RANGE", 32)


def new_index(spark, docs, **how):
    return StoredIndex.create(docs, scratch_path(spark, "index"), **how)


def as_rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


HIT = ("query_id", "doc_key", "score", "rank")


def close(got, want):
    assert [(*g[:2], g[3]) for g in got] == [(*w[:2], w[3]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-4)


def test_ranking_equals_the_scan(spark, rows, asked, small_ranges):
    docs = frame(spark, rows)
    index = new_index(spark, docs, buckets=5)
    for k in (1, 7, 200):
        close(as_rows(index.bm25(asked, k), *HIT), as_rows(postings.bm25_scores(asked, docs, k), *HIT))
    assert as_rows(index.keyword_overlap(asked, 7), *HIT) == as_rows(postings.keyword_overlap(asked, docs, 7), *HIT)


def test_contents_equal_the_scan(spark, rows, small_ranges):
    docs = frame(spark, rows)
    index = new_index(spark, docs, buckets=3)
    names = ("doc_key", "tok", "tf", "first_pos")
    assert as_rows(index.postings(), *names) == as_rows(postings.build_postings(docs), *names)
    scan = postings.bm25_index(docs)
    want = scan.terms.withColumn("n", scan.n_docs).withColumn("avgdl", scan.avgdl)
    got = index.terms().withColumn("n", F.lit(index.totals.n_docs)).withColumn("avgdl", F.lit(index.totals.avgdl))
    for g, w in zip(as_rows(got, "tok", "df", "idf", "n", "avgdl"), as_rows(want, "tok", "df", "idf", "n", "avgdl"), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:])
    assert index.stats().first().asDict() == postings.index_stats(docs).first().asDict()


def test_negative_weights(spark, asked):
    """Two documents: every idf is zero or below, so no list has a lower bound."""
    docs = frame(spark, [("a", "the w1"), ("b", "the of"), ("c", "the")])
    close(as_rows(new_index(spark, docs).bm25(asked, 2), *HIT), as_rows(postings.bm25_scores(asked, docs, 2), *HIT))


def test_appends_and_merge_equal_a_rebuild(spark, rows, asked, small_ranges):
    docs = frame(spark, rows)
    whole = new_index(spark, docs)
    grown = new_index(spark, frame(spark, rows[:150]), buckets=4)
    before = as_rows(grown.bm25(asked, 5), *HIT)
    older = grown
    grown = grown.append(frame(spark, rows[140:260])).append(frame(spark, rows[200:])).append(frame(spark, rows))  # repeats are ignored
    assert len(grown.live) == 3
    merged = grown.merge()
    assert len(merged.live) == 1 and merged.merge() is merged
    terms, hits, stats = as_rows(whole.terms(), "tok", "df", "occurrences"), as_rows(whole.bm25(asked, 9), *HIT), whole.stats().first()
    for index in (grown, StoredIndex(spark, merged.path)):
        assert index.totals.n_docs == whole.totals.n_docs and index.totals.avgdl == whole.totals.avgdl and index.totals.floor == pytest.approx(whole.totals.floor)
        assert as_rows(index.terms(), "tok", "df", "occurrences") == terms
        close(as_rows(index.bm25(asked, 9), *HIT), hits)
        assert index.stats().first() == stats
    names = ("doc_key", "tok", "tf", "first_pos")
    assert as_rows(merged.postings(), *names) == as_rows(whole.postings(), *names)
    hit = ("query_id", "doc_key", "hit_pos", "rank")
    assert as_rows(merged.phrase_search(asked, docs, 4), *hit) == as_rows(whole.phrase_search(asked, docs, 4), *hit)
    assert as_rows(older.bm25(asked, 5), *HIT) == before  # a version stays as it was


def test_empty_corpus_and_no_queries(spark, asked):
    index = new_index(spark, frame(spark, []))
    assert index.bm25(asked, 3).count() == 0 and index.keyword_overlap(asked, 3).count() == 0 and index.terms().count() == 0
    assert index.phrase_search(asked, frame(spark, []), 3).count() == 0
    grown = index.append(frame(spark, [("a", "the w1")]))
    assert as_rows(grown.keyword_overlap(asked.where("query_id = 'q25'"), 3), *HIT) == [("q25", "a", 1, 1)]
    assert grown.bm25(asked.where("1 = 0"), 3).count() == 0


def test_query_blocks(spark, rows, asked, small_ranges, monkeypatch):
    docs = frame(spark, rows)
    index = new_index(spark, docs)
    want, phrases = as_rows(index.bm25(asked, 6), *HIT), as_rows(index.phrase_search(asked, docs, 6), "query_id", "doc_key")
    monkeypatch.setattr(stored_index, "QUERY_ROWS", 60)
    assert as_rows(index.bm25(asked, 6), *HIT) == want
    assert as_rows(index.phrase_search(asked, docs, 6), "query_id", "doc_key") == phrases


def test_phrases_equal_substring_search(spark, small_ranges):
    rng = random.Random(3)
    alphabet, seps = ["ab", "abc", "b", "é", "£5", "x1", "zz", "AB"], [" ", ", ", "\n", "-", "  "]
    make = lambda n: "".join(w for _ in range(n) for w in (rng.choice(alphabet), rng.choice(seps)))
    texts = [make(rng.randint(3, 12)) for _ in range(60)] + ["ABC abc", "", "zz", "ab ab ab ab"]
    phrases = []
    for t in texts[:60]:
        i = rng.randrange(max(1, len(t) - 3))
        phrases.append(t[i : i + rng.choice([1, 2, 3, 5, 8, 13])])
    phrases += ["b", "ab", "c a", ", ", "-", "é", "abc ab", "nope nope nope", "BC", " ab ", "ab ab ab", "", " ab ab "]
    docs, q = frame(spark, [(f"d{j:02d}", t) for j, t in enumerate(texts)]), frame(spark, [(f"q{i}", p) for i, p in enumerate(phrases)], "query_id")
    index = new_index(spark, docs, buckets=2)
    for k in (2, 100):
        want = set()
        for i, p in enumerate(phrases):
            hits = [(f"q{i}", f"d{j:02d}", t.lower().find(p.lower())) for j, t in enumerate(texts) if p and p.lower() in t.lower()]
            want |= {(*h, r) for r, h in enumerate(hits[:k], 1)}
        assert set(as_rows(index.phrase_search(q, docs, k), "query_id", "doc_key", "hit_pos", "rank")) == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_search_scans_or_moves_text(spark, rows, tmp_path, monkeypatch):
    """Ranking never opens the texts; phrases read them, but no exchange carries them."""
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    index = new_index(spark, texts)
    plans = []
    cut = stored_index.cut_lineage
    monkeypatch.setattr(stored_index, "cut_lineage", lambda df: plans.append(plan_of(df)) or cut(df))
    q = frame(spark, [("common", "the"), ("letter", "w"), ("two", "e w"), ("run", "the w1 w2 the")], "query_id")
    for search in (index.bm25, index.keyword_overlap):
        plans.append(plan_of(search(q, 5)))
    assert not any("texts" in p or "positions" in p for p in plans)
    # token joins come first: what is exchanged are lists of tokens asked for
    assert all("BroadcastHashJoin [tok" in p for p in plans if "FlatMapCoGroups" in p)
    plans.clear()
    hits = index.phrase_search(q, texts, 5)
    plans.append(plan_of(hits))
    assert any("texts" in p for p in plans)
    for p in plans:
        for line in p.splitlines():
            assert not ("Exchange" in line and ("text#" in line or "low#" in line))
        assert "SortMergeJoin" not in p or "texts" not in p
    assert as_rows(hits, "query_id", "doc_key") == as_rows(postings.phrase_search(q, texts, 5), "query_id", "doc_key")


def test_a_merge_moves_lists_not_postings(spark, rows, small_ranges, monkeypatch):
    """Stored rows are cut by new range and packed: no posting is a row of its own, also when new places come in several passes."""
    docs = frame(spark, rows[:90])
    grown = new_index(spark, frame(spark, rows[:70]), buckets=2).append(frame(spark, [*rows[60:90], ("none", None)]))
    monkeypatch.setattr(stored_index, "MOVES_AT_ONCE", 50)
    plans, commit = [], StoredIndex._commit
    monkeypatch.setattr(StoredIndex, "_commit", lambda self, packed, *more, **how: plans.append(packed._jdf.queryExecution().optimizedPlan().toString()) or commit(self, packed, *more, **how))
    merged = grown.merge()
    assert "Generate" not in plans[0] and "binary" in stored_index.MOVED_SCHEMA
    names = ("doc_key", "tok", "tf", "first_pos")
    assert as_rows(merged.postings(), *names) == as_rows(new_index(spark, docs).postings(), *names)
    assert merged.totals.n_docs == 91 and merged.stats().first() == grown.stats().first()


def test_phrase_lists_move_without_their_users(spark, rows, asked, small_ranges, monkeypatch):
    """What is moved to the ranges does not grow with questions times ranges: no list carries the questions that ask for it."""
    docs = frame(spark, rows[:150])
    index = new_index(spark, docs)
    hit = ("query_id", "doc_key", "hit_pos", "rank")
    want = as_rows(postings.phrase_search(asked, docs, 4), *hit)
    moved, intersect = [], stored_index._intersecter
    monkeypatch.setattr(stored_index, "_intersecter", lambda runs: moved.append(set(runs.columns)) or intersect(runs))
    monkeypatch.setattr(stored_index, "RUN_ROWS", 30)
    monkeypatch.setattr(StoredIndex, "_lists", lambda *_: pytest.fail("lists joined with their users"))
    assert as_rows(index.phrase_search(asked, docs, 4), *hit) == want
    assert len(moved) > 1 and moved[0] == {"query_id", "place", "size", "no"}
