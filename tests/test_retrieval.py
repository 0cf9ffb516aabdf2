import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import dense, hybrid, postings, ranking, session_chunks
from lexspark.plugins import hashing_embedder


def docs(spark, texts):
    return spark.createDataFrame([(f"d{i:02d}", t) for i, t in enumerate(texts)], "doc_key string, text string")


def queries(spark, texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def test_fusion_prefers_overlap(spark):
    lists = [["doc1", "doc2", "doc3"], ["doc2", "doc4"], ["doc2", "doc1"]]
    rows = [("q", d, r) for ls in lists for r, d in enumerate(ls, 1)]
    got = ranking.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id string, doc_key string, rank int"), 3).orderBy("rank").collect()
    assert [r["doc_key"] for r in got] == ["doc2", "doc1", "doc4"]
    assert [r["rank"] for r in got] == [1, 2, 3]
    assert got[0]["score"] == pytest.approx(1 / 62 + 1 / 61 + 1 / 61)


def test_bm25_zero_fill_and_repeated_tokens(spark):
    d = docs(spark, ["apple pie", "apple apple tart", "pear", "plum"])
    q = queries(spark, ["apple", "apple apple", "nothing"])
    hits = postings.bm25_scores(q, d, 10)
    got = {(r["query_id"], r["doc_key"]): r["score"] for r in hits.collect()}
    assert set(got) == {("q0", "d00"), ("q0", "d01"), ("q1", "d00"), ("q1", "d01")}
    assert got["q1", "d00"] == pytest.approx(2 * got["q0", "d00"], abs=1e-3)
    filled = postings.with_zero_fill(hits, q, d, 3)
    assert sorted((r["query_id"], r["doc_key"]) for r in filled.where("query_id = 'q2'").collect()) == [("q2", "d00"), ("q2", "d01"), ("q2", "d02")]
    assert filled.groupBy("query_id").count().select(F.max("count")).first()[0] == 3


def test_query_blocks_give_the_same_result(spark, monkeypatch):
    from lexspark.operators import sizing

    d = docs(spark, ["a b c", "b c d", "c d e", "x y"])
    q = queries(spark, ["a b", "c", "d e x", "y y"])
    want = sorted(map(tuple, postings.keyword_overlap(q, d, 2).collect()))
    monkeypatch.setattr(sizing.query_blocks, "__defaults__", (2,))
    assert sorted(map(tuple, postings.keyword_overlap(q, d, 2).collect())) == want
    assert len(sizing.query_blocks(postings.query_terms(q), "query_id")) > 1


def test_phrase_search_equals_substring_search(spark):
    rng = random.Random(3)
    alphabet = ["ab", "abc", "b", "é", "£5", "x1", "zz"]
    seps = [" ", ", ", "\n", "-", "  "]
    make = lambda n: "".join(w for _ in range(n) for w in (rng.choice(alphabet), rng.choice(seps)))
    texts = [make(rng.randint(3, 12)) for _ in range(40)] + ["ABC abc", "", "zz"]
    phrases = []
    for t in texts[:40]:
        i = rng.randrange(max(1, len(t) - 3))
        phrases.append(t[i:i + rng.choice([1, 2, 3, 5, 8, 13])])
    phrases += ["b", "ab", "c a", ", ", "-", "é", "abc ab", "nope nope nope", "BC"]
    d, q = docs(spark, texts), queries(spark, phrases)
    got = {(r["query_id"], r["doc_key"], r["hit_pos"]) for r in postings.phrase_search(q, d, 100).collect()}
    want = {(f"q{i}", f"d{j:02d}", t.lower().find(p.lower())) for i, p in enumerate(phrases) for j, t in enumerate(texts) if p and p.lower() in t.lower()}
    assert got == want
    top = postings.phrase_search(q, d, 2)
    assert top.where("rank > 2").isEmpty()


def vectors(spark, n, name, seed, **extra):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 8)).astype("float32")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cols = ", ".join([f"{name} string", "embedding array<float>", *[f"{k} string" for k in extra]])
    rows = [(f"{name[0]}{i:03d}", [float(x) for x in v], *[f(i) for f in extra.values()]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, cols), m


def brute(qm, dm, k, allowed=lambda i, j: True, min_score=None):
    out = set()
    for i, qv in enumerate(qm.astype("float64")):
        s = [(-round(float(qv @ dv), 4), f"d{j:03d}") for j, dv in enumerate(dm.astype("float64")) if allowed(i, j)]
        for r, (neg, key) in enumerate(sorted(x for x in s if min_score is None or -x[0] >= min_score)[:k], 1):
            out.add((f"q{i:03d}", key, r))
    return out


def as_set(df):
    return {(r["query_id"], r["doc_key"], r["rank"]) for r in df.collect()}


def test_knn_paths_agree_with_brute_force(spark, monkeypatch):
    q, qm = vectors(spark, 7, "query_id", 1)
    d, dm = vectors(spark, 60, "doc_key", 2)
    want = brute(qm, dm, 5)
    assert as_set(dense.knn(q, d, 5)) == want
    monkeypatch.setattr(dense, "BLOCK_ROWS", 9)
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", 3)
    assert as_set(dense.knn(q, d, 5, broadcast_queries=2)) == want
    assert as_set(dense.knn(q, d, 5, min_score=0.35)) == brute(qm, dm, 5, min_score=0.35)


def test_many_queries_are_searched_some_at_a_time(spark, monkeypatch):
    """Query blocks beyond BLOCKS_AT_ONCE come later, so a vector is not sent once for every query block of the whole table."""
    (q, qm), (d, dm) = vectors(spark, 40, "query_id", 3), vectors(spark, 60, "doc_key", 4)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 7)
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", 4)
    monkeypatch.setattr(dense, "BLOCKS_AT_ONCE", 2)
    asked, blocked = [], dense._blocked_knn
    monkeypatch.setattr(dense, "_blocked_knn", lambda queries, *more: asked.append(queries.count()) or blocked(queries, *more))
    assert as_set(dense.knn(q, d, 3, broadcast_queries=2)) == brute(qm, dm, 3)
    assert len(asked) == 3 and sum(asked) == 40


def test_session_knn_with_one_hot_session(spark, monkeypatch):
    session = lambda i: "hot" if i % 3 else f"s{i % 5}"
    q, qm = vectors(spark, 9, "query_id", 3, session_id=session)
    d, dm = vectors(spark, 90, "doc_key", 4, session_id=session)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 10)
    got = as_set(dense.knn(q, d, 4, scope=["session_id"]))
    assert got == brute(qm, dm, 4, allowed=lambda i, j: session(i) == session(j))


def test_vector_cache_is_checked(spark, tmp_path):
    d, _ = vectors(spark, 6, "doc_key", 5)
    path = str(tmp_path / "v")
    dense.write_vectors(d, "m1", path)
    assert dense.restore_vectors(spark, path, "m1", d).count() == 6
    assert dense.restore_vectors(spark, path, "m2", d) is None
    assert dense.restore_vectors(spark, path, "m1", d.limit(5)) is None
    grown = d.select("doc_key").union(spark.createDataFrame([("new",)], "doc_key string"))
    assert dense.restore_vectors(spark, path, "m1", grown) is None


def test_hashing_embedder_is_unit_length(spark):
    rows = hashing_embedder(docs(spark, ["a b b", "c"])).collect()
    assert all(np.linalg.norm(r["embedding"]) == pytest.approx(1, abs=1e-5) for r in rows)
    assert dense.knn(hashing_embedder(queries(spark, ["b b a"])), hashing_embedder(docs(spark, ["a b b", "c"])), 1).first()["doc_key"] == "d00"


def test_cascade_layers(spark):
    d = docs(spark, ["alpha beta gamma delta", "beta words here", "omega"]).unionByName(
        spark.createDataFrame([("upload::0", "first upload"), ("upload::10", "later"), ("upload::2", "second")], "doc_key string, text string"))
    q = queries(spark, ["vector query", "beta gamma", "words omega unseen", "???"])
    qv = spark.createDataFrame([("q0", [1.0, 0.0])], "query_id string, embedding array<float>")
    v = spark.createDataFrame([("d02", [1.0, 0.0])], "doc_key string, embedding array<float>")
    got = {(r["query_id"], r["layer"], r["doc_key"]) for r in hybrid.cascade(q, d, qv, v, k=2, mode="dense").collect()}
    assert got == {("q0", "hybrid", "d02"), ("q1", "phrase", "d00"), ("q2", "keyword", "d01"), ("q2", "keyword", "d02"),
                   ("q3", "upload", "upload::0"), ("q3", "upload", "upload::2"), ("q3", "upload", "upload::10")}


def test_rerank_keeps_small_pools(spark):
    pool = spark.createDataFrame([("q0", "a", "nothing", 1), ("q0", "b", "wanted words", 2), ("q1", "c", "x", 1)], "query_id string, doc_key string, snippet string, rank int")
    q = queries(spark, ["wanted words", "y"])
    assert [(r["query_id"], r["doc_key"]) for r in hybrid.rerank(pool, q, 1).orderBy("query_id").collect()] == [("q0", "b"), ("q1", "c")]
    assert hybrid.rerank(pool, q, 1, scorer=None).orderBy("query_id").first()["doc_key"] == "a"


def test_running_numbers_of_a_hot_group(spark):
    from lexspark.operators.rows import number_in_order

    rows = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq int")
    got = {(r["k"], r["seq"]): r["n"] for r in number_in_order(df, ["k"], ["seq"], "n").collect()}
    count = {}
    for k, seq in sorted(rows):
        assert got[k, seq] == count.setdefault(k, 0)
        count[k] += 1
    assert sorted(r["n"] for r in number_in_order(df, [], ["seq", "k"], "n").collect()) == list(range(300))


def test_sessions(spark):
    rows = [("s1", "f", 1, "a", 1), ("s1", "f", 2, " ", 2), ("s1", "f", 3, "b", 3), ("s1", "g", 1, "c", 4), ("s2", "f", 1, "d", 9)]
    ups = spark.createDataFrame(rows, "session_id string, filename string, seq int, text string, ts int")
    chunks = session_chunks.append_chunks(ups)
    assert sorted(r["chunk_key"] for r in chunks.where("session_id = 's1'").collect()) == ["session::f::0", "session::f::1", "session::g::0"]
    assert {r["session_id"] for r in session_chunks.keep_recent_sessions(chunks, 1).collect()} == {"s2"}
