"""Work that must not grow with (query, document) pairs, and whole results all the same."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from lexspark.operators import curation, graph_build, graph_walk, postings, stored_index


def texts(n, seed):
    rng = random.Random(seed)
    return [(f"d{i:03d}", " ".join(rng.choice(["the", "a", "wide", "rule", "fund", "risk", f"x{rng.randrange(30)}"]) for _ in range(rng.randrange(1, 12)))) for i in range(n)]


def test_scan_gives_no_pair_rows_and_the_same_ranks(spark):
    rows = texts(60, 1)
    rows += rows[:5] + [(None, "the rule"), ("d900", None), ("d901", "")]
    docs = spark.createDataFrame(rows, "doc_key string, text string").repartition(3)
    asked = {"q1": "the rule the", "q2": "x1 x2 x3 fund", "q3": "unknown"}
    questions = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    word = lambda t: re.findall("[a-z0-9£]+", (t or "").lower())
    tf, lens = defaultdict(Counter), {}
    for key, text in rows:
        tf[key].update(word(text))
        lens[key] = len(word(text))
    df = Counter(t for _, text in rows for t in set(word(text)))
    known = [r for r in rows if r[1] is not None]
    raw = {t: math.log(len(rows) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    avgdl = sum(len(word(t)) for _, t in known) / len(rows)
    hits = postings.bm25_scores(questions, docs, 4)
    plan = hits._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "HashAggregate(keys=[doc_key" not in plan
    got = defaultdict(list)
    for r in hits.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_key"], r["score"]))
    for q, text in asked.items():
        scores = {}
        for key, counts in tf.items():
            parts = [n * (floor if raw[t] < 0 else raw[t]) * counts[t] * 2.5 / (counts[t] + 1.5 * (0.25 + 0.75 * lens[key] / avgdl)) for t, n in Counter(word(text)).items() if counts[t]]
            if parts:
                scores[key] = round(sum(parts), 4)
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:4]
        assert [s for _, s in got[q]] == [s for _, s in want] or all(abs(a[1] - b[1]) < 2e-4 for a, b in zip(got[q], want, strict=True))


def test_overlap_counts_documents_over_ends_of_batches(spark):
    rows = [(f"k{i // 3}", f"a b{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_key string, text string")
    questions = spark.createDataFrame([("q", "a b7 b8")], "query_id string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [(r["doc_key"], r["score"]) for r in postings.keyword_overlap(questions, docs, 3).orderBy("rank").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [("k2", 5), ("k0", 3), ("k1", 3)]


def test_documents_are_searched_in_key_order(spark, monkeypatch):
    monkeypatch.setattr(curation, "FIRST_KEYS", 7)
    rows = texts(50, 2)
    docs = spark.createDataFrame(rows, "doc_key string, text string")
    asked = {"q1": "the wide rule fund", "q2": "x1 x2 the a rule", "q3": "he x2 un is", "q4": "no such words here"}
    questions = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    got = defaultdict(list)
    for r in curation.documents_sharing_words(questions, docs).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["doc_key"])
    for q, text in asked.items():
        assert got[q] == [key for key, t in rows if sum(w in t for w in set(text.split())) >= 4][:2]


def test_ranges_are_indexed_where_they_lie():
    docs = [(0, "a", ["x", "y", "x"]), (0, "b", None), (0, "c", ["y"] * 5), (3, "d", ["z", "x"]), (3, "e", []), (3, "f", ["x"])]
    table = pa.table({"range_no": pa.array([d[0] for d in docs], pa.int64()), "doc_key": [d[1] for d in docs], "chars": pa.array([1] * 6, pa.int64()),
                      "toks": pa.array([d[2] for d in docs], pa.list_(pa.string()))})
    batches = table.slice(0, 2).to_batches() + table.slice(2, 3).to_batches() + table.slice(5).to_batches()
    got = {(r["range_no"], r["tok"]): r for b in stored_index._blocks_of_ranges(iter(batches)) for r in b.to_pylist()}
    assert set(got) == {(0, ""), (0, "x"), (0, "y"), (3, ""), (3, "x"), (3, "z")}
    assert (got[0, ""]["keys"], got[0, ""]["lens"], got[0, ""]["chars"]) == (["a", "b", "c"], [3, None, 5], 3)
    y = got[0, "y"]
    assert (y["docs"], y["tfs"], y["lens"], y["positions"]) == ([0, 2], [1, 5], [3, 5], [[1], [0, 1, 1, 1, 1]])
    assert sorted(zip(y["impact_tf"], y["impact_len"])) == [(1, 3), (5, 5)]
    x = got[3, "x"]
    assert (x["docs"], x["tfs"], x["lens"], x["positions"]) == ([0, 2], [1, 1], [2, 1], [[1], [0]])
    assert (x["impact_tf"], x["impact_len"]) == ([1], [1])


def test_one_hop_moves_no_question_per_chunk(spark):
    rows = [(f"p{i}", "A" if i < 6 else f"B{i}") for i in range(12)]
    provisions = spark.createDataFrame(rows, "id string, cite string")
    mentions = [(f"t{i % 4}", f"p{i}") for i in range(12) if i != 11]
    links = [(f"p{i}", f"p{(i * 5 + 1) % 12}", "CITES") for i in range(11)]
    graph = graph_build.Graph(provisions, spark.createDataFrame(mentions, "term string, id string"), spark.createDataFrame(links, "src string, dst string, type string"))
    seeds = [("q1", "A"), ("q1", "B7"), ("q2", "A"), ("q3", "none"), ("q4", "B11")]
    found = graph_walk.one_hop(spark.createDataFrame(seeds, "query_id string, cite string"), graph)
    got = {r["query_id"]: (r["must_terms"], r["related_cites"]) for r in found.collect()}
    cite, want = dict(rows), {}
    for q in ("q1", "q2", "q4"):
        ids = {i for i, c in rows if (q, c) in seeds}
        want[q] = (sorted({t for t, i in mentions if i in ids}), sorted({cite[d] for s, d, _ in links if s in ids}))
    assert got == want
    assert "keys=[query_id" not in found._jdf.queryExecution().sparkPlan().toString().split("Union", 1)[1]
