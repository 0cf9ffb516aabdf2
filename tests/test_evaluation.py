import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexspark.functions.text import word_tokens
from lexspark.operators import curation, graph_build as gb, lexical_scores as ls, recall_diagnosis as rd, relaxed_scores as rs, summaries as sm
from lexspark.plans.evaluation import overlap_judge
from lexspark.plugins import run_generator, run_judge


def value(spark, row, build):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(build().alias("x")).first()["x"]


def test_plain_scores(spark):
    row = {"answer": "a b c", "ref": "b c d", "cites": "COBS 4|FSMA 2000 s.19|PRIN 12", "kw": "b|zz|two words"}
    a, r = (lambda: F.array_distinct(word_tokens(F.col("answer")))), (lambda: F.array_distinct(word_tokens(F.col("ref"))))
    assert value(spark, row, lambda: ls.jaccard(a(), r())) == 0.5
    assert value(spark, row | {"answer": "see cobs 4 and prin 12"}, lambda: ls.citation_match(F.col("answer"), F.col("cites"))) == pytest.approx(2 / 3)
    assert value(spark, row, lambda: ls.keyword_hits(F.col("answer"), F.col("kw"))) == pytest.approx(1 / 3)
    empty = {"answer": "", "ref": ""}
    assert value(spark, empty, lambda: ls.jaccard(a(), r())) == 0.0
    assert value(spark, empty, lambda: ls.jaccard(a(), r(), both_empty=1.0)) == 1.0


def test_lcs_against_the_table_method():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
        assert ls.lcs_length(a, b) == grid[-1][-1]


def test_rouge_and_similarity(spark):
    row = {"answer": "the cat sat", "ground_truth": "the cat on mat"}
    assert value(spark, row, lambda: ls.rouge_l(F.col("answer"), F.col("ground_truth"))) == pytest.approx(2 * 2 / 7)
    df = spark.createDataFrame([("1", "keep the records safe always", "keep records safe"), ("2", "", "x")], "qid string, answer string, ground_truth string")
    got = {r["qid"]: r["semantic_similarity"] for r in rs.similarity(df).collect()}
    assert got["1"] >= 0.6 and got["2"] == 0.0


def test_phrase_keywords(spark):
    row = {"answer": "The CDD checks covered impact tolerances.", "kw": "customer due diligence|impact tolerance|missing"}
    assert value(spark, row, lambda: ls.phrase_keyword_f1(F.col("answer"), F.col("kw"))) == pytest.approx(2 / 3)
    assert value(spark, row | {"kw": ""}, lambda: ls.phrase_keyword_f1(F.col("answer"), F.col("kw"))) == 1.0


def test_source_scores(spark):
    rows = spark.createDataFrame([("Source: mlr 27; COBS 4.2.1R; nonsense", None), ("no cites", None), ("see PRIN 12", True)], "answer string, citations_ok boolean")
    got = rs.source_scores(rows).collect()
    assert (got[0]["source_accuracy"], got[0]["citation_quality"], got[0]["citations_valid"]) == (0.85, 0.7, ["MLR 2017 reg.27", "COBS 4.2.1R"])
    assert (got[1]["source_accuracy"], got[1]["citation_quality"]) == (0.0, 0.0)
    assert got[2]["source_accuracy"] == 1.0


def test_summaries_skip_what_is_not_a_number(spark):
    rows = [(1.0, "", 2.0), (math.nan, "x", 1.0), (None, "", 0.5), (math.inf, None, 0.0)]
    df = spark.createDataFrame(rows, "m double, error string, runtime_s double")
    got = sm.summarise(df, ["m"]).first()
    assert (got["m_mean"], got["m_n_valid"], got["m_n_total"], got["errors"], got["runtime_total_s"]) == (1.0, 1, 4, 1, 3.5)
    none = sm.summarise(df.withColumn("m", F.lit(math.nan)), ["m"]).first()
    assert none["m_mean"] is None and none["m_n_valid"] == 0


def test_weighted_recall_of_real_and_stub_rows(spark):
    df = spark.createDataFrame([(0.6,)] * 10 + [(0.0,)] * 70, "r double")
    assert sm.overall_means(df, ["r"]).first()["r"] == 0.075


def test_stratified_sample(spark):
    df = spark.createDataFrame([(f"{i}", f"d{i % 3}") for i in range(30)], "qid string, domain string")
    got = rd.stratified_sample(df, 10, 17)
    assert got.count() == 10 and {r["domain"] for r in got.collect()} == {"d0", "d1", "d2"}
    assert sorted(r["qid"] for r in got.collect()) == sorted(r["qid"] for r in rd.stratified_sample(df.repartition(5), 10, 17).collect())
    assert rd.stratified_sample(df, 100, 17).count() == 30


def test_ngram_containment_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["ab", "cab", "b", "bc", "x", "é1"]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(25)]
    needles = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    d = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(docs)], "doc_key string, text string")
    n = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(needles)], "qid string, text string")

    def held(needle, text):
        w = needle.split()
        if len(w) < 3:
            return bool(w) and needle in text
        return any(" ".join(w[i:i + 3]) in text for i in range(len(w) - 2))

    want = {f"n{i}" for i, x in enumerate(needles) if any(held(x, t) for t in docs)}
    assert {r["qid"] for r in rd.ngram_in_corpus(n, d).collect()} == want
    own = spark.createDataFrame(list(zip(needles, docs * 3)), "a string, b string").select(rd.ngram_in_text(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r["x"] for r in own] == [held(a, b) for a, b in zip(needles, docs * 3)]


def test_curation_statuses(spark):
    graph = gb.build_graph(gb.sample_provisions(spark).withColumns({"document": F.lit(""), "regulator": F.lit("")}))
    docs = spark.createDataFrame([("d1", "zzqa zzqb zzqc zzqd are all inside this only document text.")], "doc_key string, text string")
    rows = [("1", "cdd?", "Gold-standard answer here", "mlr 2017 REG.27"), ("2", "zzqa zzqb zzqc zzqd", "TODO", ""), ("3", "qqqq", "tbd", ""), ("4", "x", "A real one", "PRIN 12")]
    q = spark.createDataFrame(rows, "query_id string, text string, gold_answer string, expected_citations string")
    got = {r["query_id"]: (r["curation_status"], r["curation_source_cites"]) for r in curation.curate(q, graph, docs).collect()}
    assert got == {"1": ("llm_drafted", "MLR 2017 reg.27"), "2": ("llm_drafted", "d1"), "3": ("needs_manual", ""), "4": ("kept_original", "PRIN 12")}
    dry = {r["curation_status"] for r in curation.curate(q, graph, docs, dry_run=True).collect()}
    assert dry == {"dry_run_skip", "kept_original"}


def test_judge_and_generator_isolate_failures(spark):
    rows = spark.createDataFrame([("1", "q", "an answer", ["an answer"], "ref", ""), ("2", "q", " ", ["c"], "ref", ""), ("3", "q", "a", ["c"], "ref", "timeout")],
                                 "qid string, question string, answer string, contexts array<string>, ground_truth string, error string")
    got = {r["qid"]: r["faithfulness"] for r in run_judge(rows, overlap_judge, ["faithfulness"]).collect()}
    assert got == {"1": 1.0, "2": None, "3": None}

    def factory():
        def model(question, contexts):
            if question == "bad":
                raise ValueError("no")
            return contexts[0]
        return model

    q = spark.createDataFrame([("a", "ok", ["ctx"]), ("b", "bad", ["ctx"])], "query_id string, question string, contexts array<string>")
    assert {tuple(r) for r in run_generator(q, factory).collect()} == {("a", "ctx", ""), ("b", "", "no")}


@pytest.mark.parametrize("min_words", [1, 2, 4])
def test_documents_sharing_words_against_brute_force(spark, min_words):
    rng = random.Random(min_words)
    letters = lambda n: "".join(rng.choice("abc") for _ in range(n))
    docs = [(f"d{i:02}", " ".join(["the", *(letters(rng.randint(1, 5)) for _ in range(rng.randint(0, 12)))])) for i in range(60)] + [("e0", None), ("e1", ""), ("e2", "THE!" * 300)]
    asked = [(f"q{i}", " ".join(["The", "the", *(letters(rng.randint(1, 4)) for _ in range(rng.randint(0, 8)))])) for i in range(25)] + [("n0", None), ("n1", "?"), ("n2", "never zzz seen here")]
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    want = {(q, d, n + 1) for q, text in asked
            for n, d in enumerate(sorted(d for d, body in docs if sum(w in (body or "").lower() for w in words(text)) >= min_words)[:2])}
    got = curation.documents_sharing_words(spark.createDataFrame(asked, "query_id string, text string"), spark.createDataFrame(docs, "doc_key string, text string"), min_words)
    assert {tuple(r) for r in got.collect()} == want and want


def test_common_words_find_no_candidates(spark):
    weighed = [("q", w, n) for w, n in (("the", 900), ("of", 900), ("a", 950), ("levy", 3), ("bank", 20))] + [("short", w, 1) for w in "xyz"]
    got = curation.prefix_words(spark.createDataFrame(weighed, "query_id string, word string, weight long"), 4).collect()
    assert {r["word"] for r in got if r["common"]} == {"the", "of", "a"} and {r["query_id"] for r in got} == {"q"}
