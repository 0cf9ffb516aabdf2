"""Work and memory of a task stay bounded when tables grow; results as by the plain definitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexspark import fixed_values as fv
from lexspark.functions import citations as c
from lexspark.operators import graph_build as gb, lexical_scores as ls, postings, relaxed_scores as rs, stored_index
from lexspark.plans import inputs as src


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def answers(spark):
    rng = random.Random(11)
    words = ["Exempting", "authorised", "fair", "valued", "es", "s", "£85,000", "uk", "mar", "UK MAR", "mlr", "£mlr", "rao_", "psr£", "é", "cooling", "off", "offs", "conflict", "of", "interests",
             "COBS 4.2.1r", "fsma 2000 s.19", "PSR reg. 77", "Mar  abuse", "principle 12", "MLR27", "complaint", "refunded", "Source: mar 5 | psr 77; COBS 3", "x"]
    seps = [" ", "  ", "\n", "-", "£", "_", ".", " | ", "\u00a0"]
    texts = ["", "s", "uk£mar", "uk mar£", "ing ed es s"] + ["".join(w for _ in range(rng.randint(1, 25)) for w in (rng.choice(words), rng.choice(seps))) for _ in range(400)]
    rows = [(i, t, i % 3 == 0) for i, t in enumerate(texts)] + [(len(texts), None, None)]
    return spark.createDataFrame(rows, "answer_id long, answer string, citations_ok boolean")


@pytest.mark.parametrize("name", ["orders", "part"])
def test_short_rows_are_dealt_out_by_number(spark, tmp_path, monkeypatch, name):
    """One row group of a file is many tasks, not one a core."""
    if name == "orders":
        rows = spark.range(100).selectExpr("id AS o_orderkey", "id AS o_custkey")
    else:
        rows = spark.range(100).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size")
    rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(src, "ROWS_A_TASK", 5)
    made = src.answers(spark, str(tmp_path)) if name == "orders" else src.provisions(spark, str(tmp_path))
    sizes = made.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 100 and len(sizes) >= 20 and max(r["count"] for r in sizes) <= 10


def test_terminology_by_its_definition(spark, answers):
    """No pattern is compiled or run per token or acronym."""
    stem = lambda w: re.sub(r"(ing|ed|es|s)$", "", w)
    for r in answers.select("answer", ls.legal_terminology(F.col("answer")).alias("legal"), rs.terminology(F.col("answer")).alias("relaxed")).collect():
        low = (r["answer"] or "").lower()
        stems = {stem(w) for w in re.findall(r"[a-z0-9£]+", low)}
        assert r["legal"] == sum(set(ls._stems_of(t)) <= stems for t in fv.LEGAL_TERMS) / len(fv.LEGAL_TERMS)
        text = " " + re.sub(r"(?:[^\w£])+", " ", low).strip() + " "
        found = sum(p in text for p in fv.RELAXED_PHRASES) + sum(bool(re.search(rf"(?<!\w){p}(?!\w)", text)) for p in fv.RELAXED_ACRONYMS)
        assert r["relaxed"] == min(1.0, found / 8.0)
    plan = plan_of(answers.select(ls.legal_terminology(F.col("answer")).alias("a"), rs.terminology(F.col("answer")).alias("b")))
    assert "regexp_extract_all" not in plan and "RLIKE" not in plan and plan.count("regexp_replace") <= 3


def test_source_tokens_are_spelled_once(spark, answers):
    """Blanks and case of a token are settled once, not once a rule; matches as by the plain list."""
    plan = plan_of(answers.select(c.normalise_source_token(F.col("answer")).alias("a")))
    assert plan.count("regexp_replace") == 1
    plain = "(?i)" + "|".join(f"(?:{p})" for p in fv.ALLOW_RELAXED)
    for r in answers.select("answer", c.relaxed_matches(F.col("answer")).alias("found"), c.has_relaxed_match(F.col("answer")).alias("any")).collect():
        want = [m.group(0) for m in re.finditer(plain, r["answer"] or "", re.ASCII)]
        assert (r["found"], r["any"]) == (want, bool(want))


def test_links_are_dealt_out_before_they_are_distinct(spark):
    """No hash table of links inside the scan; provisions that come twice still give a link once."""
    rows = [(f"P{i % 40}", f"FSMA 2000 s.{i % 7}", f"FSMA s.{i * 3 % 7} and FSMA section {i * 5 % 9}", "FSMA 2000") for i in range(80)]
    made = gb.cites_edges(spark.createDataFrame(rows, "id string, cite string, text string, document string"))
    plan = plan_of(made)
    assert "HashAggregate(keys=[src" in plan and plan.rindex("HashAggregate(keys=[src") < plan.index("REPARTITION_BY_NUM")
    rep, want = {}, set()
    for key, cite, _, _ in rows:
        rep[cite] = min(rep.get(cite, key), key)
    for key, own, text, _ in rows:
        want |= {(key, rep[x]) for n in re.findall(r"\d+", text) if (x := f"FSMA 2000 s.{n}") in rep and x != own}
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_lists_are_written_where_their_range_lies(spark, tmp_path, monkeypatch):
    """No list is exchanged or sorted between the indexing of a range and its files; a merged index finds the same."""
    docs = spark.createDataFrame([(f"d{i:03d}", " ".join(f"w{i * j % 37}" for j in range(1, 12))) for i in range(200)], "doc_key string, text string")
    asked = spark.createDataFrame([("q", "w1 w2 w36"), ("r", "w0")], "query_id string, text string")
    monkeypatch.setattr(stored_index, "RANGE", 16)
    plans, commit = [], stored_index.StoredIndex._commit
    monkeypatch.setattr(stored_index.StoredIndex, "_commit", lambda self, packed, *a, **k: plans.append(packed) or commit(self, packed, *a, **k))
    half = docs.where("doc_key < 'd100'")
    index = stored_index.StoredIndex.create(half, str(tmp_path / "index"), buckets=4)
    assert plan_of(plans[0]).count("Exchange") == 1 and "MapInArrow" in plan_of(plans[0]).split("Exchange")[0]
    files = [f for f in index._read_blocks().inputFiles() if "bucket=0" in f]
    assert 0 < len(files) <= plans[0].rdd.getNumPartitions()  # a file a task: each was open once
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    hits = lambda found: sorted(tuple(r) for r in found.select("query_id", "doc_key", "score", "rank").collect())
    want = hits(postings.bm25_scores(asked, docs, 5))
    grown = index.append(docs)
    assert hits(grown.bm25(asked, 5)) == want and hits(grown.merge().bm25(asked, 5)) == want
