import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import graph_build as gb, graph_reports as gr, graph_walk as gw, session_chunks, verify
from lexspark.sources import sinks

COLUMNS = "id string, cite string, title string, text string, module string, domain string, terms string, threshold string, deadline string, document string, regulator string"


def provisions(spark, rows):
    full = [(i, cite, f"t {i}", text, "FCA", "D", terms, "", "", doc, "") for i, cite, text, terms, doc in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture
def small(spark):
    return provisions(spark, [
        ("A", "FSMA 2000 s.19", "See RAO art 5 and section 19 and FSMA s.999.", "Duty|risk", "FSMA 2000"),
        ("B", "RAO 2001 art.5", "Under article 25 and FSMA 2000 s.19.", "risk", "RAO 2001"),
        ("C1", "RAO 2001 art.25", "no reference", "", "RAO 2001"),
        ("C0", "RAO 2001 art.25", "second chunk", " duty ", "RAO 2001"),
    ])


def test_citation_edges(small):
    assert {tuple(r) for r in gb.citation_pairs(small).collect()} == {("A", "RAO 2001 art.5"), ("B", "RAO 2001 art.25"), ("B", "FSMA 2000 s.19")}
    assert {tuple(r) for r in gb.cites_edges(small).collect()} == {("A", "B"), ("B", "C0"), ("B", "A")}


def test_dimensions_and_upsert(spark, small):
    assert {tuple(r) for r in gb.mentions(small).collect()} == {("duty", "A"), ("risk", "A"), ("risk", "B"), ("duty", "C0")}
    assert gb.part_of(small).count() == 4 and gb.issued_by(small).count() == 4
    newer = small.where("id = 'A'").withColumn("title", F.lit("new"))
    merged = gb.upsert_provisions([small, newer, newer])
    assert merged.count() == 4 and merged.where("id = 'A'").first()["title"] == "new"
    assert gb.key_report(spark, small).where("duplicates > 0").isEmpty()
    assert gb.collect_sources(spark, "legacy").count() == 17


def test_walks(spark, small):
    g = gb.build_graph(small)
    seeds = spark.createDataFrame([("q", "FSMA 2000 s.19")], "query_id string, cite string")
    hops = {(r["related_id"], r["hops"]) for r in gw.two_hops(seeds, g).collect()}
    assert hops == {("B", 1), ("C0", 2)}
    assert {(r["related_id"], r["hops"]) for r in gw.two_hops(seeds, g, max_hops=3).collect()} == hops
    near = gw.one_hop(seeds, g).first()
    assert near["related_cites"] == ["RAO 2001 art.5"] and near["must_terms"] == ["duty", "risk"]
    root = spark.createDataFrame([("C0",)], "id string")
    paths = {r["id"]: r["path"] for r in gw.cite_paths(gw.shortest_paths(root, g), g).collect()}
    assert paths["A"] == "RAO 2001 art.25 > RAO 2001 art.5 > FSMA 2000 s.19"


def test_hub_term_keeps_the_nearest_exactly(spark):
    """A term on every provision: truncated lists must not change the result."""
    rows = [(f"p{i:03d}", f"PRIN {i:03d}", "plain", "hub" if i else "hub|own", "") for i in range(80)]
    rows += [("z1", "PRIN 900", "See PRIN 000.", "own", "")]
    g = gb.build_graph(provisions(spark, rows))
    seeds = g.provisions.select(F.col("id").alias("query_id"), "cite")
    got = {(r["seed_id"], r["related_id"], r["hops"]) for r in gw.two_hops(seeds, g, limit=5).collect()}
    link = {("z1", "p000"), ("p000", "z1")}
    terms = {r[0]: set(r[3].split("|")) for r in rows}
    cite = {r[0]: r[1] for r in rows}
    neighbours = {s: {o for a, o in link if a == s} for s in terms}
    want = set()
    for s in terms:
        two = {o2 for o in neighbours[s] for o2 in neighbours[o]} | {o for o in terms if terms[s] & terms[o]}
        ranked = sorted([(1, cite[o], o) for o in neighbours[s]] + [(2, cite[o], o) for o in two - neighbours[s] - {s}])
        want |= {(s, o, h) for h, _, o in ranked[:5]}
    assert got == want


def test_search_and_boost(spark):
    g = gb.build_graph(gb.sample_provisions(spark).withColumns({"document": F.lit(""), "regulator": F.lit("")}), gb.default_defined_by_pairs(spark))
    q = spark.createDataFrame([("q", "general prohibition on regulated activity")], "query_id string, text string")
    boost = gw.graph_boost(q, g).first()
    assert boost["source_line"].startswith("FSMA 2000 s.19")
    assert "regulated activity" in boost["must_terms"] and boost["context_md"].startswith("**Graph hits:**\n- **FSMA 2000 s.19**")
    assert gr.most_cited(g, 3).isEmpty()
    texts = gr.provision_texts(spark.createDataFrame([("prin 12",)], "cite string"), g.provisions, ignore_case=True).first()
    assert texts["found_cite"] == "PRIN 12"


def audit(spark, small, answer, context=(), chunks=(), **kw):
    rows = spark.createDataFrame([("a", answer, list(context), list(chunks))], "answer_id string, answer string, context_cites array<string>, chunk_cites array<string>")
    return verify.audit_citations(rows, small, **kw).first()


def test_audits(spark, small):
    good = audit(spark, small, "Under RAO 2001 art.5.", context=["RAO 2001 art.5"])
    assert good["all_grounded"] and good["all_retrieved"] and good["verified"] == ["RAO 2001 art.5"] and good["warning"] is None
    mixed = audit(spark, small, "RAO 2001 art.5 and PSR 2017 reg.12", context=["RAO 2001 art.5"])
    assert mixed["unverified"] == ["PSR 2017 reg.12"] and not mixed["all_grounded"] and mixed["hallucinated_context"] == ["PSR 2017 reg.12"]
    assert mixed["warning"].startswith("Citation(s) not present in retrieved sources: PSR 2017 reg.12.")
    assert audit(spark, small, "no citation")["note"] == "no_citations"
    down = audit(spark, small, "PSR 2017 reg.12", chunks=[" "])
    assert down["note"] == "graph_unavailable" and down["all_grounded"] and down["unverified"] == []
    strict = audit(spark, small, "PSR 2017 reg.12", fail_open=False)
    assert not strict["all_grounded"] and strict["unverified"] == ["PSR 2017 reg.12"]


def test_claim_trace(spark, small):
    rows = spark.createDataFrame([("a", "The second chunk says nothing else. Unrelated sentence without any words.", ["RAO 2001 art.25", "RAO 2001 art.5"])],
                                 "answer_id string, answer string, cites array<string>")
    got = verify.trace_claims(rows, small).orderBy("claim_no").collect()
    assert (got[0]["best_cite"], got[0]["score"]) == ("RAO 2001 art.25", 2)
    assert got[1]["best_cite"] is None and got[1]["score"] is None


def test_full_audit(spark, small):
    rows = spark.createDataFrame([("a", "What is the general prohibition?", "Short.", "FSMA 2000 s.19", [])],
                                 "answer_id string, question string, answer string, source_line string, chunk_cites array<string>")
    got = verify.audit_answers(rows, small).first()
    assert got["final_answer"].startswith("The UK general prohibition") and got["citations_ok"]
    assert got["verified"] == ["FSMA 2000 s.19", "RAO 2001 art.5"] and got["claim_trace"][0]["claim_no"] == 0


@pytest.mark.parametrize("max_hops, limit", [(3, 7), (4, 40)])
def test_many_hops_against_a_search_by_levels(spark, max_hops, limit):
    """Links in a long chain with branches, and a term on a third of all provisions."""
    rng = random.Random(max_hops)
    n = 60
    cites = [f"PRIN {rng.randrange(100, 999)}{i:02d}" for i in range(n)]
    body = lambda i: " ".join(f"See {cites[j]}." for j in {min(i + 1, n - 1), rng.randrange(n)} if rng.random() < 0.7) or "plain"
    rows = [(f"p{i:02d}", cites[i], body(i), "|".join(["hub"] * (i % 3 == 0) + [f"t{i // 2}"] * (i % 5 == 0)), "") for i in range(n)]
    g = gb.build_graph(provisions(spark, rows))
    links = {(r["src"], r["dst"]) for r in g.links.collect()}
    assert links
    around = {}
    for a, b in links | {(r[0], f"term:{t}") for r in rows for t in r[3].split("|") if t}:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    cite, want = dict((r[0], r[1]) for r in rows), set()
    seeds = [r[0] for r in rows[::4]]
    for seed in seeds:
        seen, level = {seed: 0}, [seed]
        for hop in range(1, max_hops + 1):
            level = [x for x in {y for u in level for y in around.get(u, ())} if x not in seen]
            seen.update((x, hop) for x in level)
        near = sorted((h, cite[x], x) for x, h in seen.items() if h and x in cite)[:limit]
        want |= {(cite[seed], seed, x, h) for h, _, x in near}
    asked = spark.createDataFrame([(cite[s], cite[s]) for s in seeds], "query_id string, cite string")
    got = gw.two_hops(asked, g, limit=limit, max_hops=max_hops).collect()
    assert {(r["query_id"], r["seed_id"], r["related_id"], r["hops"]) for r in got} == want and len(got) == len(want)
    assert max(h for *_, h in want) == max_hops


def test_limits_of_reports_can_be_taken_off(spark):
    rows = [(f"p{i:02}", f"COBS {i}", f"t{i}", "about a levy", "FCA", "FCA") for i in range(45)]
    provisions = spark.createDataFrame(rows, "id string, cite string, title string, text string, regulator string, module string")
    assert gr.provisions_of_regulator(provisions, "FCA").count() == 20 and gr.provisions_of_regulator(provisions, "FCA", None).count() == 45
    runs = spark.createDataFrame([(f"r{i:02}", i) for i in range(40)], "run_id string, x int")
    assert sinks.list_runs(runs, runs.limit(1)).count() == 30 and sinks.list_runs(runs, runs.limit(1), None).count() == 40
    chunks = spark.createDataFrame([(f"s{i}", i) for i in range(25)], "session_id string, ts int")
    assert session_chunks.keep_recent_sessions(chunks).count() == 20 and session_chunks.keep_recent_sessions(chunks, None).count() == 25
