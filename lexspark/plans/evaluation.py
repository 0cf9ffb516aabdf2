"""Registered queries of the evaluation group (keys f*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark import fixed_values as fv
from lexspark.functions import citations as c
from lexspark.functions.text import complexity_label, lemma_tokens, stem_tokens, word_tokens
from lexspark.operators import answering, curation, graph_build as gb, hybrid, lexical_scores as ls
from lexspark.operators import recall_diagnosis as rd, relaxed_scores as rs, summaries as sm
from lexspark.plans import inputs as src
from lexspark.plans.graph import _BASE as GRAPH_SQL, boost_sql
from lexspark.plans.inputs import ANSWERS_SQL, CORPUS_SQL, QUERY_VECTORS_SQL, QUESTIONS_SQL, RECORDS_SQL, VECTORS_SQL, sql_quote, sql_tokens
from lexspark.plans.retrieval import _hybrid_sql, contexts_sql
from lexspark.plans.text_rules import _FOLD, _PLAIN, sql_has_line, sql_invalid, sql_lemmas, sql_penalty, sql_source_line, sql_source_token, sql_stems
from lexspark.plans.verification import sql_claims, sql_content_set
from lexspark.plugins import run_judge

QUERIES, ORACLE = {}, {}

_EXPECTED = [
    "CASE domain WHEN 'c0' THEN 'the|consumer duty|that' WHEN 'c1' THEN ' de |Les|impact tolerance' WHEN 'c2' THEN '' ELSE 'und|ing|of|due diligence|the' END AS expected_keywords",
    "CASE domain WHEN 'c3' THEN '' ELSE 'the |ou|FSMA 2000 s.19' END AS expected_citations",
]
_SCORED = [
    "answer_id", "answer", "question", "context_line || '| COBS 4.2.1r |PRIN 12' AS expected_citations",
    "CASE answer_id % 3 WHEN 0 THEN 'trade|Records|five years|financial promotion' WHEN 1 THEN 'Consumer Duty|retail clients| stands ' ELSE '' END AS expected_keywords",
    "'Firms apply the section rules when they trade with retail clients.' AS ground_truth", "answer_id % 4 <> 0 AS citations_ok",
    "CASE answer_id % 3 WHEN 0 THEN 'Amber' WHEN 1 THEN ' Red ' ELSE 'Green' END AS expected_risk",
]
_RESULTS = [
    "event_id", "event_type AS domain", "CASE user_id % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'Mid' WHEN 2 THEN 'hard' ELSE 'expert' END AS complexity",
    "CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 11 = 0 THEN NULL ELSE value END AS m1",
    "CASE WHEN user_id % 3 = 0 THEN value / 2 END AS m2", "CAST('NaN' AS DOUBLE) AS m3", "value AS runtime_s",
    "CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END AS error", "CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(user_id * 10 AS STRING) END AS latency_ms",
]
_RESULTS_SQL = f"SELECT {', '.join(_RESULTS)} FROM events"
_SCORED_SQL = f"SELECT {', '.join(_SCORED)} FROM ({ANSWERS_SQL})"
_REC_SQL = f"SELECT *, {', '.join(_EXPECTED)} FROM ({RECORDS_SQL})"
_LABELS = ["doc_id", "CASE WHEN toxic = 1 THEN 'noncompliant' WHEN quality = 1 THEN 'Compliant' ELSE 'potential_issue' END AS compliance_class"]


def _records(spark, sf):
    return src.records(spark, sf).selectExpr("*", *_EXPECTED)


def _scored(spark, sf):
    return src.answers(spark, sf).selectExpr(*_SCORED)


def _results(spark, sf):
    return src.table(spark, sf, "events").selectExpr(*_RESULTS)


def _labelled(spark, sf):
    labels = src.table(spark, sf, "labels").selectExpr(*_LABELS)
    docs = src.table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    return labels.join(docs, "doc_id")


def _f1(spark, sf):
    a, g = F.col("answer"), F.col("ground_truth")
    sets = lambda fn: (F.array_distinct(fn(a)), F.array_distinct(fn(g)))
    return _records(spark, sf).select(
        "qid", F.round(ls.jaccard(*sets(word_tokens)), 4).alias("plain"), F.round(ls.jaccard(*sets(stem_tokens), both_empty=1.0), 4).alias("stemmed"),
        F.round(ls.jaccard(*sets(lemma_tokens)), 4).alias("relaxed"))


def _f2(spark, sf):
    return _records(spark, sf).select("qid", F.round(ls.rouge_l(F.col("answer"), F.col("ground_truth")), 4).alias("rouge_l"))


def _f5(spark, sf):
    scored = ls.lexical_scores(_records(spark, sf))
    return scored.select("qid", "lex_jaccard", "lex_rouge_l", "lex_citation_match", "lex_keyword_f1")


def _f6(spark, sf):
    a, k = F.col("answer"), F.col("expected_keywords")
    return _scored(spark, sf).select("answer_id", F.round(ls.phrase_keyword_f1(a, k), 4).alias("keyword_f1"), F.round(ls.phrase_completeness(a, k), 4).alias("completeness"))


def _f7(spark, sf):
    a = F.col("answer")
    return _scored(spark, sf).select("answer_id", F.round(ls.legal_terminology(a), 4).alias("legal"), F.round(rs.terminology(a), 4).alias("relaxed"))


def _f8(spark, sf):
    a, g = F.col("answer"), F.col("ground_truth")
    rows = _records(spark, sf).select("qid", ls.rouge_l(a, g).alias("r"), ls.jaccard(F.array_distinct(stem_tokens(a)), F.array_distinct(stem_tokens(g)), 1.0).alias("j"))
    return rows.select("qid", F.round(ls.blended_similarity(F.col("r"), F.col("j")), 4).alias("blend"))


def _f9(spark, sf):
    return ls.citation_scores(_scored(spark, sf), meta_ok=F.col("citations_ok")).select("answer_id", "citation_quality", "source_accuracy")


def _f10(spark, sf):
    return rs.keyword_scores(_records(spark, sf)).select("qid", "n_keys", "legal_completeness", "keyword_f1_score")


def _f10_similarity(spark, sf):
    return rs.similarity(_records(spark, sf)).select("qid", "semantic_similarity")


def _f11(spark, sf):
    rows = rs.source_scores(_scored(spark, sf))
    return rows.select("answer_id", "source_line", "source_accuracy", "citation_quality", F.array_join("citations_valid", " | ").alias("valid"), F.array_join("citations_all", " | ").alias("found"))


def _f12(spark, sf):
    rows = ls.citation_scores(_scored(spark, sf))
    return rows.select("answer_id", ls.risk_found(F.col("answer"), F.col("expected_risk")).alias("risk_found"), ls.bullet_structure(F.col("answer")).alias("structure"), "citation_quality")


def _f13(spark, sf):
    return sm.summarise(_results(spark, sf), ["m1", "m2", "m3"])


def _f15(spark, sf):
    return sm.score_by_complexity(_results(spark, sf), ["missing", "m3", "m2"]).withColumn("report", F.lit("complexity")).unionByName(
        sm.score_by_compliance(_labelled(spark, sf), ["n_chars"]).withColumn("report", F.lit("compliance")))


def _f17_shares(spark, sf):
    return sm.category_shares(_labelled(spark, sf), sm.compliance_label(F.col("compliance_class")))


def _ablation_runs(spark, sf):
    q, docs, index = src.questions(spark, sf), src.corpus(spark, sf), src.stored_index(spark, sf)
    runs = {}
    for mode in ("rrf", "dense", "bm25"):
        hits = hybrid.hybrid_search(q, docs, src.query_vectors(spark, sf), src.vectors(spark, sf), k=fv.TOP_K, mode=mode, index=index)
        asked = q.select("query_id", F.lower("text").alias("asked"))
        found = hits.select("query_id", "doc_key").join(docs, "doc_key").join(asked, "query_id").withColumn("hit", F.contains(F.lower("text"), F.col("asked")).cast("double"))
        per_q = found.groupBy("query_id").agg(F.max("hit").alias("context_recall"), F.avg("hit").alias("context_precision"))
        runs[mode] = q.select("query_id").join(per_q, "query_id", "left")
    return runs


def _f20(spark, sf):
    metrics = {"recall": "context_recall", "precision": "context_precision"}
    return sm.ablation_table(_ablation_runs(spark, sf), metrics, counted="context_recall")


def _f21(spark, sf):
    return rd.stratified_sample(src.records(spark, sf), 24, 17).select("qid", "domain")


def _f21_sources(spark, sf):
    rows = src.records(spark, sf).withColumnRenamed("domain", "source_file")
    return rd.sample_per_source(rows, 3, 42).select("qid", "source_file")


def _needles(spark, sf):
    items = src.questions(spark, sf).select(F.concat(F.lit("q"), "query_id").alias("qid"), "text")
    names = src.table(spark, sf, "part").select(F.col("p_name").alias("qid"), F.col("p_name").alias("text")).distinct()
    nations = src.table(spark, sf, "region").select(F.col("r_name").alias("qid"), F.lower(F.left("r_name", F.lit(2))).alias("text"))
    return items.unionByName(names).unionByName(nations)


def _f22(spark, sf):
    return rd.ngram_in_corpus(_needles(spark, sf), src.corpus(spark, sf))


def _diagnosis_rows(spark, sf):
    gold = F.when(F.col("domain").isin("c0", "c5"), F.concat(F.lit("Gold-standard answer for "), "domain")).otherwise(F.col("ground_truth"))
    return src.records(spark, sf).withColumn("ground_truth", gold).withColumn("contexts_text", F.col("answer"))


def _f23(spark, sf):
    return rd.diagnose(rd.stratified_sample(_diagnosis_rows(spark, sf), 10, 17), src.corpus(spark, sf))


def _f23_verdict(spark, sf):
    rows = _diagnosis_rows(spark, sf)
    return rd.verdict(_f23(spark, sf), rows.withColumnRenamed("ground_truth", "gold_answer"))


_CURATE = ["query_id", "text", "CASE WHEN CAST(query_id AS INT) % 4 = 3 THEN 'A real answer.' ELSE 'TODO' END AS gold_answer",
           "CASE WHEN CAST(query_id AS INT) % 3 = 0 THEN 'fsma 2000 S.' || query_id || ', COBS 99' ELSE '' END AS expected_citations"]


def _curation_input(spark, sf):
    return src.questions(spark, sf).selectExpr(*_CURATE)


def _f24_sources(spark, sf):
    todo = _curation_input(spark, sf).where("gold_answer = 'TODO'")
    graph = gb.build_graph(src.provisions(spark, sf))
    return curation.gather_sources(todo, graph, src.corpus(spark, sf)).select("query_id", "layer", "pos", "label")


def _f24(spark, sf):
    graph = gb.build_graph(src.provisions(spark, sf))
    return curation.curate(_curation_input(spark, sf), graph, src.corpus(spark, sf)).select("query_id", "gold_answer", "curation_status", "curation_source_cites")


def _answered(spark, sf):
    graph = gb.build_graph(src.provisions(spark, sf))
    return answering.answer_questions(src.questions(spark, sf), src.corpus(spark, sf), src.query_vectors(spark, sf), src.vectors(spark, sf), graph, index=src.stored_index(spark, sf))


def _f25(spark, sf):
    return _answered(spark, sf).select("query_id", "answer", F.size("contexts").alias("n_contexts"), "source_line", "refused", "error")


_METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]


def overlap_judge():
    """A stand-in judge: word overlaps. It fails on answers without words, as a
    model may, which must only cost that row its scores."""

    def words(text):
        return set((text or "").lower().split())

    def share(part, whole):
        return len(words(part) & words(whole)) / len(words(part))

    def judge(row):
        contexts = " ".join(row["contexts"]) if row["contexts"] is not None else ""
        return {"faithfulness": share(row["answer"], contexts), "answer_relevancy": share(row["question"], row["answer"]),
                "context_precision": share(contexts, row["ground_truth"]) if contexts else float("nan"), "context_recall": share(row["ground_truth"], contexts)}

    return judge


def _f26(spark, sf):
    rows = src.records(spark, sf).withColumn("contexts", F.split("answer", "\n")).withColumn("error", F.when(F.col("domain") == "c9", "timeout"))
    return run_judge(rows, overlap_judge, _METRICS)


QUERIES.update({
    "f1_jaccard": _f1, "f2_rouge_l": _f2,
    "f3_citation_match": lambda s, sf: _scored(s, sf).select("answer_id", F.round(ls.citation_match(F.col("answer"), F.col("expected_citations")), 4).alias("citation_match")),
    "f4_keyword_f1": lambda s, sf: _records(s, sf).select("qid", F.round(ls.keyword_hits(F.col("answer"), F.col("expected_keywords")), 4).alias("keyword_f1")),
    "f5_lexical_scores": _f5, "f6_phrase_keywords": _f6, "f7_terminology": _f7, "f8_blended_similarity": _f8, "f9_citation_quality": _f9,
    "f10_relaxed_keywords": _f10, "f10_relaxed_similarity": _f10_similarity, "f11_source_scores": _f11, "f12_task_scores": _f12, "f13_summary": _f13,
    "f14_overall_means": lambda s, sf: sm.overall_means(_results(s, sf), ["m1", "m2", "m3"]),
    "f14_domain_means": lambda s, sf: sm.means_by(_results(s, sf), "domain", ["m1", "m2", "m3"]),
    "f15_category_means": _f15,
    "f15_top_domains": lambda s, sf: sm.top_domains(_results(s, sf).withColumn("domain", F.concat("domain", F.lit("/"), "complexity")), F.col("m1")),
    "f16_metric_matrix": lambda s, sf: sm.metric_matrix(_results(s, sf), ["m1", "m2", "m3"]),
    "f17_category_counts": lambda s, sf: sm.category_counts(_results(s, sf), complexity_label(F.col("complexity")), fv.COMPLEXITY_ORDER),
    "f17_category_shares": _f17_shares,
    "f18_invalid_audit": lambda s, sf: ls.invalid_audit(_scored(s, sf)),
    "f19_run_manifest": lambda s, sf: sm.run_manifest(_results(s, sf).withColumn("latency_number", F.col("latency_ms")), ["m1", "m2", "latency_number"]),
    "f20_ablation": _f20, "f21_stratified_sample": _f21, "f21_sample_per_source": _f21_sources, "f22_ngram_containment": _f22,
    "f23_recall_diagnosis": _f23, "f23_verdict": _f23_verdict, "f24_curation_sources": _f24_sources, "f24_curation": _f24,
    "f25_batch_answers": _f25, "f26_judged_scores": _f26,
})

# --- DuckDB twins --------------------------------------------------------
def _jac(a: str, b: str, both: str = "0.0") -> str:
    n = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {n} = 0 THEN {both} ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / {n} END"


def _items(col: str) -> str:
    return f"list_filter(list_transform(string_split({col}, '|'), lambda x: trim(x)), lambda x: x <> '')"


def _share(items: str, test: str, empty: str) -> str:
    return f"CASE WHEN len({items}) = 0 THEN {empty} ELSE len(list_filter({items}, lambda k: {test})) / len({items}) END"


def _has(stems: str, toks: str = "toks") -> str:
    return f"list_has_all({toks}, {stems})"


def _lit_list(words) -> str:
    return "[" + ", ".join(sql_quote(w) for w in words) + "]" if words else "[]::VARCHAR[]"


def _phrase_test() -> str:
    tests = [_has(sql_stems("k"))]
    for phrase, others in fv.KEYWORD_SYNONYMS.items():
        any_of = " OR ".join(_has(_lit_list(ls._stems_of(o))) for o in others)
        tests.append(f"(lower(k) = '{phrase}' AND ({any_of}))")
    return "(" + " OR ".join(tests) + ")"


def _lcs(a: str, b: str) -> str:
    """Longest common subsequence by the textbook table: one row of it per word of b, whose cells are running maxima."""
    cells = f"list_transform(range(1, len({a}) + 1), lambda j: greatest(above[j], eq[j] + CASE WHEN j = 1 THEN 0 ELSE above[j - 1] END))"
    row = f"list_transform([{cells}], lambda c: list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])))[1]"
    marks = f"list_transform({b}, lambda w: list_transform({a}, lambda x: CAST(x = w AS BIGINT)))"
    return f"list_reduce({marks}, lambda above, eq: {row}, list_transform({a}, lambda x: CAST(0 AS BIGINT)))[-1]"


def _rouge(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 2.0 * {_lcs(a, b)} / (len({a}) + len({b})) END"


_KW_DISTINCT = f"list_distinct(list_transform({_items('expected_keywords')}, lambda x: lower(x)))"
_CLEAN = "CASE WHEN isnan({0}) OR isinf({0}) THEN NULL ELSE {0} END"
_SUM = ", ".join(f"round(avg({_CLEAN.format(m)}), 4) AS {m}_mean, count({_CLEAN.format(m)}) AS {m}_n_valid, count(*) AS {m}_n_total" for m in ("m1", "m2", "m3"))
_MEANS = ", ".join(f"round(avg({_CLEAN.format(m)}), 4) AS {m}" for m in ("m1", "m2", "m3"))
_LEVEL = "CASE lower(trim(complexity)) WHEN 'adv' THEN 'advanced' WHEN 'hard' THEN 'advanced' WHEN 'mid' THEN 'intermediate' WHEN 'easy' THEN 'basic' ELSE lower(trim(complexity)) END"
_CLASS = "CASE compliance_class WHEN 'noncompliant' THEN 'Non-compliant' WHEN 'potential_issue' THEN 'Potential issue' ELSE compliance_class END"
_LAB_SQL = f"SELECT l.*, d.lang, CAST(n_chars AS DOUBLE) AS n_chars FROM (SELECT {', '.join(_LABELS)} FROM labels) l JOIN documents d USING (doc_id)"
_ORD = "(VALUES (0, 'basic'), (1, 'intermediate'), (2, 'advanced')) o(ord, category)"
_ORDC = "(VALUES (0, 'Compliant'), (1, 'Potential issue'), (2, 'Non-compliant')) o(ord, category)"

_SYN_SQL = " ".join(f"WHEN '{k}' THEN {_lit_list(v)}" for k, v in fv.RELAXED_SYNONYMS.items())
_KEYS_SQL = f"""r AS ({_REC_SQL}), gt AS (SELECT qid, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT qid, {sql_lemmas('ground_truth')} AS toks FROM r)),
  gc AS (SELECT qid, tok, count(*) AS n, min(pos) AS pos FROM gt GROUP BY ALL), gr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, pos) AS k FROM gc),
  top AS (SELECT qid, list(tok) AS top FROM gr WHERE k <= 12 GROUP BY qid),
  kk AS (SELECT r.*, coalesce(top, []) AS top, list_transform({_items('expected_keywords')}, lambda x: lower(x)) AS kws FROM r LEFT JOIN top USING (qid)),
  kx AS (SELECT *, list_filter(list_distinct(list_concat(list_concat(kws, flatten(list_transform(kws, lambda k: CASE k {_SYN_SQL} ELSE [] END))), top)), lambda k: len(k) >= 3 AND NOT regexp_matches(k, '^\\p{{N}}+$')) AS keys, {sql_lemmas('answer')} AS atoks FROM kk)"""


def _lemma_words(col: str) -> str:
    from lexspark.plans.text_rules import _LEMMA
    return f"list_distinct(list_transform(list_filter(string_split({_PLAIN.format(col)}, ' '), lambda w: w <> ''), lambda w: {_LEMMA}))"


_CREDIT = f"CASE WHEN list_has_all(atoks, {_lemma_words('k')}) THEN 1.0 WHEN len({_lemma_words('k')}) > 1 AND list_has_any(atoks, {_lemma_words('k')}) THEN 0.5 ELSE 0.0 END"
_FIND = "split AS (SELECT *, list_filter(regexp_split_to_array(source_line, '\\s*[|;,/]\\s*'), lambda p: trim(p) <> '') AS pcs FROM sl)"
_RELAX_RE = "(?i)" + "|".join(f"(?:{p})" for p in fv.ALLOW_RELAXED)
_ACRO = " + ".join(f"CAST(regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{N}}_]){p}(?:$|[^\\p{{L}}\\p{{N}}_])') AS INT)" for p in fv.RELAXED_ACRONYMS)
_PHR = " + ".join(f"CAST(contains(t, {sql_quote(p)}) AS INT)" for p in fv.RELAXED_PHRASES)
_LEGAL = " + ".join(f"CAST({_has(_lit_list(ls._stems_of(p)))} AS INT)" for p in fv.LEGAL_TERMS)


def _sample_sql(source: str, k: int, seed: int) -> str:
    return f"""base AS ({source}), ns AS (SELECT greatest(1, {k} // count(DISTINCT domain)) AS per FROM base),
      o AS (SELECT *, md5(qid || ':{seed}') AS h, row_number() OVER (PARTITION BY domain ORDER BY md5(qid || ':{seed}'), qid) AS r FROM base),
      picked AS (SELECT * FROM o, ns WHERE r <= per ORDER BY domain, r LIMIT {k}),
      smp AS (SELECT * FROM (SELECT * EXCLUDE (per), 0 AS part FROM picked UNION ALL SELECT *, 1 FROM o WHERE qid NOT IN (SELECT qid FROM picked)) ORDER BY part, h, qid LIMIT {k})"""


_DIAG_SRC = f"SELECT qid, domain, answer, CASE WHEN domain IN ('c0', 'c5') THEN 'Gold-standard answer for ' || domain ELSE ground_truth END AS ground_truth FROM ({RECORDS_SQL})"


def _in_corpus(needles: str) -> str:
    """Brute force: every window of every needle against every text."""
    return f"""nd AS (SELECT qid, {_FOLD.format('text')} AS f, list_filter(string_split({_FOLD.format('text')}, ' '), lambda w: w <> '') AS ws FROM ({needles})),
      win AS (SELECT DISTINCT qid, unnest(CASE WHEN len(ws) < 3 THEN CASE WHEN len(ws) > 0 THEN [f] ELSE [] END ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS w FROM nd),
      dw AS (SELECT DISTINCT w FROM win), dt AS (SELECT {_FOLD.format('text')} AS t FROM documents), hitw AS (SELECT w FROM dw WHERE EXISTS (SELECT 1 FROM dt WHERE contains(t, w))),
      inc AS (SELECT DISTINCT qid FROM win JOIN hitw USING (w))"""


_NEEDLES = f"SELECT 'q' || query_id AS qid, text FROM ({QUESTIONS_SQL}) UNION ALL SELECT DISTINCT p_name, p_name FROM part UNION ALL SELECT r_name, lower(left(r_name, 2)) FROM region"
_DIAG = f"""{_sample_sql(_DIAG_SRC, 10, 17)}, {_in_corpus(f"SELECT qid, ground_truth AS text FROM smp WHERE NOT regexp_matches(ground_truth, '(?i){fv.PLACEHOLDER_PATTERN}')")},
  ctx AS (SELECT DISTINCT win.qid FROM win JOIN smp USING (qid) WHERE contains({_FOLD.format('answer')}, w)),
  dg AS (SELECT qid, domain, regexp_matches(ground_truth, '(?i){fv.PLACEHOLDER_PATTERN}') AS is_placeholder, qid IN (SELECT qid FROM inc) AS gt_in_corpus, qid IN (SELECT qid FROM ctx) AS gt_in_retrieved,
    regexp_extract(answer, '(?i){'|'.join(fv.FIRST_CITATION)}') AS top1_citation FROM smp)"""

_SOURCES = f"""{GRAPH_SQL}, cq AS (SELECT {', '.join(_CURATE)} FROM ({QUESTIONS_SQL})), todo AS (SELECT * FROM cq WHERE gold_answer = 'TODO'),
      lc AS (SELECT lower(cite) AS k, arg_min(cite, id) AS cite, arg_min(text, id) AS text FROM prov GROUP BY 1),
      ci AS (SELECT query_id, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS pos FROM (SELECT query_id, list_filter(list_transform(regexp_split_to_array(expected_citations, '[|,]'), lambda x: trim(x)), lambda x: x <> '') AS cs FROM todo)),
      l1 AS (SELECT query_id, pos, lc.cite AS label, lc.text AS body FROM ci JOIN lc ON k = lower(c)), t2 AS (SELECT * FROM todo WHERE query_id NOT IN (SELECT query_id FROM l1)),
      pdoc AS (SELECT id, {sql_tokens("concat_ws(' ', title, text, cite, module, domain)")} AS toks FROM prov), post AS (SELECT id, tok, count(*) AS tf FROM (SELECT id, unnest(toks) AS tok FROM pdoc) GROUP BY ALL),
      cs AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM pdoc), raw AS (SELECT tok, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT tok, count(*) AS df FROM post GROUP BY tok), cs),
      idf AS (SELECT tok, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw), qt AS (SELECT query_id, tok, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens('text')}) AS tok FROM t2) GROUP BY ALL),
      bm AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))), 4) AS score FROM qt JOIN idf USING (tok) JOIN post USING (tok) JOIN pdoc USING (id), cs GROUP BY ALL),
      l2 AS (SELECT query_id, pos, cite AS label, text AS body FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM bm) JOIN prov USING (id) WHERE pos <= 3),
      qw AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM t2 WHERE query_id NOT IN (SELECT query_id FROM l2)),
      l3 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_key) AS pos, doc_key AS label FROM (SELECT query_id, doc_key, count(*) AS n FROM qw JOIN ({CORPUS_SQL}) d ON contains(lower(d.text), w) GROUP BY ALL) WHERE n >= 4)"""
CURATION_SQL = f"""WITH {_SOURCES},
      src AS (SELECT query_id, pos, label, body FROM l1 UNION ALL SELECT query_id, pos, label, body FROM l2 UNION ALL SELECT query_id, pos, label, text FROM l3 JOIN ({CORPUS_SQL}) d ON doc_key = label WHERE pos <= 2),
      used AS (SELECT query_id, string_agg(label, ' | ' ORDER BY pos, label) AS labels, arg_min(body, pos) AS body FROM src GROUP BY query_id),
      cl AS (SELECT query_id, arg_min(claim, ln * 1000000 + sn) AS draft FROM {sql_claims('used', 'query_id', 'body')} WHERE len(claim) >= 25 GROUP BY query_id)
      SELECT query_id, coalesce(draft, gold_answer) AS gold_answer, CASE WHEN gold_answer <> 'TODO' THEN 'kept_original' WHEN draft IS NOT NULL THEN 'llm_drafted' ELSE 'needs_manual' END AS curation_status,
        CASE WHEN gold_answer <> 'TODO' THEN expected_citations ELSE coalesce(labels, '') END AS curation_source_cites FROM cq LEFT JOIN used USING (query_id) LEFT JOIN cl USING (query_id)"""


ANSWERED_SQL = f"""WITH qs AS ({QUESTIONS_SQL}), ctx AS (SELECT query_id, body, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS no FROM ({contexts_sql()})),
      sims AS (SELECT query_id, max(round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4)) AS s FROM ({QUERY_VECTORS_SQL}) a, ({VECTORS_SQL}) b GROUP BY query_id),
      keyed AS (SELECT struct_pack(query_id := query_id, no := no) AS k, body FROM ctx),
      cl AS (SELECT k.query_id AS query_id, k.no AS no, ln, sn, claim FROM {sql_claims('keyed', 'k', 'body')} WHERE len(claim) >= 25),
      sc AS (SELECT cl.*, len(list_intersect({sql_content_set('qs.text')}, {sql_content_set('claim')})) AS shared FROM cl JOIN qs USING (query_id)),
      best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, no, ln, sn) AS n FROM sc),
      ans AS (SELECT query_id, string_agg(claim, ' ' ORDER BY no, ln, sn) AS answer FROM best WHERE n <= 3 GROUP BY query_id), cn AS (SELECT query_id, count(*) AS n FROM ctx GROUP BY query_id)
      SELECT query_id, CASE WHEN coalesce(s, 0.0) < {fv.REFUSAL_THRESHOLD} THEN '{fv.REFUSAL_TEXT}' ELSE coalesce(answer, '') END AS answer, coalesce(n, 0) AS n_contexts, coalesce(source_line, '') AS source_line,
        coalesce(s, 0.0) < {fv.REFUSAL_THRESHOLD} AS refused, '' AS error
      FROM qs LEFT JOIN sims USING (query_id) LEFT JOIN ans USING (query_id) LEFT JOIN cn USING (query_id) LEFT JOIN (SELECT query_id, source_line FROM ({boost_sql(QUESTIONS_SQL)})) USING (query_id)"""


def _bag(text: str) -> str:
    return f"list_filter(list_distinct(string_split_regex(lower({text}), '\\s+')), lambda x: x <> '')"


def _overlap(part: str, whole: str) -> str:
    return f"CASE WHEN judged THEN len(list_intersect({part}, {whole})) / len({part}) END"


JUDGED_SQL = f"""WITH w AS (SELECT qid, domain, {_bag('answer')} AS a, {_bag('question')} AS q, {_bag('ground_truth')} AS g FROM ({RECORDS_SQL})),
      j AS (SELECT *, domain <> 'c9' AND len(a) > 0 AND len(q) > 0 AND len(g) > 0 AS judged FROM w)
      SELECT qid, {_overlap('a', 'a')} AS faithfulness, {_overlap('q', 'a')} AS answer_relevancy, {_overlap('a', 'g')} AS context_precision, {_overlap('g', 'a')} AS context_recall FROM j"""

ORACLE.update({
    "f1_jaccard": f"""SELECT qid, round({_jac('aw', 'gw')}, 4) AS plain, round({_jac('ast', 'gst', '1.0')}, 4) AS stemmed, round({_jac('al', 'gl')}, 4) AS relaxed FROM (SELECT qid, {sql_tokens('answer')} AS aw, {sql_tokens('ground_truth')} AS gw,
      {sql_stems('answer')} AS ast, {sql_stems('ground_truth')} AS gst, {sql_lemmas('answer')} AS al, {sql_lemmas('ground_truth')} AS gl FROM ({_REC_SQL}))""",
    "f2_rouge_l": f"SELECT qid, round({_rouge('aw', 'gw')}, 4) AS rouge_l FROM (SELECT qid, {sql_tokens('answer')} AS aw, {sql_tokens('ground_truth')} AS gw FROM ({_REC_SQL}))",
    "f5_lexical_scores": f"""SELECT qid, round({_jac('aw', 'gw')}, 4) AS lex_jaccard, round({_rouge('aw', 'gw')}, 4) AS lex_rouge_l, round({_share(_items('expected_citations'), 'contains(lower(answer), lower(k))', '0.0')}, 4) AS lex_citation_match,
      round({_share(_KW_DISTINCT, 'list_contains(aw, k)', '0.0')}, 4) AS lex_keyword_f1 FROM (SELECT *, {sql_tokens('answer')} AS aw, {sql_tokens('ground_truth')} AS gw FROM ({_REC_SQL}))""",
    "f8_blended_similarity": f"""SELECT qid, round(0.7 * ({_rouge('aw', 'gw')}) + 0.3 * ({_jac('ast', 'gst', '1.0')}), 4) AS blend
      FROM (SELECT qid, {sql_tokens('answer')} AS aw, {sql_tokens('ground_truth')} AS gw, {sql_stems('answer')} AS ast, {sql_stems('ground_truth')} AS gst FROM ({_REC_SQL}))""",
    "f3_citation_match": f"SELECT answer_id, round({_share(_items('expected_citations'), 'contains(lower(answer), lower(k))', '0.0')}, 4) AS citation_match FROM ({_SCORED_SQL})",
    "f4_keyword_f1": f"SELECT qid, round({_share(_KW_DISTINCT, 'list_contains(toks, k)', '0.0')}, 4) AS keyword_f1 FROM (SELECT *, {sql_tokens('answer')} AS toks FROM ({_REC_SQL}))",
    "f6_phrase_keywords": f"""SELECT answer_id, round({_share(_items('expected_keywords'), _phrase_test(), '1.0')}, 4) AS keyword_f1, round({_share("list_filter(string_split(expected_keywords, '|'), lambda x: x <> '')", _phrase_test(), '1.0')}, 4) AS completeness
      FROM (SELECT *, {sql_stems('answer')} AS toks FROM ({_SCORED_SQL}))""",
    "f7_terminology": f"SELECT answer_id, round(({_LEGAL}) / {len(fv.LEGAL_TERMS)}, 4) AS legal, round(least(1.0, ({_PHR} + {_ACRO}) / 8.0), 4) AS relaxed FROM (SELECT answer_id, {sql_stems('answer')} AS toks, ' ' || {_PLAIN.format('answer')} || ' ' AS t FROM ({_SCORED_SQL}))",
    "f9_citation_quality": f"""WITH s AS (SELECT answer_id, citations_ok, len({sql_invalid('answer', 'lenient')}) AS inv, {sql_penalty('answer')} AS pen FROM ({_SCORED_SQL}))
      SELECT answer_id, round(greatest(0.0, 1.0 - 0.1 * inv - pen), 4) AS citation_quality, CASE WHEN citations_ok AND inv = 0 AND pen = 0 THEN 1.0 ELSE 0.0 END AS source_accuracy FROM s""",
    "f10_relaxed_keywords": f"""WITH {_KEYS_SQL}, p AS (SELECT qid, len(keys) AS n, len(atoks) AS na, list_sum(list_transform(keys, lambda k: {_CREDIT})) AS tp FROM kx),
      s AS (SELECT *, greatest(0.0, na * 0.02 - tp * 0.1) AS fp, greatest(0.0, n - tp) AS fn FROM p), pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS prec, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rec FROM s)
      SELECT qid, n AS n_keys, CASE WHEN n = 0 THEN 0.0 ELSE round(least(1.0, tp / n), 4) END AS legal_completeness, CASE WHEN n = 0 OR prec + rec = 0 THEN 0.0 ELSE round(2 * prec * rec / (prec + rec), 4) END AS keyword_f1_score FROM pr""",
    "f11_source_scores": f"""WITH sl AS (SELECT answer_id, citations_ok, answer, {sql_source_line('answer')} AS source_line FROM ({_SCORED_SQL})), {_FIND},
      al AS (SELECT *, list_transform(pcs, lambda p: {sql_source_token('p')}) AS all_c FROM split), va AS (SELECT *, list_filter(all_c, lambda p: regexp_matches(p, '{_RELAX_RE}')) AS ok FROM al)
      SELECT answer_id, source_line, CASE WHEN citations_ok THEN 1.0 WHEN regexp_matches(answer, '{_RELAX_RE}') THEN 0.85 ELSE 0.0 END AS source_accuracy,
      CASE WHEN len(ok) > 0 THEN round(least(1.0, 0.6 + 0.1 * (len(ok) - 1)), 4) ELSE 0.0 END AS citation_quality, array_to_string(ok, ' | ') AS valid, array_to_string(all_c, ' | ') AS found FROM va""",
    "f12_task_scores": f"""SELECT answer_id, contains(lower(answer), lower(trim(expected_risk))) AS risk_found, least(1.0, len(regexp_extract_all(answer, '(?m)^\\s*[-•*]')) / 4.0) AS structure,
      round(greatest(0.0, 1.0 - 0.1 * len({sql_invalid('answer', 'lenient')}) - {sql_penalty('answer')}), 4) AS citation_quality FROM ({_SCORED_SQL})""",
    "f13_summary": f"SELECT {_SUM}, count(*) AS questions, count(*) FILTER (WHERE error <> '') AS errors, round(sum(runtime_s), 1) AS runtime_total_s FROM ({_RESULTS_SQL})",
    "f14_overall_means": f"SELECT {_MEANS} FROM ({_RESULTS_SQL})",
    "f14_domain_means": f"SELECT domain, {_MEANS} FROM ({_RESULTS_SQL}) GROUP BY domain",
    "f15_category_means": f"""SELECT category, ord, s AS average_score, 'complexity' AS report FROM (SELECT {_LEVEL} AS category, round(avg(m2), 3) AS s FROM ({_RESULTS_SQL}) GROUP BY 1) JOIN {_ORD} USING (category) WHERE s IS NOT NULL
      UNION ALL SELECT category, ord, s, 'compliance' FROM (SELECT {_CLASS} AS category, round(avg(n_chars), 3) AS s FROM ({_LAB_SQL}) GROUP BY 1) JOIN {_ORDC} USING (category)""",
    "f15_top_domains": f"SELECT domain || '/' || complexity AS domain, round(avg({_CLEAN.format('m1')}), 4) AS mean_score FROM ({_RESULTS_SQL}) GROUP BY 1 ORDER BY mean_score DESC, domain LIMIT 8",
    "f16_metric_matrix": f"SELECT lower(complexity) AS level, {_MEANS} FROM ({_RESULTS_SQL}) WHERE lower(complexity) IN ('basic', 'intermediate', 'advanced') GROUP BY 1",
    "f17_category_counts": f"SELECT ord, category, count(c) AS n FROM {_ORD} LEFT JOIN (SELECT {_LEVEL} AS c FROM ({_RESULTS_SQL})) ON c = category GROUP BY ALL",
    "f17_category_shares": f"SELECT {_CLASS} AS category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM ({_LAB_SQL}) GROUP BY 1",
    "f18_invalid_audit": f"SELECT sum(n) AS invalid_total, count(*) - sign(sum(n)) AS valid_estimate FROM (SELECT len({sql_invalid('answer', 'lenient')}) AS n FROM ({_SCORED_SQL}))",
    "f19_run_manifest": f"""SELECT count(*) AS total_items, count(*) FILTER (WHERE error = '') AS success_items, CAST(trunc(avg(TRY_CAST(latency_ms AS DOUBLE))) AS BIGINT) AS avg_latency_ms, round(avg({_CLEAN.format('m1')}), 4) AS avg_m1,
      round(avg({_CLEAN.format('m2')}), 4) AS avg_m2, round(avg(TRY_CAST(latency_ms AS DOUBLE)), 4) AS avg_latency_ms_1 FROM ({_RESULTS_SQL})""",
    "f20_ablation": " UNION ALL ".join(f"""SELECT '{m}' AS step, round(avg(r), 4) AS recall, round(avg(p), 4) AS precision, count(r) AS n_valid, count(*) AS n_questions FROM (SELECT query_id FROM ({QUESTIONS_SQL})) q LEFT JOIN
      (SELECT query_id, max(h) AS r, avg(h) AS p FROM (SELECT query_id, CAST(contains(lower(d.text), lower(b.text)) AS INT) AS h FROM ({_hybrid_sql(m)}) x JOIN ({CORPUS_SQL}) d USING (doc_key) JOIN ({QUESTIONS_SQL}) b USING (query_id)) GROUP BY query_id) USING (query_id)"""
                                    for m in ("rrf", "dense", "bm25")),
    "f21_stratified_sample": f"WITH {_sample_sql(RECORDS_SQL, 24, 17)} SELECT qid, domain FROM smp",
    "f21_sample_per_source": f"SELECT qid, source_file FROM (SELECT qid, domain AS source_file, row_number() OVER (PARTITION BY domain ORDER BY md5(qid || ':42'), qid) AS r FROM ({RECORDS_SQL})) WHERE r <= 3",
    "f22_ngram_containment": f"WITH {_in_corpus(_NEEDLES)} SELECT qid FROM inc",
    "f23_recall_diagnosis": f"WITH {_DIAG} SELECT * FROM dg",
    "f23_verdict": f"""WITH {_DIAG}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(ground_truth, '(?i){fv.PLACEHOLDER_PATTERN}')) AS ph FROM base),
      k AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_placeholder) AS placeholders, count(*) FILTER (WHERE NOT is_placeholder AND NOT gt_in_corpus) AS corpus_misses, count(*) FILTER (WHERE NOT is_placeholder AND NOT gt_in_retrieved) AS retrieved_misses FROM dg)
      SELECT k.n AS n, placeholders, corpus_misses, retrieved_misses, placeholders + corpus_misses AS quality_issues, placeholders + corpus_misses > 2 AS stop, ph AS set_placeholders, t.n AS set_total, ph * 100 // t.n AS set_percent, round((t.n - ph) / t.n, 4) AS recall_floor FROM k, t""",
    "f24_curation_sources": f"WITH {_SOURCES} SELECT query_id, 'cites' AS layer, pos, label FROM l1 UNION ALL SELECT query_id, 'search', pos, label FROM l2 UNION ALL SELECT query_id, 'documents', pos, label FROM l3 WHERE pos <= 2",
    "f24_curation": CURATION_SQL,
    "f25_batch_answers": ANSWERED_SQL,
    "f26_judged_scores": JUDGED_SQL,
})
ORACLE["f19_run_manifest"] = ORACLE["f19_run_manifest"].replace(" AS avg_latency_ms_1", " AS avg_latency_number")
