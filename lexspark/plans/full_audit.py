"""DuckDB twin of the full answer audit (key e3)."""

from __future__ import annotations

from lexspark import fixed_values as fv
from lexspark.plans.graph import sql_citations
from lexspark.plans.inputs import ANSWERS_SQL, PROVISIONS_SQL, sql_in_order, sql_quote
from lexspark.plans.text_rules import _BLANKS, sql_fallback, sql_invalid, sql_risk_ctes, sql_scrub
from lexspark.plans.verification import sql_claims, sql_content_set, sql_rewrite

_FOOT = f"CASE WHEN len(inv) > 0 THEN {sql_quote(fv.INVALID_FOOTER)} ELSE '' END"
_UNG = f"{sql_quote(fv.UNGROUNDED_FOOTER)} || array_to_string(list_transform(miss[1:3], lambda x: '`' || x || '`'), ', ') || '.'"

FULL_AUDIT_SQL = f"""WITH prov AS ({PROVISIONS_SQL}),
p0 AS (SELECT answer_id, question, context_line, chunk_line, regexp_matches(question, '(?i)audit|issues') AS review, replace({sql_rewrite(sql_scrub('answer'))}, 'Â£', '£') AS answer FROM ({ANSWERS_SQL})),
rsrc AS (SELECT answer_id, trim(answer, {_BLANKS}) AS text FROM p0 WHERE review), {sql_risk_ctes('rsrc', 'answer_id')},
p1 AS (SELECT *, CASE WHEN review THEN answer ELSE {sql_fallback()} END AS f1 FROM p0),
p2 AS (SELECT p1.*, CASE WHEN review THEN rebuilt WHEN regexp_matches(f1, '(?im)^source\\s*:\\s*') THEN f1 ELSE f1 || chr(10) || chr(10) || 'Source: ' || context_line END AS f2 FROM p1 LEFT JOIN risk USING (answer_id)),
p3 AS (SELECT *, {sql_invalid('f2', 'strict')} AS inv FROM p2),
p4 AS (SELECT answer_id, inv, [context_line, chunk_line] AS g, f2 || {_FOOT} AS full_text FROM p3),
a1 AS (SELECT *, {sql_rewrite('full_text')} AS t FROM p4), a2 AS (SELECT *, {sql_citations('t')} AS raw FROM a1), a3 AS (SELECT *, {sql_in_order('raw')} AS cites FROM a2),
e AS (SELECT answer_id, unnest(cites) AS cite, generate_subscripts(cites, 1) AS pos FROM a3),
known AS (SELECT cite, {sql_content_set('min_by(text, id)')} AS stoks FROM prov GROUP BY cite),
k AS (SELECT answer_id, list(e.cite ORDER BY pos) FILTER (WHERE stoks IS NOT NULL) AS ok, list(e.cite ORDER BY pos) FILTER (WHERE stoks IS NULL) AS miss FROM e LEFT JOIN known USING (cite) GROUP BY answer_id),
h AS (SELECT a3.*, coalesce(ok, []) AS ok, coalesce(miss, []) AS miss, list_filter(cites, lambda c: NOT list_contains(g, c)) AS hal FROM a3 LEFT JOIN k USING (answer_id)),
f AS (SELECT *, len(cites) = 0 AS nothing, len(cites) > 0 AND len(ok) = 0 AS down FROM h),
v AS (SELECT *, nothing OR down OR len(miss) = 0 AS all_grounded, full_text || CASE WHEN nothing OR down OR len(miss) = 0 THEN '' ELSE {_UNG} END AS final_answer FROM f),
cl AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY ln, sn) - 1 AS claim_no, claim FROM {sql_claims('(SELECT * FROM v WHERE len(ok) > 0)', 'answer_id', 'final_answer')} WHERE len(claim) >= 25),
ct AS (SELECT *, {sql_content_set('claim')} AS toks FROM cl WHERE claim_no < {fv.CLAIM_TRACE_ITEMS}),
sc AS (SELECT ct.answer_id, claim_no, e.cite, len(list_intersect(toks, stoks)) * 1000 - pos AS r, len(list_intersect(toks, stoks)) AS score FROM ct JOIN e USING (answer_id) JOIN known ON known.cite = e.cite),
be AS (SELECT answer_id, claim_no, max(score) AS score, arg_max(cite, r) AS cite FROM sc GROUP BY ALL),
tr AS (SELECT answer_id, string_agg(concat_ws(':', claim_no, CASE WHEN score > 0 THEN cite END, CASE WHEN score > 0 THEN score END), '|' ORDER BY claim_no) AS claim_trace FROM be GROUP BY answer_id)
SELECT answer_id, final_answer, len(inv) = 0 AS citations_ok, array_to_string(inv[1:10], '|') AS invalid, all_grounded, nothing OR down OR len(hal) = 0 AS all_retrieved,
  CASE WHEN down THEN '' ELSE array_to_string(ok, '|') END AS verified, CASE WHEN down THEN '' ELSE array_to_string(miss, '|') END AS unverified, array_to_string(hal, '|') AS hallucinated_context,
  CASE WHEN nothing THEN 'no_citations' WHEN down THEN 'graph_unavailable' ELSE '' END AS note,
  CASE WHEN NOT nothing AND NOT down AND len(hal) > 0 THEN '{fv.NOT_RETRIEVED_WARNING[0]}' || array_to_string(hal[1:3], ', ') || '{fv.NOT_RETRIEVED_WARNING[1]}' END AS warning, claim_trace
FROM v LEFT JOIN tr USING (answer_id)"""

QUERIES = {}
ORACLE = {"e3_full_audit": FULL_AUDIT_SQL}
