"""Registered queries of the graph group (keys d*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark import fixed_values as fv
from lexspark.operators import graph_build as gb, graph_reports as gr, graph_walk as gw
from lexspark.plans import inputs as src
from lexspark.plans.inputs import PROVISIONS_SQL, sql_quote, sql_tokens

QUERIES, ORACLE = {}, {}


def _pairs(spark, sf):
    """Every FSMA-style cite is defined by the MLR cite of the same number."""
    cites = src.provisions(spark, sf).where("cite LIKE 'FSMA%'").select("cite").distinct()
    return cites.select(F.col("cite").alias("from_cite"), F.concat(F.lit("MLR 2017 reg."), F.regexp_extract("cite", r"\.(\d+)$", 1)).alias("to_cite"))


def _graph(spark, sf):
    return gb.build_graph(src.provisions(spark, sf), _pairs(spark, sf))


def _titles(spark, sf):
    return src.provisions(spark, sf).select(F.col("title").alias("query_id"), F.col("title").alias("text")).distinct()


def _returned(spark, sf):
    """Second batch: parts with a returned line item get a new title, suppliers are new."""
    back = src.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("id")).distinct()
    changed = src.provisions(spark, sf).join(back, "id", "left_semi").withColumn("title", F.concat(F.lit("returned "), "title"))
    new = src.table(spark, sf, "supplier").selectExpr(
        "'S' || CAST(s_suppkey AS STRING) AS id", "'SUP ' || CAST(s_suppkey AS STRING) AS cite", "s_name AS title", "s_name AS text",
        "'FCA' AS module", "'Supply' AS domain", "'' AS threshold", "'' AS deadline")
    return changed.select(*new.columns).unionByName(new)


def _d1(spark, sf):
    first, second = src.provisions(spark, sf), _returned(spark, sf)
    return gb.upsert_provisions([first, second, second])


def _d2(spark, sf):
    return gb.mentions(src.provisions(spark, sf))


def _d10(spark, sf):
    g = _graph(spark, sf)
    seeds = g.provisions.select(F.col("id").alias("query_id"), "cite")
    return gw.one_hop(seeds, g).select("query_id", F.array_join("must_terms", "|").alias("must_terms"), F.array_join("related_cites", "|").alias("related_cites"))


def _d11(spark, sf):
    g = _graph(spark, sf)
    seeds = g.provisions.select(F.col("cite").alias("query_id"), "cite").distinct()
    return gw.two_hops(seeds, g)


def _d11_three(spark, sf):
    g = _graph(spark, sf)
    seeds = g.provisions.select(F.col("cite").alias("query_id"), "cite").distinct()
    return gw.two_hops(seeds, g, max_hops=3)


def _d12(spark, sf):
    boost = gw.graph_boost(_titles(spark, sf), _graph(spark, sf))
    return boost.select("query_id", "context_md", "source_line", F.array_join("must_terms", "|").alias("must_terms"))


def _d18(spark, sf):
    g = _graph(spark, sf)
    root = gr.most_cited(g, 1).select("id")
    return gw.cite_paths(gw.shortest_paths(root, g), g)


def _d9(spark, sf):
    hits = gw.search_provisions(_titles(spark, sf), _graph(spark, sf))
    return hits.select("query_id", "rank", "score", "id", "cite", F.array_join("terms", "|").alias("terms"))


def _asked(spark, sf):
    """Cites asked for: one per customer, many of them unknown."""
    return src.table(spark, sf, "customer").selectExpr("'fsma 2000 S.' || CAST(c_custkey AS STRING) AS cite").unionByName(
        src.table(spark, sf, "customer").selectExpr("'FSMA 2000 s.' || CAST(c_custkey AS STRING) AS cite"))


def _d22(spark, sf):
    pages = src.table(spark, sf, "supplier").selectExpr(
        "'PDF_' || s_name AS id", "'FCA (' || s_name || ' p1)' AS cite", "s_name AS title", "s_name AS text", "'FCA' AS module")
    both = gb.collect_sources(spark, "both", src.provisions(spark, sf), pages)
    legacy = gb.collect_sources(spark, "legacy")
    return both.unionByName(legacy, allowMissingColumns=True).select("id", "cite", "title", "module", F.coalesce("terms", F.lit("")).alias("terms"))


QUERIES.update({
    "d1_upsert": _d1,
    "d2_mentions": _d2,
    "d2_terms": lambda s, sf: gb.terms(src.provisions(s, sf)),
    "d3_defined_by": lambda s, sf: gb.defined_by(src.provisions(s, sf), _pairs(s, sf)),
    "d4_issued_by": lambda s, sf: gb.issued_by(src.provisions(s, sf)),
    "d5_part_of": lambda s, sf: gb.part_of(src.provisions(s, sf)),
    "d6_citation_pairs": lambda s, sf: gb.citation_pairs(src.provisions(s, sf)),
    "d7_cites_edges": lambda s, sf: gb.cites_edges(src.provisions(s, sf)),
    "d8_key_report": lambda s, sf: gb.key_report(s, src.provisions(s, sf)),
    "d9_provision_search": _d9,
    "d10_one_hop": _d10,
    "d11_two_hops": _d11, "d11_three_hops": _d11_three,
    "d12_graph_boost": _d12,
    "d13_graph_summary": lambda s, sf: gr.graph_summary(_graph(s, sf)),
    "d14_counts_by_document": lambda s, sf: gr.counts_by(src.provisions(s, sf), "document"),
    "d14_counts_by_module": lambda s, sf: gr.counts_by(src.provisions(s, sf), "module"),
    "d14_sample": lambda s, sf: gr.sample_rows(src.provisions(s, sf)),
    "d15_regulator_provisions": lambda s, sf: gr.provisions_of_regulator(src.provisions(s, sf), "FCA"),
    "d16_citations_out": lambda s, sf: gr.citations_out(_graph(s, sf)),
    "d17_most_cited": lambda s, sf: gr.most_cited(_graph(s, sf)),
    "d18_shortest_paths": _d18,
    "d19_term_bridge": lambda s, sf: gr.term_bridge(_graph(s, sf)),
    "d20_known_cites": lambda s, sf: gr.known_cites(_asked(s, sf), src.provisions(s, sf)),
    "d21_provision_texts": lambda s, sf: gr.provision_texts(_asked(s, sf), src.provisions(s, sf)),
    "d21_texts_any_case": lambda s, sf: gr.provision_texts(_asked(s, sf), src.provisions(s, sf), ignore_case=True),
    "d22_sources": _d22,
})

# --- DuckDB twins --------------------------------------------------------


def sql_citations(text: str, document: str | None = None) -> str:
    """List of canonical citations in rule order (with repeats)."""
    parts = [f"list_transform(regexp_extract_all({text}, '(?i){p}', 1), lambda n: '{prefix}' || n)" for _, prefix, p, _ in fv.STATUTES]
    number = "regexp_extract(m, '\\d.*$')"
    parts.append(f"list_transform(regexp_extract_all({text}, '(?i){fv.HANDBOOK_PATTERN}'), lambda m: upper(regexp_extract(m, '^[A-Za-z]+')) || ' '"
                 f" || left({number}, len({number}) - 1) || upper(right({number}, 1)))")
    if document:
        cases = " ".join(
            f"WHEN '{fv.STATUTE_DOCUMENTS[label]}' THEN list_transform(regexp_extract_all({text}, '(?i){bare}', 1), lambda n: '{prefix}' || n)"
            for label, prefix, _, bare in fv.STATUTES)
        parts.append(f"CASE {document} {cases} ELSE [] END")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


_BASE = f"""prov AS ({PROVISIONS_SQL}),
men AS (SELECT DISTINCT lower(trim(t)) AS term, id FROM (SELECT id, unnest(string_split(terms, '|')) AS t FROM prov) WHERE trim(t) <> ''),
reps AS (SELECT cite, min(id) AS rep_id FROM prov GROUP BY cite),
pairs AS (SELECT DISTINCT cite AS from_cite, 'MLR 2017 reg.' || regexp_extract(cite, '\\.(\\d+)$', 1) AS to_cite FROM prov WHERE cite LIKE 'FSMA%'),
defby AS (SELECT DISTINCT id AS src, rep_id AS dst FROM pairs JOIN prov ON prov.cite = from_cite JOIN reps ON reps.cite = to_cite),
cx AS (SELECT DISTINCT id AS src, cite AS own, unnest({sql_citations('text', 'document')}) AS target_cite FROM prov),
cp AS (SELECT DISTINCT src, target_cite FROM cx WHERE own <> target_cite AND target_cite IN (SELECT cite FROM prov)),
cites AS (SELECT DISTINCT src, rep_id AS dst FROM cp JOIN reps ON cite = target_cite),
regname AS (SELECT id, CASE WHEN regulator <> '' THEN trim(regulator) ELSE trim(module) END AS regulator FROM prov),
iss AS (SELECT * FROM regname WHERE regulator IN ('FCA', 'PRA', 'HMT', 'ESMA', 'BoE')),
part_of AS (SELECT id, document FROM prov WHERE document IN ('FSMA 2000', 'RAO 2001', 'MLR 2017', 'PSR 2017', 'UK MAR')),
links AS (SELECT src, dst, 'CITES' AS type FROM cites UNION ALL SELECT src, dst, 'DEFINED_BY' FROM defby)"""

_WALK = """und AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
pth AS (SELECT a, b, 1 AS hops FROM und WHERE a <> b
  UNION ALL SELECT x.a, y.b, 2 FROM und x JOIN und y ON x.b = y.a WHERE x.a <> y.b
  UNION ALL SELECT m.id, n.id, 2 FROM men m JOIN men n ON m.term = n.term WHERE m.id <> n.id),
mh AS (SELECT a, b, min(hops) AS hops FROM pth GROUP BY ALL)"""

_TPP = "SELECT id, list_sort(list(DISTINCT term))[1:{k}] AS terms FROM men GROUP BY id"


def _bm25(k: int, queries: str = "SELECT DISTINCT title AS query_id, title AS text FROM prov") -> str:
    return f"""q AS ({queries}),
pdoc AS (SELECT id AS doc_key, {sql_tokens("concat_ws(' ', title, text, cite, module, domain)")} AS toks FROM prov),
post AS (SELECT doc_key, tok, count(*) AS tf FROM (SELECT doc_key, unnest(toks) AS tok FROM pdoc) GROUP BY ALL),
cs AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM pdoc),
raw AS (SELECT tok, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT tok, count(*) AS df FROM post GROUP BY tok), cs),
idf AS (SELECT tok, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, tok, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens('text')}) AS tok FROM q) GROUP BY ALL),
bm AS (SELECT query_id, doc_key, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))), 4) AS score
  FROM qt JOIN idf USING (tok) JOIN post USING (tok) JOIN pdoc USING (doc_key), cs GROUP BY ALL),
hit AS (SELECT * FROM (SELECT query_id, doc_key AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM bm) WHERE rank <= {k})"""


def boost_sql(queries: str) -> str:
    """(query_id, context_md, source_line, must_terms) of questions (query_id, text)."""
    return f"""WITH {_BASE}, {_WALK}, {_bm25(3, queries)}, tpp8 AS ({_TPP.format(k=8)}), tpp6 AS ({_TPP.format(k=6)}),
      h AS (SELECT query_id, rank, prov.*, '- **' || cite || '** — ' || title || '. ' || left(text, 220) || CASE WHEN len(text) > 220 THEN '…' ELSE '' END || ' ('
        || concat_ws(', ', nullif(module, ''), nullif(domain, ''), nullif(threshold, ''), nullif(deadline, '')) || ')' AS bullet FROM hit JOIN prov USING (id)),
      sd AS (SELECT DISTINCT query_id, p.id AS seed FROM h JOIN prov p ON p.cite = h.cite),
      r AS (SELECT query_id, b, o.cite AS rc, hops, row_number() OVER (PARTITION BY query_id ORDER BY hops, o.cite, b, a) AS n FROM sd JOIN mh ON a = seed JOIN prov o ON o.id = b),
      r20 AS (SELECT * FROM r WHERE n <= 20),
      byc AS (SELECT query_id, rc, min(hops) AS hops FROM r20 GROUP BY ALL),
      fresh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rc) AS k FROM byc WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = byc.query_id AND h.cite = rc)),
      note AS (SELECT query_id, '- *Related (2-hop)*: ' || string_agg(rc || ' (' || hops || '-hop)', ', ' ORDER BY rc) AS note FROM fresh WHERE k <= 5 GROUP BY query_id),
      mt AS (SELECT query_id, unnest(tpp8.terms) AS t FROM h JOIN tpp8 USING (id) UNION SELECT query_id, unnest(tpp6.terms) FROM r20 JOIN tpp6 ON tpp6.id = b),
      mts AS (SELECT query_id, array_to_string(list_sort(list(DISTINCT t)), '|') AS must_terms FROM mt GROUP BY query_id),
      top AS (SELECT query_id, string_agg(bullet, chr(10) ORDER BY rank) AS bl, string_agg(cite, ' | ' ORDER BY rank) AS source_line FROM h GROUP BY query_id)
      SELECT query_id, '**Graph hits:**' || chr(10) || bl || CASE WHEN note IS NULL THEN '' ELSE chr(10) || note END || chr(10) || chr(10) AS context_md, source_line, must_terms
      FROM top LEFT JOIN note USING (query_id) LEFT JOIN mts USING (query_id)"""


def _paths() -> str:
    levels = ["l0 AS (SELECT dst AS id, [dst] AS path, 0 AS hops FROM (SELECT dst, cite, count(*) AS n FROM cites JOIN prov ON id = dst GROUP BY ALL ORDER BY n DESC, cite, dst LIMIT 1))", "v0 AS (SELECT id FROM l0)"]
    for i in range(1, 7):
        levels.append(f"l{i} AS (SELECT u.b AS id, min(list_append(path, u.b)) AS path, {i} AS hops FROM l{i-1} JOIN cu u ON u.a = l{i-1}.id"
                      f" WHERE u.b NOT IN (SELECT id FROM v{i-1}) GROUP BY u.b)")
        levels.append(f"v{i} AS (SELECT id FROM v{i-1} UNION ALL SELECT id FROM l{i})")
    levels = [x.replace(" AS (", " AS MATERIALIZED (", 1) for x in levels]
    union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(7))
    return (f"WITH {_BASE}, cu AS MATERIALIZED (SELECT src AS a, dst AS b FROM cites UNION SELECT dst, src FROM cites), {', '.join(levels)}, al AS ({union}),"
            " nodes AS (SELECT id, hops, unnest(path) AS node, generate_subscripts(path, 1) AS pos FROM al)"
            " SELECT (SELECT id FROM l0) AS root, nodes.id AS id, hops, string_agg(prov.cite, ' > ' ORDER BY pos) AS path"
            " FROM nodes JOIN prov ON prov.id = node GROUP BY nodes.id, hops")


_SAMPLE_VALUES = ", ".join("(" + ", ".join(sql_quote(row[i]) for i in (0, 1, 2, 4, 6)) + ")" for row in fv.SAMPLE_PROVISIONS)
_ASKED = "SELECT 'fsma 2000 S.' || CAST(c_custkey AS STRING) AS cite FROM customer UNION ALL SELECT 'FSMA 2000 s.' || CAST(c_custkey AS STRING) FROM customer"

ORACLE.update({
    "d1_upsert": f"""WITH {_BASE}, upd AS (SELECT id, cite, 'returned ' || title AS title, text, module, domain, threshold, deadline FROM prov
        WHERE id IN (SELECT 'P' || CAST(l_partkey AS STRING) FROM lineitem WHERE l_returnflag = 'R'))
      SELECT * FROM upd UNION ALL SELECT id, cite, title, text, module, domain, threshold, deadline FROM prov WHERE id NOT IN (SELECT id FROM upd)
      UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'SUP ' || CAST(s_suppkey AS STRING), s_name, s_name, 'FCA', 'Supply', '', '' FROM supplier""",
    "d2_mentions": f"WITH {_BASE} SELECT term, id FROM men",
    "d2_terms": f"WITH {_BASE} SELECT DISTINCT term AS name FROM men",
    "d3_defined_by": f"WITH {_BASE} SELECT src, dst FROM defby",
    "d4_issued_by": f"WITH {_BASE} SELECT id, regulator FROM iss",
    "d5_part_of": f"WITH {_BASE} SELECT id, document FROM part_of",
    "d6_citation_pairs": f"WITH {_BASE} SELECT src, target_cite FROM cp",
    "d7_cites_edges": f"WITH {_BASE} SELECT src, dst FROM cites",
    "d8_key_report": f"""WITH {_BASE} SELECT 'Provision' AS label, count(*) AS n_rows, count(*) - count(DISTINCT id) AS duplicates FROM prov
      UNION ALL SELECT 'Term', count(DISTINCT term), 0 FROM men UNION ALL SELECT 'Regulator', 5, 0 UNION ALL SELECT 'Document', 5, 0""",
    "d9_provision_search": f"""WITH {_BASE}, {_bm25(6)}, tpp AS ({_TPP.format(k=6)})
      SELECT query_id, rank, score, id, cite, coalesce(array_to_string(tpp.terms, '|'), '') AS terms FROM hit JOIN prov USING (id) LEFT JOIN tpp USING (id)""",
    "d10_one_hop": f"""WITH {_BASE}, tpp AS ({_TPP.format(k=10)}),
      rel AS (SELECT src, list(cite) AS related FROM (SELECT src, cite, row_number() OVER (PARTITION BY src ORDER BY cite) AS n FROM
        (SELECT DISTINCT src, prov.cite FROM links JOIN prov ON prov.id = dst)) WHERE n <= 6 GROUP BY src),
      rows AS (SELECT p.id AS query_id, c.id AS id FROM prov p JOIN prov c ON p.cite = c.cite)
      SELECT query_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(terms, []))))), '|') AS must_terms,
        array_to_string(list_sort(list_distinct(flatten(list(coalesce(related, []))))), '|') AS related_cites
      FROM rows LEFT JOIN tpp USING (id) LEFT JOIN rel ON rel.src = rows.id GROUP BY query_id""",
    "d11_two_hops": f"""WITH {_BASE}, {_WALK}, r AS (SELECT s.cite AS query_id, a AS seed_id, b AS related_id, o.cite AS related_cite, hops,
        row_number() OVER (PARTITION BY s.cite ORDER BY hops, o.cite, b, a) AS n FROM mh JOIN prov s ON s.id = a JOIN prov o ON o.id = b)
      SELECT query_id, seed_id, related_id, related_cite, hops FROM r WHERE n <= 20""",
    "d11_three_hops": f"""WITH {_BASE}, {_WALK}, far AS (SELECT a, b, hops FROM mh UNION ALL SELECT und.a, mh.b, 3 FROM und JOIN mh ON und.b = mh.a WHERE und.a <> mh.b
        UNION ALL SELECT mh.a, und.b, 3 FROM mh JOIN und ON mh.b = und.a WHERE mh.a <> und.b), m3 AS (SELECT a, b, min(hops) AS hops FROM far GROUP BY ALL),
      r AS (SELECT s.cite AS query_id, a AS seed_id, b AS related_id, o.cite AS related_cite, hops,
        row_number() OVER (PARTITION BY s.cite ORDER BY hops, o.cite, b, a) AS n FROM m3 JOIN prov s ON s.id = a JOIN prov o ON o.id = b)
      SELECT query_id, seed_id, related_id, related_cite, hops FROM r WHERE n <= 20""",
    "d12_graph_boost": boost_sql("SELECT DISTINCT title AS query_id, title AS text FROM prov"),
    "d13_graph_summary": f"""WITH {_BASE} SELECT 'node' AS kind, 'Provision' AS label, count(*) AS n FROM prov UNION ALL SELECT 'node', 'Term', count(DISTINCT term) FROM men
      UNION ALL SELECT 'node', 'Regulator', 5 UNION ALL SELECT 'node', 'Document', 5 UNION ALL SELECT 'edge', type, count(*) FROM links GROUP BY type
      UNION ALL SELECT 'edge', 'MENTIONS', count(*) FROM men UNION ALL SELECT 'edge', 'ISSUED_BY', count(*) FROM iss UNION ALL SELECT 'edge', 'PART_OF', count(*) FROM part_of""",
    "d14_counts_by_document": f"WITH {_BASE} SELECT document, count(*) AS n FROM prov GROUP BY document",
    "d14_counts_by_module": f"WITH {_BASE} SELECT module, count(*) AS n FROM prov GROUP BY module",
    "d14_sample": f"WITH {_BASE} SELECT id, cite, title, left(text, 160) || CASE WHEN len(text) > 160 THEN '…' ELSE '' END AS preview FROM prov ORDER BY id LIMIT 5",
    "d15_regulator_provisions": f"WITH {_BASE} SELECT id, cite, title FROM prov WHERE id IN (SELECT id FROM iss WHERE regulator = 'FCA') ORDER BY cite, id LIMIT 20",
    "d16_citations_out": f"WITH {_BASE} SELECT document, count(*) AS cites_out FROM part_of JOIN cites ON src = id GROUP BY document",
    "d17_most_cited": f"WITH {_BASE} SELECT dst AS id, cite, title, count(*) AS times_cited FROM cites JOIN prov ON id = dst GROUP BY ALL ORDER BY times_cited DESC, cite, id LIMIT 15",
    "d18_shortest_paths": _paths(),
    "d19_term_bridge": f"WITH {_BASE} SELECT * FROM (SELECT term, row_number() OVER (PARTITION BY term ORDER BY cite, id) AS n, id, cite, title FROM men JOIN prov USING (id)) WHERE n <= 20",
    "d20_known_cites": f"WITH {_BASE} SELECT DISTINCT cite FROM ({_ASKED}) WHERE cite IN (SELECT cite FROM prov)",
    "d21_provision_texts": f"WITH {_BASE} SELECT a.cite AS cite, prov.cite AS found_cite, title, text FROM (SELECT DISTINCT cite FROM ({_ASKED})) a JOIN reps ON reps.cite = a.cite JOIN prov ON id = rep_id",
    "d21_texts_any_case": f"""WITH {_BASE}, lr AS (SELECT lower(cite) AS k, min(id) AS rep_id FROM prov GROUP BY 1)
      SELECT a.cite AS cite, prov.cite AS found_cite, title, text FROM (SELECT DISTINCT cite FROM ({_ASKED})) a JOIN lr ON k = lower(a.cite) JOIN prov ON id = rep_id""",
    "d22_sources": f"""WITH {_BASE} SELECT id, cite, title, module, terms FROM prov UNION ALL SELECT 'PDF_' || s_name, 'FCA (' || s_name || ' p1)', s_name, 'FCA', '' FROM supplier
      UNION ALL SELECT * FROM (VALUES {_SAMPLE_VALUES})""",
})
