"""Registered queries of the text-function group (keys b*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark import fixed_values as fv
from lexspark.functions import chunking, citations as c, markdown, messages, text as t
from lexspark.operators import hybrid, postings
from lexspark.plans import inputs as src
from lexspark.plans.graph import sql_citations
from lexspark.plans.inputs import ANSWERS_SQL, PROVISIONS_SQL, sql_in_order, sql_quote, sql_tokens
from lexspark.plans.retrieval import _clean, _ranked, sql_bm25
from lexspark.plans.verification import sql_claims, sql_rewrite
from lexspark.operators.rows import posexplode_rows

QUERIES, ORACLE = {}, {}


def _docs(spark, sf):
    return src.text_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def _joined(tokens, sep=" "):
    return F.md5(F.array_join(tokens, sep))


def _tokens_query(fn):
    def run(spark, sf):
        rows = _docs(spark, sf).withColumn("toks", fn(F.col("text")))
        return rows.select("doc_id", F.size("toks").alias("n_tokens"), _joined(F.col("toks")).alias("tokens_md5"))
    return run


def _b5(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(t.plain_words(F.col("text"))).alias("plain_md5"), F.md5(t.citation_folded(F.col("text"))).alias("folded_md5"))


def _b6(spark, sf):
    at = F.position(F.lit("tion"), F.lower(F.col("text"))) - 1
    return _docs(spark, sf).select("doc_id", t.snippet(F.col("text"), F.when(at >= 0, at), 600).alias("snippet"))


def _b7(spark, sf):
    bullet = t.provision_bullet(*[F.col(x) for x in ("cite", "title", "text", "module", "domain", "threshold", "deadline")])
    return src.provisions(spark, sf).select("id", bullet.alias("bullet"))


def _chunks(fn):
    def run(spark, sf):
        rows = posexplode_rows(_docs(spark, sf), ["doc_id"], fn(F.col("text")), "chunk_no", "chunk")
        return rows.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))
    return run


def _b9(spark, sf):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    rows = posexplode_rows(_docs(spark, sf), ["doc_id"], t.paragraphs(spaced), "pos", "paragraph")
    return rows.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("paragraph")).alias("chars"))


def _b10(spark, sf):
    dotted = F.translate(F.col("text"), "aeiou", ".. …")
    return _docs(spark, sf).select("doc_id", t.is_repealed_or_empty(F.col("text")).alias("empty"), t.is_repealed_or_empty(dotted).alias("dotted_empty"))


_FILE_EXPRS = [
    "p_partkey",
    "CASE p_partkey % 3 WHEN 0 THEN 'fca' WHEN 1 THEN 'pra_pdfs' ELSE lower(p_type) END AS folder",
    "CASE p_partkey % 4 WHEN 0 THEN 'cobs' WHEN 1 THEN 'DEPP' ELSE replace(p_name, ' ', '-') || '.v' || CAST(p_size AS STRING) END || '.pdf' AS name",
    "CASE p_partkey % 5 WHEN 0 THEN 'fsma_2000' WHEN 1 THEN 'rao_2001' WHEN 2 THEN 'mlr_2017' WHEN 3 THEN 'psr_2017' ELSE 'uk_mar' END AS slug",
    "CASE p_partkey % 5 WHEN 0 THEN 'FSMA 2000' WHEN 1 THEN 'RAO 2001' WHEN 2 THEN 'MLR 2017' WHEN 3 THEN 'PSR 2017' ELSE 'UK MAR' END AS short_doc",
    "CASE p_partkey % 5 WHEN 0 THEN 's' WHEN 1 THEN 'art' WHEN 2 THEN 'reg' WHEN 3 THEN 'reg' ELSE 'art' END AS kind",
    "CAST(p_size AS STRING) AS number",
]
_FILES_SQL = f"SELECT {', '.join(_FILE_EXPRS)} FROM part"


def _b11(spark, sf):
    rows = src.table(spark, sf, "part").selectExpr(*_FILE_EXPRS)
    stem = t.file_stem(F.col("name"))
    return rows.select(
        "p_partkey", stem.alias("stem"), t.file_slug(F.col("name")).alias("slug"), c.file_module(stem, F.col("folder")).alias("module"),
        c.file_regulator(F.col("folder")).alias("regulator"), c.legislation_cite(F.col("short_doc"), F.col("kind"), F.col("number")).alias("cite"),
        c.legislation_id(F.col("slug"), F.col("kind"), F.col("number")).alias("id"))


def _b12(spark, sf):
    return src.answers(spark, sf).select("answer_id", F.array_join(c.extract_citations(F.col("answer")), "|").alias("cites"))


def _b13(spark, sf):
    return src.provisions(spark, sf).select("id", F.array_join(c.extract_citations(F.col("text"), F.col("document")), "|").alias("cites"))


_LABEL = ("CASE p_partkey % 7 WHEN 0 THEN 'fsma' WHEN 1 THEN 'RAO' WHEN 2 THEN 'mlr' WHEN 3 THEN 'Uk_Mar' WHEN 4 THEN 'UKMAR' WHEN 5 THEN 'cobs' ELSE 'Perg' END")
_NUMBER = "CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS STRING) || '.1r' ELSE CAST(p_size AS STRING) END"


def _b14(spark, sf):
    rows = src.table(spark, sf, "part").selectExpr("p_partkey", f"{_LABEL} AS label", f"{_NUMBER} AS number")
    return rows.select("p_partkey", c.canonical_cite(F.col("label"), F.col("number")).alias("cite"))


def _b15(spark, sf):
    return src.answers(spark, sf).select("answer_id", c.rewrite_citations(F.concat_ws("\n", "answer", "context_line")).alias("rewritten"))


def _b16(spark, sf):
    a = F.col("answer")
    return src.answers(spark, sf).select(
        "answer_id", c.on_allow_list(a, "strict").alias("strict"), c.on_allow_list(a, "lenient").alias("lenient"),
        c.on_allow_list(F.col("chunk_line"), "relaxed").alias("chunk_relaxed"), c.has_bad_token(a).alias("bad"))


def _b17(spark, sf):
    return src.answers(spark, sf).select(
        "answer_id", F.array_join(c.invalid_citations(F.col("answer"), "strict"), "|").alias("strict"),
        F.array_join(c.invalid_citations(F.col("answer"), "lenient"), "|").alias("lenient"))


_DIRTY = "'<Think>plan' || chr(10) || 'more</think>' || answer || '<json>Â£5 <sup>[12†]</sup> https://a.b/c?d=1 end</JSON> '"


def _b18(spark, sf):
    rows = src.answers(spark, sf).selectExpr("answer_id", f"{_DIRTY} AS dirty")
    d = F.col("dirty")
    return rows.select("answer_id", t.scrub_marks(d).alias("scrubbed"), t.clean_context(d).alias("cleaned"), t.fix_currency(d).alias("currency"))


def _b19(spark, sf):
    a = F.col("answer")
    return src.answers(spark, sf).select(
        "answer_id", c.has_source_line(a).alias("has_line"), c.policy_penalty(a).alias("penalty"), c.source_line(a).alias("source_line"))


_TOKEN = ("CASE p_partkey % 9 WHEN 0 THEN 'Principle  12' WHEN 1 THEN 'MAR' WHEN 2 THEN 'mar art. ' || CAST(p_size AS STRING) WHEN 3 THEN 'MLR reg. 27'"
          " WHEN 4 THEN 'psr77' WHEN 5 THEN ' psr reg 77 ' WHEN 6 THEN 'ukmar' WHEN 7 THEN 'COBS  4.2' ELSE p_name END")


def _b20(spark, sf):
    return src.table(spark, sf, "part").selectExpr("p_partkey", f"{_TOKEN} AS token").select(
        "p_partkey", c.normalise_source_token(F.col("token")).alias("cite"))


_GOLD = ("CASE p_partkey % 7 WHEN 0 THEN 'Gold-standard answer for ' || p_brand WHEN 1 THEN 'see TODO list' WHEN 2 THEN 'n/a' WHEN 3 THEN 'stubborn ' || p_name"
         " WHEN 4 THEN 'a placeholder, later' ELSE 'The ' || p_name || ' is regulated.' END")


def _b21(spark, sf):
    return src.table(spark, sf, "part").selectExpr("p_partkey", f"{_GOLD} AS gold").select("p_partkey", t.is_placeholder(F.col("gold")).alias("placeholder"))


def _b22(spark, sf):
    return src.answers(spark, sf).select("answer_id", c.first_citation(F.col("answer")).alias("first_cite"))


_MESSAGE = ("CASE p_partkey % 12 WHEN 0 THEN 'hi there!' WHEN 1 THEN 'Thanks, ' WHEN 2 THEN 'wtf, this doesn''t work' WHEN 3 THEN 'What can you do?' WHEN 4 THEN ' ?! '"
            " WHEN 5 THEN 'loan' WHEN 6 THEN 'Run a red flag audit' WHEN 7 THEN '' WHEN 8 THEN p_name WHEN 9 THEN 'Is the covenants clause in FSMA enough for a mortgage?'"
            " WHEN 10 THEN 'green then yellow then amber then red please sort' ELSE 'Please explain what the ' || p_name || ' rule asks of a firm' END")
_MESSAGES_SQL = (f"SELECT 'p' || CAST(p_partkey AS STRING) AS msg_id, {_MESSAGE} AS text FROM part UNION ALL"
                 " SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), text FROM conversations")


def _b23(spark, sf):
    parts = src.table(spark, sf, "part").selectExpr("'p' || CAST(p_partkey AS STRING) AS msg_id", f"{_MESSAGE} AS text")
    turns = src.text_table(spark, sf, "conversations").selectExpr("'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS msg_id", "text")
    return parts.unionByName(turns).select(
        "msg_id", messages.intent(F.col("text")).alias("intent"), messages.is_finance(F.col("text")).alias("finance"), messages.is_review(F.col("text")).alias("review"), messages.is_smalltalk(F.col("text")).alias("smalltalk"))


_RISK = ("CASE WHEN o_orderkey % 5 = 0 THEN '## 🟢 Green Areas' || chr(10) || '- ok' || chr(10) || chr(10) || chr(10) || chr(10) || '## 🟡 Yellow Areas' || chr(10) || '- hm' || chr(10)"
         " || '## 🟠 Amber Areas' || chr(10) || '- so' || chr(10) || '## 🔴 Red Areas' || chr(10) || '- no'"
         " ELSE 'Intro line' || chr(10) || '- first ' || lower(o_orderpriority) || chr(10) || '##  🟠 amber areas' || chr(10) || '- status ' || o_orderstatus || chr(10)"
         " || CASE o_orderstatus WHEN 'F' THEN '  - breach of rule' WHEN 'O' THEN '- orange note' ELSE '- green field' END || chr(10) || 'text - not a bullet' || chr(10) || '## 🟢 Green Areas' || chr(10) || '- tail ' || CAST(o_custkey AS STRING) END")


def _b24(spark, sf):
    rows = src.text_table(spark, sf, "orders").selectExpr("o_orderkey", f"{_RISK} AS text")
    return rows.select("o_orderkey", markdown.to_risk_sections(F.col("text")).alias("sections"))


def _b25(spark, sf):
    return src.answers(spark, sf).select("answer_id", messages.with_fallback(F.col("answer"), F.col("question")).alias("final"))


def _b26(spark, sf):
    """Context per question from its hits; French documents count as uploads."""
    docs = src.text_table(spark, sf, "documents").select(
        F.concat(F.when(F.col("lang") == "fr", "upload::").otherwise("static::"), F.col("doc_id").cast("string")).alias("doc_key"), "text")
    hits = postings.bm25_scores(src.questions(spark, sf), docs, 3).join(docs, "doc_key")
    return hybrid.assemble_context(hits.select("query_id", "rank", "doc_key", t.snippet(F.col("text")).alias("snippet")))


def _b27(spark, sf):
    answers = src.answers(spark, sf).select(F.concat(F.lit("o"), F.col("answer_id").cast("string")).alias("key"), F.col("answer").alias("text"))
    turns = src.text_table(spark, sf, "conversations").selectExpr("'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS key", "text")
    return posexplode_rows(answers.unionByName(turns), ["key"], markdown.claims(F.col("text")), "claim_no", "claim")


_RAW_SCORE = "CASE WHEN event_id % 7 = 0 THEN 'NaN' WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'inf' WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(user_id AS STRING) END"


def _b28(spark, sf):
    rows = src.table(spark, sf, "events").selectExpr("event_id", f"{_RAW_SCORE} AS raw")
    return rows.select("event_id", t.parse_score(F.col("raw")).alias("score"))


_RAW_LABEL = "CASE WHEN l_returnflag = 'A' THEN ' noncompliant' WHEN l_returnflag = 'N' THEN 'potential_issue' WHEN l_linestatus = 'F' THEN 'compliant ' ELSE 'other' END"
_RAW_LEVEL = "CASE WHEN l_linenumber % 5 = 0 THEN ' Adv' WHEN l_linenumber % 5 = 1 THEN 'MID' WHEN l_linenumber % 5 = 2 THEN 'easy' ELSE 'Basic' END"


def _b29(spark, sf):
    rows = src.table(spark, sf, "lineitem").selectExpr(f"{_RAW_LABEL} AS label", f"{_RAW_LEVEL} AS level")
    return rows.select(t.compliance_label(F.col("label")).alias("label"), t.complexity_label(F.col("level")).alias("level")).groupBy("label", "level").agg(F.count("*").alias("n"))


def _b30(spark, sf):
    rows = src.answers(spark, sf).withColumn("invalid", c.invalid_citations(F.col("answer"))).withColumn("cites", c.extract_citations(F.col("answer")))
    return rows.select("answer_id", c.invalid_footer(F.col("answer"), F.col("invalid")).alias("patched"), c.ungrounded_footer(F.col("cites")).alias("footer"))


def _b31(spark, sf):
    turns = src.text_table(spark, sf, "conversations")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    rows = turns.join(nxt, ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", t.instruction_record(F.when(F.col("role") == "user", F.col("text")).otherwise(""), F.col("text"), F.coalesce("response", F.lit(""))).alias("record"))


QUERIES.update({
    "b1_word_tokens": _tokens_query(t.word_tokens), "b2_content_tokens": _tokens_query(t.content_tokens), "b3_stem_tokens": _tokens_query(t.stem_tokens),
    "b4_lemma_tokens": _tokens_query(t.lemma_tokens), "b5_normalisers": _b5, "b6_snippet": _b6, "b7_bullets": _b7,
    "b8_chunk_fixed": _chunks(chunking.chunk_fixed), "b8_chunk_packed": _chunks(chunking.chunk_packed), "b8_chunk_recursive": _chunks(chunking.chunk_recursive),
    "b9_paragraphs": _b9, "b10_repealed": _b10, "b11_builders": _b11, "b12_citations": _b12, "b13_context_citations": _b13, "b14_canonical_cite": _b14,
    "b15_rewrites": _b15, "b16_allow_lists": _b16, "b17_invalid_citations": _b17, "b18_scrubbing": _b18, "b19_source_lines": _b19, "b20_source_tokens": _b20,
    "b21_placeholders": _b21, "b22_first_citation": _b22, "b23_intents": _b23, "b24_risk_sections": _b24, "b25_fallback_answers": _b25, "b26_context": _b26,
    "b27_claims": _b27, "b28_scores": _b28, "b29_labels": _b29, "b30_footers": _b30, "b31_instructions": _b31,
})

# --- DuckDB twins --------------------------------------------------------
_W = "[^\\p{L}\\p{N}_]"


def _any(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _match(column: str, patterns) -> str:
    return f"regexp_matches({column}, {sql_quote(_any(patterns))})"


def _bounded(patterns) -> list[str]:
    """Word boundaries that also hold next to accented letters."""
    out = []
    for p in patterns:
        p = f"(?:^|{_W})" + p[2:] if p.startswith("\\b") else p
        out.append(p[:-2] + f"(?:$|{_W})" if p.endswith("\\b") else p)
    return out


def _tok_sql(expr: str) -> str:
    return f"SELECT doc_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM (SELECT doc_id, {expr} AS toks FROM documents)"


_PLAIN = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_£]+', ' ', 'g'))"
_FOLD = "trim(regexp_replace(regexp_replace(lower({0}), '[._]+', '', 'g'), '\\s+', ' ', 'g'))"
_LEMMA = ("CASE WHEN w LIKE '%ies' AND len(w) > 4 THEN left(w, len(w) - 3) || 'y' WHEN w LIKE '%s' AND len(w) > 3 AND w NOT LIKE '%ss' THEN left(w, len(w) - 1)"
          " WHEN w LIKE '%ing' AND len(w) > 5 THEN left(w, len(w) - 3) WHEN w LIKE '%ed' AND len(w) > 4 THEN left(w, len(w) - 2) ELSE w END")


def sql_lemmas(column: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in fv.RELAXED_STOP_WORDS) + "]"
    return f"list_transform(list_filter(string_split({_PLAIN.format(column)}, ' '), lambda w: w <> '' AND NOT list_contains({stop}, w)), lambda w: {_LEMMA})"


def sql_stems(column: str) -> str:
    return f"list_transform({sql_tokens(column)}, lambda w: regexp_replace(w, '(ing|ed|es|s)$', ''))"


_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in fv.CONTENT_STOP_WORDS) + "]"
_SQZ = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def sql_invalid(column: str, mode: str) -> str:
    pieces = f"list_transform(regexp_split_to_array({column}, '[;|\\n,•\\-–—]+'), lambda p: trim(p, {_BLANKS}))"
    if mode == "strict":
        brackets = f"regexp_extract_all({column}, '(?m)(?:^|[(\\[])([^()\\[\\]\\n]{{3,80}})(?:[)\\]]|$)', 1)"
        pieces = f"list_transform(list_concat({brackets}, list_filter({pieces}, lambda p: len(p) >= 3)), lambda p: {_SQZ.format('p')})"
        books, allow = fv.STRICT_BOOK_NAMES, fv.ALLOW_STRICT
    else:
        pieces, books, allow = f"list_filter({pieces}, lambda p: p <> '')", fv.LENIENT_BOOK_NAMES, fv.ALLOW_LENIENT
    kept = f"list_filter({pieces}, lambda p: regexp_matches(p, '(?i){books}') AND ({_match('p', fv.BAD_TOKENS)} OR NOT {_match('p', allow)}))"
    return sql_in_order(kept)


def sql_scrub(column: str) -> str:
    for p, flags in (("\\[[0-9]+(?:†)?\\]", "g"), ("\\(https?://\\S+\\)", "g"), ("https?://\\S+", "g"), ("</?sup>", "gi")):
        column = f"regexp_replace({column}, '{p}', '', '{flags}')"
    return column


def sql_has_line(a: str) -> str:
    return f"regexp_matches(trim({a}, {_BLANKS}), '(?m)^Source:\\s')"


def sql_penalty(a: str) -> str:
    return f"least(1.0, CASE WHEN {sql_has_line(a)} THEN 0.0 ELSE 0.5 END + CASE WHEN regexp_matches({a}, 'https?://') THEN 0.5 ELSE 0.0 END)"


def sql_source_token(x: str) -> str:
    s = _SQZ.format(x)
    aliases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.CITATION_ALIASES.items())
    return (f"coalesce(CASE lower({s}) {aliases} END, CASE WHEN regexp_matches(lower({s}), '^mlr\\s*reg\\.?\\s*27$') THEN 'MLR 2017 reg.27' WHEN regexp_matches(lower({s}), '^psr\\s*reg\\.?\\s*77$')"
            f" THEN 'PSR 2017 reg.77' WHEN lower({s}) LIKE 'mar %' THEN 'UK MAR ' || substr({s}, 5) ELSE {s} END)")


_RELAXED = "(?i)" + "|".join(f"(?:{p})" for p in fv.ALLOW_RELAXED)


def sql_source_line(a: str) -> str:
    first = f"trim(regexp_extract({a}, '(?im)^\\s*[*_]*\\s*source\\s*[:\\-–]\\s*(.+?)\\s*$', 1))"
    cites = f"list_transform(regexp_extract_all({a}, '{_RELAXED}'), lambda x: {sql_source_token('x')})"
    distinct = f"list_filter({cites}, lambda x, i: list_position(list_transform({cites}, lambda y: lower(y)), lower(x)) = i)"
    return f"CASE WHEN {first} <> '' THEN {first} ELSE array_to_string({distinct}[1:4], ' | ') END"


def sql_fallback() -> str:
    cases = " ".join(f"WHEN regexp_matches(question, '(?i){p}') THEN {sql_quote(body + chr(10) + chr(10) + 'Source: ' + s)}" for p, body, s in fv.FALLBACK_ANSWERS)
    return f"CASE WHEN len(trim(answer, {_BLANKS})) < 80 AND (CASE {cases} ELSE '' END) <> '' THEN CASE {cases} END ELSE answer END"


def sql_risk_ctes(source: str, key: str) -> str:
    """CTEs from source(key, text) to risk(key, rebuilt)."""
    head = " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN '{n}'" for n, p, _, _ in fv.RISK_SECTIONS)
    dims = ", ".join(f"({i}, '{n}', {sql_quote(r)}, {sql_quote(d)})" for i, (n, _, r, d) in enumerate(fv.RISK_SECTIONS))
    return f"""ln AS (SELECT {key}, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT {key}, string_split(text, chr(10)) AS ls FROM {source})),
      tg AS (SELECT *, CASE {head} END AS header FROM ln),
      cu AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'yellow') AS cur FROM tg),
      bu AS (SELECT {key}, pos, trim(line) AS line, CASE WHEN lower(line) LIKE '%green%' THEN 'green' WHEN lower(line) LIKE '%yellow%' THEN 'yellow' WHEN regexp_matches(lower(line), 'amber|orange') THEN 'amber'
        WHEN regexp_matches(lower(line), 'red|critical|breach') THEN 'red' ELSE cur END AS sec FROM cu WHERE header IS NULL AND trim(line) LIKE '-%'),
      dim(i, sec, rendered, dflt) AS (VALUES {dims}),
      blk AS (SELECT s.{key}, i, rendered || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY pos), any_value(dflt)) || chr(10) AS block FROM {source} s CROSS JOIN dim LEFT JOIN bu ON bu.{key} = s.{key} AND bu.sec = dim.sec GROUP BY s.{key}, i, rendered),
      risk AS (SELECT {key}, regexp_replace(string_agg(block, chr(10) ORDER BY i), '\\n{{3,}}', chr(10) || chr(10), 'g') AS rebuilt FROM blk GROUP BY {key})"""


def _risk_sql() -> str:
    return f"""WITH src AS (SELECT o_orderkey, {_RISK} AS text FROM orders), {sql_risk_ctes('src', 'o_orderkey')}
      SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') ELSE rebuilt END AS sections FROM src JOIN risk USING (o_orderkey)"""


_INTENT = f"""WITH m AS ({_MESSAGES_SQL}), n AS (SELECT msg_id, text, trim(text, {_BLANKS}) AS s,
    {_match('text', _bounded(fv.FINANCE_WORDS))} AS finance, {_match('text', _bounded(fv.REVIEW_WORDS))} AS review,
    len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS words FROM m),
  g AS (SELECT *, regexp_matches(lower(s), {sql_quote('^(?:' + fv.GREETING_PHRASES + ')[\\s!.?,]*$')}) AS greet FROM n)
  SELECT msg_id, CASE WHEN len(s) < 2 OR NOT regexp_matches(s, '[\\p{{L}}\\p{{N}}]') THEN 'empty' WHEN regexp_matches(s, {sql_quote('(?i)(?:^|' + _W + ')(?:' + fv.FRUSTRATION_WORDS + ')(?:$|' + _W + ')')}) THEN 'frustration'
    WHEN regexp_matches(lower(s), {sql_quote('^(?:' + fv.META_PHRASES + ')[\\s!.?,]*$')}) THEN 'meta' WHEN greet OR (words <= 3 AND NOT finance AND NOT review) THEN 'greeting' ELSE 'legal_query' END AS intent,
    finance, review, text <> '' AND (greet OR (words <= 3 AND NOT finance AND NOT review)) AS smalltalk FROM g"""

_HANDBOOKS = ", ".join(f"'{b}'" for b in fv.HANDBOOK_BOOKS)
_STEMS = ", ".join(f"'{b}'" for b in fv.HANDBOOK_FILE_STEMS)
_SNIP = "substr(text, greatest(0, p - 200) + 1, 600)"

def _quoted(sep: str) -> str:
    return " || ".join("chr(10)" if c == "\n" else sql_quote(c) for c in sep)


def _chunk_rows(chunks: str) -> str:
    return f"SELECT doc_id, unnest(range(0, len(cs))) AS chunk_no, unnest(list_transform(cs, lambda x: len(x))) AS n_chars, unnest(list_transform(cs, lambda x: md5(x))) AS chunk_md5 FROM (SELECT doc_id, {chunks} AS cs FROM documents)"


def _windows_sql(text: str) -> str:
    step = fv.CHUNK_SIZE - fv.CHUNK_OVERLAP
    return f"list_filter(list_transform(range(0, len({text}), {step}), lambda i: trim(substr({text}, i + 1, {fv.CHUNK_SIZE}), {_BLANKS})), lambda x: x <> '')"


def _packed_sql() -> str:
    """Greedy packing as a fold over the pieces of the coarsest separator."""
    out = _windows_sql("text")
    shut = f"CASE WHEN s.open = '' THEN s.done ELSE list_append(s.done, trim(s.open, {_BLANKS})) END"
    for sep in reversed(fv.CHUNK_SEPARATORS):
        q = _quoted(sep)
        joined = f"CASE WHEN s.open = '' THEN p.open ELSE s.open || {q} || p.open END"
        step = f"""CASE WHEN len({joined}) <= {fv.CHUNK_SIZE} THEN {{'done': s.done, 'open': {joined}}} WHEN len(p.open) > {fv.CHUNK_SIZE} THEN {{'done': list_concat({shut}, {_windows_sql('p.open')}), 'open': ''}}
          ELSE {{'done': {shut}, 'open': p.open}} END"""
        start = "{'done': []::VARCHAR[], 'open': ''}"
        fold = f"list_reduce(list_transform(string_split(text, {q}), lambda x: {{'done': []::VARCHAR[], 'open': x}}), lambda s, p: {step}, {start})"
        packed = f"list_transform([{fold}], lambda s: list_filter(list_append(s.done, trim(s.open, {_BLANKS})), lambda x: x <> ''))[1]"
        out = f"CASE WHEN contains(text, {q}) THEN {packed} ELSE {out} END"
    return f"CASE WHEN len(text) <= {fv.CHUNK_SIZE} THEN [text] ELSE {out} END"


def _recursive_sql(text: str, seps: tuple[str, ...]) -> str:
    """Unstripped chunks of a text: pieces of the first separator that it holds, longer ones split by the finer separators, others merged with overlap."""
    level, size, overlap = len(seps), fv.CHUNK_SIZE, fv.CHUNK_OVERLAP
    s, p = f"s{level}", f"p{level}"
    if seps:
        q = _quoted(seps[0])
        pieces = f"list_filter(list_transform(string_split({text}, {q}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {q} || x END), lambda x: x <> '')"
        deeper = f"WHEN len({p}.win[1]) > {size} THEN {{'done': list_concat(CASE WHEN len({s}.win) = 0 THEN {s}.done ELSE list_append({s}.done, array_to_string({s}.win, '')) END, {_recursive_sql(f'{p}.win[1]', seps[1:])}), 'win': []::VARCHAR[]}}"
    else:
        pieces, deeper = f"string_split({text}, '')", ""
    rest = lambda d: f"len(array_to_string({s}.win[{d} + 1:], ''))"
    left = f"{s}.win[list_filter(range(0, len({s}.win) + 1), lambda d: d = len({s}.win) OR ({rest('d')} <= {overlap} AND {rest('d')} + len({p}.win[1]) <= {size}))[1] + 1:]"
    full = f"len({s}.win) > 0 AND len(array_to_string({s}.win, '')) + len({p}.win[1]) > {size}"
    step = f"""CASE {deeper} WHEN {full} THEN {{'done': list_append({s}.done, array_to_string({s}.win, '')), 'win': list_concat({left}, {p}.win)}} ELSE {{'done': {s}.done, 'win': list_concat({s}.win, {p}.win)}} END"""
    fold = f"list_reduce(list_transform({pieces}, lambda x: {{'done': []::VARCHAR[], 'win': [x]}}), lambda {s}, {p}: {step}, {{'done': []::VARCHAR[], 'win': []::VARCHAR[]}})"
    out = f"list_transform([{fold}], lambda {s}: CASE WHEN len({s}.win) = 0 THEN {s}.done ELSE list_append({s}.done, array_to_string({s}.win, '')) END)[1]"
    return f"CASE WHEN contains({text}, {q}) THEN {out} ELSE {_recursive_sql(text, seps[1:])} END" if seps else out


ORACLE.update({
    "b1_word_tokens": _tok_sql(sql_tokens("text")),
    "b2_content_tokens": _tok_sql(f"list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: NOT list_contains({_STOP_LIST}, w))"),
    "b3_stem_tokens": _tok_sql(sql_stems("text")),
    "b4_lemma_tokens": _tok_sql(sql_lemmas("text")),
    "b5_normalisers": f"SELECT doc_id, md5({_PLAIN.format('text')}) AS plain_md5, md5({_FOLD.format('text')}) AS folded_md5 FROM documents",
    "b6_snippet": f"SELECT doc_id, trim(regexp_replace({_SNIP}, '\\s+', ' ', 'g')) || CASE WHEN len({_SNIP}) = 600 THEN '…' ELSE '' END AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'tion') - 1 AS p FROM documents)",
    "b7_bullets": f"""SELECT id, '- **' || cite || '** — ' || title || '. ' || left(text, 220) || CASE WHEN len(text) > 220 THEN '…' ELSE '' END || ' ('
        || concat_ws(', ', nullif(module, ''), nullif(domain, ''), nullif(threshold, ''), nullif(deadline, '')) || ')' AS bullet FROM ({PROVISIONS_SQL})""",
    "b8_chunk_packed": _chunk_rows(_packed_sql()),
    "b8_chunk_recursive": _chunk_rows(f"CASE WHEN len(text) <= {fv.CHUNK_SIZE} THEN [text] ELSE list_filter(list_transform({_recursive_sql('text', fv.CHUNK_SEPARATORS)}, lambda x: trim(x, {_BLANKS})), lambda x: x <> '') END"),
    "b8_chunk_fixed": f"""WITH w AS (SELECT doc_id, CASE WHEN len(text) <= 1500 THEN [text] ELSE list_filter(list_transform(range(0, len(text), 1350), lambda i: trim(substr(text, i + 1, 1500), {_BLANKS})), lambda x: x <> '') END AS cs FROM documents)
      SELECT doc_id, generate_subscripts(cs, 1) - 1 AS chunk_no, len(unnest(cs)) AS n_chars, md5(unnest(cs)) AS chunk_md5 FROM w""",
    "b9_paragraphs": f"""SELECT doc_id, count(*) AS paragraphs, sum(len(p)) AS chars FROM (SELECT doc_id, trim(unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))), {_BLANKS}) AS p FROM documents) WHERE len(p) >= 50 GROUP BY doc_id""",
    "b10_repealed": "SELECT doc_id, len(regexp_replace(text, '[\\s.…]+', '', 'g')) < 40 AS empty, len(regexp_replace(translate(text, 'aeiou', '.. …'), '[\\s.…]+', '', 'g')) < 40 AS dotted_empty FROM documents",
    "b11_builders": f"""WITH f AS ({_FILES_SQL}), g AS (SELECT *, left(name, len(name) - 4) AS stem FROM f)
      SELECT p_partkey, stem, trim(regexp_replace(stem, '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug,
      CASE WHEN folder = 'fca' THEN CASE WHEN upper(stem) IN ({_STEMS}) THEN upper(stem) ELSE 'FCA' END WHEN folder = 'pra_pdfs' THEN 'PRA' ELSE upper(folder) END AS module,
      CASE WHEN folder = 'pra_pdfs' THEN 'PRA' ELSE 'FCA' END AS regulator, short_doc || ' ' || kind || '.' || number AS cite, replace(upper(slug), '_', '') || '_' || kind || number AS id FROM g""",
    "b12_citations": f"SELECT answer_id, array_to_string({sql_in_order('cx')}, '|') AS cites FROM (SELECT answer_id, {sql_citations('answer')} AS cx FROM ({ANSWERS_SQL}))",
    "b13_context_citations": f"SELECT id, array_to_string({sql_in_order('cx')}, '|') AS cites FROM (SELECT id, {sql_citations('text', 'document')} AS cx FROM ({PROVISIONS_SQL}))",
    "b14_canonical_cite": f"""WITH l AS (SELECT p_partkey, trim(translate(upper({_LABEL}), '_-', '  ')) AS act, {_NUMBER} AS number FROM part)
      SELECT p_partkey, CASE WHEN act = 'FSMA' THEN 'FSMA 2000 s.' || number WHEN act = 'RAO' THEN 'RAO 2001 art.' || number WHEN act = 'MLR' THEN 'MLR 2017 reg.' || number WHEN act = 'PSR' THEN 'PSR 2017 reg.' || number
      WHEN act IN ('UK MAR', 'UKMAR') THEN 'UK MAR art.' || number WHEN act IN ({_HANDBOOKS}) THEN act || ' ' || left(number, len(number) - 1) || upper(right(number, 1)) ELSE act || ' ' || number END AS cite FROM l""",
    "b15_rewrites": "SELECT answer_id, " + sql_rewrite("(answer || chr(10) || context_line)") + f" AS rewritten FROM ({ANSWERS_SQL})",
    "b16_allow_lists": f"SELECT answer_id, {_match('answer', fv.ALLOW_STRICT)} AS strict, {_match('answer', fv.ALLOW_LENIENT)} AS lenient, {_match('chunk_line', fv.ALLOW_RELAXED)} AS chunk_relaxed, {_match('answer', fv.BAD_TOKENS)} AS bad FROM ({ANSWERS_SQL})",
    "b17_invalid_citations": f"SELECT answer_id, array_to_string({sql_invalid('answer', 'strict')}, '|') AS strict, array_to_string({sql_invalid('answer', 'lenient')}, '|') AS lenient FROM ({ANSWERS_SQL})",
    "b18_scrubbing": f"""SELECT answer_id, {sql_scrub('dirty')} AS scrubbed, trim(regexp_replace(regexp_replace(dirty, '(?s)<think>.*?</think>', '', 'gi'), '</?json>', '', 'gi'), {_BLANKS}) AS cleaned, replace(dirty, 'Â£', '£') AS currency
      FROM (SELECT answer_id, {_DIRTY} AS dirty FROM ({ANSWERS_SQL}))""",
    "b19_source_lines": f"SELECT answer_id, {sql_has_line('answer')} AS has_line, {sql_penalty('answer')} AS penalty, {sql_source_line('answer')} AS source_line FROM ({ANSWERS_SQL})",
    "b20_source_tokens": f"SELECT p_partkey, {sql_source_token('token')} AS cite FROM (SELECT p_partkey, {_TOKEN} AS token FROM part)",
    "b21_placeholders": f"SELECT p_partkey, regexp_matches({_GOLD}, '(?i){fv.PLACEHOLDER_PATTERN}') AS placeholder FROM part",
    "b22_first_citation": f"SELECT answer_id, regexp_extract(answer, '(?i){'|'.join(fv.FIRST_CITATION)}') AS first_cite FROM ({ANSWERS_SQL})",
    "b23_intents": _INTENT,
    "b24_risk_sections": _risk_sql(),
    "b25_fallback_answers": f"SELECT answer_id, {sql_fallback()} AS final FROM ({ANSWERS_SQL})",
    "b26_context": f"""WITH corpus AS (SELECT CASE WHEN lang = 'fr' THEN 'upload::' ELSE 'static::' END || CAST(doc_id AS STRING) AS doc_key, text FROM documents), {sql_bm25()}, {_ranked('bm', 3, 'r')},
      h AS (SELECT query_id, doc_key, rank, {_clean('text')} AS snip FROM r JOIN corpus USING (doc_key))
      SELECT query_id, CASE WHEN bool_and(doc_key LIKE 'upload::%') THEN '**Full uploaded document:**' || chr(10) || left(string_agg(snip, chr(10) || chr(10) ORDER BY rank), 2200) || chr(10) || chr(10)
      ELSE left(string_agg('**Context (' || doc_key || '):**' || chr(10) || snip || chr(10) || chr(10), '' ORDER BY rank), 2200) END AS context FROM h GROUP BY query_id""",
    "b27_claims": f"""WITH src AS (SELECT 'o' || CAST(answer_id AS STRING) AS key, answer AS text FROM ({ANSWERS_SQL}) UNION ALL SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), text FROM conversations)
      SELECT key, row_number() OVER (PARTITION BY key ORDER BY ln, sn) - 1 AS claim_no, claim FROM {sql_claims('src', 'key', 'text')} WHERE len(claim) >= 25""",
    "b28_scores": f"SELECT event_id, CASE WHEN isnan(d) OR isinf(d) THEN NULL ELSE d END AS score FROM (SELECT event_id, TRY_CAST({_RAW_SCORE} AS DOUBLE) AS d FROM events)",
    "b29_labels": f"""SELECT label, level, count(*) AS n FROM (SELECT CASE trim({_RAW_LABEL}) WHEN 'potential issue' THEN 'Potential issue' WHEN 'potential_issue' THEN 'Potential issue' WHEN 'noncompliant' THEN 'Non-compliant'
      WHEN 'non_compliant' THEN 'Non-compliant' WHEN 'compliant' THEN 'Compliant' ELSE trim({_RAW_LABEL}) END AS label,
      CASE lower(trim({_RAW_LEVEL})) WHEN 'adv' THEN 'advanced' WHEN 'hard' THEN 'advanced' WHEN 'mid' THEN 'intermediate' WHEN 'easy' THEN 'basic' ELSE lower(trim({_RAW_LEVEL})) END AS level FROM lineitem) GROUP BY ALL""",
    "b30_footers": f"""WITH a AS (SELECT *, {sql_invalid('answer', 'strict')} AS inv, {sql_citations('answer')} AS cx FROM ({ANSWERS_SQL})), b AS (SELECT *, {sql_in_order('cx')} AS cites FROM a)
      SELECT answer_id, answer || CASE WHEN len(inv) > 0 THEN {sql_quote(fv.INVALID_FOOTER)} ELSE '' END AS patched,
      CASE WHEN len(cites) > 0 THEN {sql_quote(fv.UNGROUNDED_FOOTER)} || array_to_string(list_transform(cites[1:3], lambda x: '`' || x || '`'), ', ') || '.' ELSE '' END AS footer FROM b""",
    "b31_instructions": """SELECT c.conv_id AS conv_id, c.turn AS turn, concat_ws(chr(10), c.text, nullif(n.text, '')) AS record FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""",
})
