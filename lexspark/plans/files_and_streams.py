"""Registered queries of the source, sink and streaming groups (keys a*, g*).

Readers and writers are exercised by a round trip: a whole driver table is
written below the shared folder, read back through the operator, and compared
with the same result computed from the table.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lexspark import fixed_values as fv
from lexspark.functions.chunking import chunk_fixed
from lexspark.functions.citations import answer_citations
from lexspark.functions.text import is_allowed_file, slug
from lexspark.operators import dense, summaries as sm
from lexspark.operators.lexical_scores import lexical_scores
from lexspark.plans import inputs as src
from lexspark.plans.evaluation import _EXPECTED, _REC_SQL, _RESULTS, _RESULTS_SQL, _jac
from lexspark.plans.inputs import ANSWERS_SQL, CORPUS_SQL, RECORDS_SQL, VECTORS_SQL, sql_tokens
from lexspark.plans.text_rules import _BLANKS, sql_scrub
from lexspark.plans.verification import ORACLE as VERIFY_ORACLE
from lexspark.session import scratch_path
from lexspark.sources import files, html, legislation, questions, sinks
from lexspark.streaming import jobs

QUERIES, ORACLE = {}, {}



def _file_group(key):
    """The partition folder of a key, e.g. 17 of static::grp=17/part-0.txt."""
    return F.regexp_extract(key, r"grp=([^/]+)/", 1)


def _docs(spark, sf):
    return src.text_table(spark, sf, "documents")


def _write_texts(spark, sf):
    """Text files, one per ten documents, in document order."""
    root = scratch_path(spark, "texts")
    rows = _docs(spark, sf).withColumn("grp", (F.col("doc_id") / 10).cast("bigint"))
    rows.repartition("grp").sortWithinPartitions("grp", "doc_id").select("grp", "text").write.partitionBy("grp").text(root + "/txt")
    return root


def _write_tables(spark, sf):
    root = scratch_path(spark, "tables")
    rows = src.table(spark, sf, "events").withColumn("grp", F.col("user_id"))
    placed = rows.repartition("grp").sortWithinPartitions("grp", "event_id")
    # each task moves its own files into place, so the driver does not move one folder a user
    writer = placed.select("grp", "event_id", "event_type", F.col("value").cast("decimal(20,2)").alias("value")).write.partitionBy("grp")
    writer.option("header", "true").option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(root + "/csv")
    return root


def _a1(spark, sf):
    root = _write_texts(spark, sf)
    events = src.table(spark, sf, "events").withColumn("grp", F.col("event_type"))
    events.repartition("grp").sortWithinPartitions("grp", "event_id").select("grp", F.col("event_id").cast("string").alias("id"), "event_type").write.partitionBy("grp").option("header", "true").csv(root + "/csv")
    events.repartition("grp").sortWithinPartitions("grp", "event_id").select("grp", "event_id", "props", "event_type").write.partitionBy("grp").parquet(root + "/parquet")
    docs = files.scan_corpus(spark, root, kinds=("text", "table", "parquet"))
    kind = F.regexp_extract("doc_key", r"^static::([a-z]+)/", 1)
    return docs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_files"), F.sum(F.length("text")).alias("n_chars"))


def _a2(spark, sf):
    docs = files.read_texts(spark, _write_texts(spark, sf))
    return docs.select(_file_group(F.col("doc_key")).alias("grp"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def _a3(spark, sf):
    docs = files.read_tables(spark, _write_tables(spark, sf))
    return docs.select(_file_group(F.col("doc_key")).alias("grp"), F.md5("text").alias("text_md5"))


def _a4(spark, sf):
    root = scratch_path(spark, "parquet")
    rows = src.table(spark, sf, "events").withColumn("grp", F.col("user_id"))
    rows.repartition("grp").sortWithinPartitions("grp", "event_id").select("grp", "event_id", "event_type", "value", "props").write.partitionBy("grp").parquet(root)
    docs = files.read_parquet_texts(spark, root)
    return docs.select(_file_group(F.col("doc_key")).alias("grp"), F.md5("text").alias("text_md5"))


def _a5(spark, sf):
    """Documents as binary files whose pages are separated by form feeds."""
    root = scratch_path(spark, "binary")
    rows = _docs(spark, sf).withColumn("grp", (F.col("doc_id") / 10).cast("bigint")).withColumn("text", F.concat("text", F.lit("\f")))
    rows.repartition("grp").sortWithinPartitions("grp", "doc_id").select("grp", "text").write.partitionBy("grp").text(root)
    pages = files.read_pages(spark, root, glob="*.txt")
    return pages.select(F.regexp_extract("path", r"grp=([^/]+)/", 1).alias("grp"), "page_no", F.md5(F.btrim("text", F.lit("\n"))).alias("page_md5")).where(F.col("page_md5") != F.md5(F.lit("")))


_XML_ROW = ("'<P1group><Title>Rule ' || CAST(p_partkey AS STRING) || '</Title><P1 id=\"section-' || CAST(p_partkey % 700 AS STRING) || '\"><Pnumber>' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey % 700 AS STRING) END"
            " || '</Pnumber><P1para><Text>' || CASE WHEN p_partkey % 11 = 0 THEN '. . . . .' ELSE 'A firm that sells the ' || p_name || ' must  keep <Em>full</Em> records of every sale.' END || '</Text></P1para></P1></P1group>'")
_SLUG = "CASE p_partkey % 5 WHEN 0 THEN 'fsma_2000' WHEN 1 THEN 'rao_2001' WHEN 2 THEN 'mlr_2017' WHEN 3 THEN 'psr_2017' ELSE 'uk_mar' END"


def _xml_files(spark, sf):
    """One XML file per source, as (path, content) rows: grouped text of all parts."""
    rows = src.table(spark, sf, "part").selectExpr("p_partkey", f"{_SLUG} AS slug", "p_partkey DIV 1000 AS piece", f"{_XML_ROW} AS xml")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "xml"))), lambda r: r["xml"]), "")
    grouped = rows.groupBy("slug", "piece").agg(body.alias("body"))
    root = scratch_path(spark, "xml")
    text = F.concat(F.lit('<Legislation xmlns="urn:x">'), "body", F.lit("</Legislation>"))
    grouped.select("slug", "piece", text.alias("value")).write.partitionBy("slug", "piece").text(root)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        F.concat(F.regexp_extract("path", r"slug=([^/]+)/", 1), F.lit(".xml")).alias("name"), F.regexp_extract("path", r"piece=(\d+)", 1).alias("piece"), "content")


def _a6(spark, sf):
    found = _xml_files(spark, sf)
    elements = legislation.parse_files(found.select(F.concat("piece", F.lit("/"), "name").alias("path"), "content"))
    prov = legislation.provisions_from_elements(elements, legislation.source_dim(spark), chunk_fixed)
    return prov.select("id", "cite", "title", "text", "module", "document", "hierarchy_path")


def _a7(spark, sf):
    found = _xml_files(spark, sf).select(F.concat("piece", F.lit("/"), "name").alias("path"), "content")
    broken = found.select(F.concat(F.lit("broken/"), "path").alias("path"), F.encode(F.lit("<Legislation><P1"), "UTF-8").alias("content"))
    prov = legislation.provisions_from_elements(legislation.parse_files(found.unionByName(broken)), legislation.source_dim(spark), chunk_fixed)
    return prov.groupBy("document", "regulator", "domain").agg(F.count("*").alias("n"))


def _a8(spark, sf):
    rows = _docs(spark, sf).select(
        F.when(F.col("lang") == "en", "fca").when(F.col("lang") == "fr", "pra_pdfs").otherwise("eu").alias("folder"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), "text")
    prov = files.page_provisions(rows, chunker=chunk_fixed)
    return prov.select("id", "cite", "title", F.md5("text").alias("text_md5"), "module", "domain", "document", "regulator", "hierarchy_path")


def _a9(spark, sf):
    """Three tables with different headers, aligned to the question columns."""
    base = scratch_path(spark, "headers")
    part, customer, orders = (src.table(spark, sf, n) for n in ("part", "customer", "orders"))
    part.selectExpr("p_name AS `Prompt Text`", "p_brand AS `Legal-Domain`", "CASE WHEN p_size % 2 = 0 THEN 'Hard' ELSE 'easy' END AS Difficulty").write.option("header", "true").csv(f"{base}/part")
    customer.selectExpr("c_name || ' of ' || c_mktsegment AS remark", "c_custkey AS n", "'noncompliant' AS `Risk Class`").write.option("header", "true").csv(f"{base}/customer")
    orders.selectExpr("o_orderstatus AS a", "substr(o_orderpriority, 1, 1) AS b").write.option("header", "true").csv(f"{base}/orders")
    rows = questions.read_all(spark, [f"{base}/part", f"{base}/customer", f"{base}/orders"])
    return rows.groupBy("question", "domain", "complexity", "compliance_class", "gold_answer", "source_file").agg(F.count("*").alias("n"))


def _a10(spark, sf):
    path = scratch_path(spark, "questions")
    rows = src.table(spark, sf, "benchmark").orderBy("item_id").select(
        F.col("item_id").cast("string").alias("id"), F.lit("d").alias("domain"), F.lit("basic").alias("complexity"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("question"),
        F.lit("gold, with comma").alias("gold_answer"), F.lit(None).cast("string").alias("expected_citations"), F.lit("k|l").alias("expected_keywords"))
    rows.write.option("header", "true").option("escape", '"').csv(path)
    return questions.load_questions(spark, path, sample=25)


def _a11(spark, sf):
    laws = src.provisions(spark, sf).select("text", F.col("document").alias("act"), F.col("id").alias("section_id"))
    handbook = _docs(spark, sf).select(F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.col("source").alias("name"))
    turns = src.text_table(spark, sf, "conversations").select(F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("text"), F.col("text").alias("answer"), F.col("role").alias("name"))
    path = scratch_path(spark, "training")
    files.training_records(laws, handbook, turns).write.json(path)
    back = spark.read.schema("text string, source string, type string").json(path)
    return back.groupBy("type", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def _pages(spark, sf):
    return src.text_table(spark, sf, "pages")


def _a13(spark, sf):
    found = html.links(_pages(spark, sf))
    return html.canonical_links(found, r"^/[^/?#]+/?$")


def _a13_reachable(spark, sf):
    pages = _pages(spark, sf)
    return html.reachable(pages.select("url"), html.links(pages), 2)


def _a14(spark, sf):
    rows = html.extract_page(_pages(spark, sf))
    return rows.select("url", slug(F.col("title")).alias("slug"), html.title_slug(F.col("title")).alias("folded_slug"), html.download_name(F.lit(""), F.col("url")).alias("file_name"))


def _a15(spark, sf):
    path = scratch_path(spark, "results")
    rows = src.records(spark, sf).selectExpr("*", *_EXPECTED).withColumn("contexts", F.split("answer", "\n"))
    scored = sinks.flatten_contexts(lexical_scores(rows))
    for half in (0, 1):
        sinks.append_results(scored.where(F.pmod(F.crc32("qid"), F.lit(2)) == half), path, "run1")
    back = sinks.read_run(spark, path, "run1")
    return back.select("qid", "lex_jaccard", F.md5("contexts").alias("contexts_md5"))


_RUN = "'run_' || CAST(user_id AS STRING)"


def _run_tables(spark, sf):
    path = scratch_path(spark, "runs")
    rows = src.table(spark, sf, "events").selectExpr("event_id", "value", f"{_RUN} AS run_id", "event_type")
    rows.repartition("run_id").write.partitionBy("run_id").parquet(path)
    summaries = rows.where("event_type = 'purchase' AND value > 20").select("run_id").distinct()
    return spark.read.parquet(path), summaries


def _a16(spark, sf):
    results, summaries = _run_tables(spark, sf)
    return sinks.list_runs(results, summaries)


def _a16_latest(spark, sf):
    results, _ = _run_tables(spark, sf)
    return sinks.latest_run(results).select("run_id", "event_id", "value")


def _a17(spark, sf):
    rows = src.text_table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", r"\s+", " ").alias("summary"))
    frames = []
    for fmt in ("json", "csv", "tsv"):
        path = scratch_path(spark, f"export-{fmt}")
        sinks.export(rows, path, fmt)
        reader = spark.read.schema("doc_id bigint, lang string, summary string")
        back = reader.json(path) if fmt == "json" else reader.option("header", "true").option("escape", '"').option("sep", "," if fmt == "csv" else "\t").csv(path)
        frames.append(back.select(F.lit(fmt).alias("fmt"), "doc_id", "lang", F.md5("summary").alias("summary_md5")))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _a18(spark, sf):
    path = scratch_path(spark, "vectors")
    vectors = src.vectors(spark, sf)
    dense.write_vectors(vectors, "model-a", path)
    good = dense.restore_vectors(spark, path, "model-a", vectors)
    grown = vectors.select("doc_key").unionByName(src.corpus(spark, sf).select("doc_key")).distinct()
    checks = {"same": good is not None, "other_corpus": dense.restore_vectors(spark, path, "model-a", grown) is not None,
              "other_model": dense.restore_vectors(spark, path, "model-b", vectors) is not None}
    stats = good.agg(F.count("*").alias("n_rows"), F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)), 3).alias("total"))
    return stats.select("*", *[F.lit(v).alias(k) for k, v in checks.items()])


_NAME = "p_name || CASE p_partkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.tar.MD' WHEN 2 THEN '' WHEN 3 THEN '.exe' WHEN 4 THEN '.docx' ELSE '.txt.bak' END"


def _a19(spark, sf):
    rows = src.table(spark, sf, "part").selectExpr("p_partkey", f"{_NAME} AS name")
    return rows.select("p_partkey", is_allowed_file(F.col("name")).alias("allowed"))


def _stream(spark, sf, name):
    """A table as a stream of its files (a folder of files, or one local file)."""
    reader = spark.readStream.schema(src.table(spark, sf, name).schema)
    if os.path.isfile(f"{sf}/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return reader.parquet(f"{sf}/{name}.parquet")


def _g1(spark, sf):
    path = scratch_path(spark, "uploads")
    ups = lambda: _stream(spark, sf, "documents").select(F.col("source").alias("session_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"), "text")
    jobs.stream_uploads(ups(), path, f"{path}-state-a")
    jobs.stream_uploads(ups(), path, f"{path}-state-b")  # everything delivered a second time
    return spark.read.parquet(path).select("chunk_key", "session_id", "chunk_no", F.md5("text").alias("text_md5"))


def _g1_repeated(spark, sf):
    """All documents of a source under one name, file by file, delivered twice."""
    path = scratch_path(spark, "uploads")
    ups = lambda: _stream(spark, sf, "documents").select(F.col("source").alias("session_id"), F.concat(F.lit("f"), F.col("lang")).alias("filename"), "text")
    jobs.stream_uploads(ups(), path, f"{path}-state-a")
    jobs.stream_uploads(ups(), path, f"{path}-state-b")
    stored = spark.read.parquet(path)
    return stored.groupBy("session_id", "filename").agg(
        F.count("*").alias("chunks"), F.countDistinct("chunk_key").alias("keys"), F.max("chunk_no").cast("long").alias("last"), F.sum(F.char_length("text")).alias("n_chars"))


def _g1_twice(spark, sf):
    """Every document uploaded twice on purpose, under ids of its own, then all of it delivered again."""
    path = scratch_path(spark, "uploads")
    ups = lambda: _stream(spark, sf, "documents").select(
        F.col("source").alias("session_id"), F.concat(F.lit("f"), F.col("lang")).alias("filename"), "text",
        F.explode(F.array(*[F.concat(F.col("doc_id").cast("string"), F.lit(f"-{n}")) for n in (1, 2)])).alias("upload_id"))
    jobs.stream_uploads(ups(), path, f"{path}-state-a")
    jobs.stream_uploads(ups(), path, f"{path}-state-b")
    return spark.read.parquet(path).groupBy("session_id", "filename").agg(
        F.count("*").alias("chunks"), F.countDistinct("chunk_key").alias("keys"), F.max("chunk_no").cast("long").alias("last"),
        F.countDistinct("upload").alias("uploads"), F.sum(F.char_length("text")).alias("n_chars"))


def _g2(spark, sf):
    path = scratch_path(spark, "audits")
    rows = _stream(spark, sf, "orders").selectExpr(*src.ANSWER_EXPRS).select(
        "answer_id", "answer", F.array("context_line").alias("context_cites"), F.array("chunk_line", F.lit(" ")).alias("chunk_cites"))
    jobs.stream_audits(rows, src.provisions(spark, sf), path, f"{path}-state")
    audit = jobs.stored_audits(spark, path)
    return audit.select(*[F.array_join(c, "|").alias(c) if c in ("verified", "unverified", "hallucinated_context") else F.col(c) for c in audit.columns])


def _g3(spark, sf):
    path = scratch_path(spark, "greetings")
    msgs = _stream(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", F.when(F.col("role") == "user", F.concat(F.lit("thanks"), F.lit("!"))).otherwise(F.col("text")).alias("text"))
    jobs.stream_first_greetings(msgs, path, f"{path}-state")
    return jobs.stored_first_greetings(spark.read.parquet(path))


QUERIES.update({
    "a1_corpus_scan": _a1, "a2_text_reader": _a2, "a3_table_reader": _a3, "a4_parquet_reader": _a4, "a5_page_reader": _a5, "a6_legislation_xml": _a6,
    "a7_multi_source": _a7, "a8_page_provisions": _a8, "a9_free_headers": _a9, "a10_question_csv": _a10, "a11_training_records": _a11,
    "a12_html_pages": lambda s, sf: html.extract_page(_pages(s, sf)), "a13_canonical_links": _a13, "a13_page_links": lambda s, sf: html.links(_pages(s, sf)),
    "a13_reachable": _a13_reachable, "a14_slugs": _a14, "a15_result_sink": _a15, "a16_run_registry": _a16, "a16_latest_run": _a16_latest, "a17_exports": _a17, "a18_vector_cache": _a18,
    "a19_file_admission": _a19, "g1_stream_uploads": _g1, "g1_repeated_names": _g1_repeated, "g1_uploaded_twice": _g1_twice, "g2_stream_audits": _g2, "g3_first_greeting": _g3,
})

# --- DuckDB twins --------------------------------------------------------
_FILES = "SELECT doc_id // 10 AS g, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY 1"
_ENT = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"
_H = """SELECT url, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages"""
_PG = f"""SELECT url, {_ENT.format("regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title, list_transform(regexp_extract_all(regexp_replace(regexp_replace(h, '(?i)<p(?:\\s[^>]*)?>', chr(1), 'g'), '(?i)</p>', chr(2), 'g'), chr(1) || '([^' || chr(1) || chr(2) || ']*)', 1),
  lambda p: {_ENT.format('p')}) AS ps, regexp_extract(h, '(?is)<div[^>]*class="(?:[^"]*\\s)?date(?:\\s[^"]*)?"[^>]*>(.*?)</div>', 1) AS dd, regexp_extract(h, '(?is)<div[^>]*class="(?:[^"]*\\s)?headnote(?:\\s[^"]*)?"[^>]*>(.*?)</div>', 1) AS hn FROM ({_H})"""
_LINKS = """SELECT DISTINCT url, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href
  ELSE CASE WHEN regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*)?/)', 1) = '' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' ELSE regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*)?/)', 1) END || href END AS link
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) WHERE href <> '' AND href NOT IN ('./', '../') AND href NOT LIKE '#%'"""
_CUT = "CASE WHEN len(text) <= 1500 THEN [text] ELSE list_filter(list_transform(range(0, len(text), 1350), lambda i: trim(substr(text, i + 1, 1500), " + _BLANKS + ")), lambda x: x <> '') END"
_XML_BASE = f"""x AS (SELECT p_partkey, {_SLUG} AS slug, CAST(p_partkey % 700 AS STRING) AS number, p_partkey // 1000 AS piece, 'Rule ' || CAST(p_partkey AS STRING) AS title,
    trim(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey % 700 AS STRING) || ' ' END || CASE WHEN p_partkey % 11 = 0 THEN '. . . . .' ELSE 'A firm that sells the ' || p_name || ' must keep full records of every sale.' END) AS text FROM part),
  f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY slug, piece, number ORDER BY p_partkey) = 1), k AS (SELECT * FROM f WHERE len(regexp_replace(text, '[\\s.…]+', '', 'g')) >= 40),
  s(slug, short_doc, regulator, domain, kind) AS (VALUES {', '.join(str((a, d, e, g, h)) for a, _, d, e, g, h in fv.LEGISLATION_SOURCES)}), kx AS (SELECT k.*, short_doc, regulator, domain, kind FROM k JOIN s USING (slug))"""

ORACLE.update({
    "a1_corpus_scan": f"""SELECT 'txt' AS kind, count(*) AS n_files, sum(len(text)) AS n_chars FROM ({_FILES})
      UNION ALL SELECT 'csv', count(*), sum(len(t)) FROM (SELECT string_agg(CAST(event_id AS STRING) || ' ' || event_type, ' ') AS t FROM events GROUP BY event_type)
      UNION ALL SELECT 'parquet', count(*), sum(len(t)) FROM (SELECT string_agg(props, ' ') || ' ' || string_agg(event_type, ' ') AS t FROM events GROUP BY event_type)""",
    "a2_text_reader": f"SELECT CAST(g AS STRING) AS grp, len(text) AS n_chars, md5(text) AS text_md5 FROM ({_FILES})",
    "a3_table_reader": "SELECT CAST(user_id AS STRING) AS grp, md5(string_agg(CAST(event_id AS STRING) || ' ' || event_type || ' ' || CAST(CAST(value AS DECIMAL(20,2)) AS STRING), ' ' ORDER BY event_id)) AS text_md5 FROM events GROUP BY user_id",
    "a4_parquet_reader": "SELECT CAST(user_id AS STRING) AS grp, md5(string_agg(event_type, ' ' ORDER BY event_id) || ' ' || string_agg(props, ' ' ORDER BY event_id)) AS text_md5 FROM events GROUP BY user_id",
    "a5_page_reader": "SELECT CAST(doc_id // 10 AS STRING) AS grp, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS page_no, md5(trim(text, chr(10))) AS page_md5 FROM documents WHERE trim(text, chr(10)) <> ''",
    "a6_legislation_xml": f"""WITH {_XML_BASE} SELECT upper(replace(slug, '_', '')) || '_' || kind || number AS id, short_doc || ' ' || kind || '.' || number AS cite, title, text, regulator AS module, short_doc AS document,
      '/' || short_doc || '/' || kind || '.' || number AS hierarchy_path FROM kx""",
    "a7_multi_source": f"WITH {_XML_BASE} SELECT short_doc AS document, regulator, domain, count(*) AS n FROM kx GROUP BY ALL",
    "a8_page_provisions": f"""WITH d AS (SELECT CASE lang WHEN 'en' THEN 'fca' WHEN 'fr' THEN 'pra_pdfs' ELSE 'eu' END AS folder, source || '-' || CAST(doc_id AS STRING) AS stem, {_CUT} AS cs FROM documents WHERE len(text) >= 200),
      e AS (SELECT *, unnest(cs) AS chunk, generate_subscripts(cs, 1) - 1 AS n, CASE folder WHEN 'fca' THEN 'FCA' WHEN 'pra_pdfs' THEN 'PRA' ELSE 'EU' END AS module FROM d)
      SELECT 'PDF_' || replace(stem, '-', '_') || '_c' || n AS id, module || ' (' || stem || ' p' || (n + 1) || ')' AS cite, stem || ' (excerpt ' || (n + 1) || ')' AS title, md5(chunk) AS text_md5, module,
      CASE folder WHEN 'fca' THEN 'Handbook' ELSE 'Rulebook' END AS domain, stem AS document, CASE folder WHEN 'pra_pdfs' THEN 'PRA' ELSE 'FCA' END AS regulator, '/' || folder || '/' || stem || '.pdf/chunk' || n AS hierarchy_path FROM e""",
    "a9_free_headers": """SELECT question, domain, complexity, compliance_class, '' AS gold_answer, source_file, count(*) AS n FROM (
      SELECT p_name AS question, p_brand AS domain, CASE WHEN p_size % 2 = 0 THEN 'advanced' ELSE 'basic' END AS complexity, '' AS compliance_class, 'part' AS source_file FROM part
      UNION ALL SELECT c_name || ' of ' || c_mktsegment, 'unspecified', 'intermediate', 'Non-compliant', 'customer' FROM customer
      UNION ALL SELECT o_orderstatus || ' | ' || left(o_orderpriority, 1), 'unspecified', 'intermediate', '', 'orders' FROM orders) GROUP BY ALL""",
    "a10_question_csv": """SELECT CAST(item_id AS STRING) AS id, 'd' AS domain, 'basic' AS complexity, replace(text, chr(10), ' ') AS question, 'gold, with comma' AS gold_answer, NULL AS expected_citations, 'k|l' AS expected_keywords
      FROM benchmark ORDER BY item_id LIMIT 25""",
    "a11_training_records": f"""SELECT 'legislation' AS type, document || '§' || id AS source, count(*) AS n, sum(len(text)) AS n_chars FROM ({src.PROVISIONS_SQL}) GROUP BY ALL
      UNION ALL SELECT 'fca_pdf', source, count(*), sum(len(p)) FROM (SELECT source, trim(unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))), {_BLANKS}) AS p FROM documents) WHERE len(p) >= 50 GROUP BY source
      UNION ALL SELECT 'slice', role, count(*), sum(len(text)) FROM conversations GROUP BY role""",
    "a12_html_pages": f"""SELECT url, title, coalesce(nullif({_ENT.format('dd')}, ''), CASE WHEN regexp_matches(ps[1], '[0-9]{{1,2}}\\s+[A-Za-z]+\\s+[0-9]{{4}}') THEN ps[1] END) AS date,
      coalesce(nullif({_ENT.format('hn')}, ''), array_to_string(ps[1:2], ' ')) AS summary FROM ({_PG})""",
    "a13_page_links": _LINKS,
    "a13_canonical_links": f"""SELECT DISTINCT link FROM (SELECT link, regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM ({_LINKS})) WHERE regexp_matches(path, '^/[^/?#]+/?$') AND NOT regexp_matches(path, '/\\d{{4}}-\\d{{2}}-\\d{{2}}/?$')""",
    "a13_reachable": f"""WITH l AS MATERIALIZED ({_LINKS}), v0 AS (SELECT DISTINCT url FROM pages), v1 AS (SELECT DISTINCT link AS url FROM l WHERE link NOT IN (SELECT url FROM v0)),
      v2 AS (SELECT DISTINCT link AS url FROM l WHERE url IN (SELECT url FROM v1) AND link NOT IN (SELECT url FROM v0) AND link NOT IN (SELECT url FROM v1))
      SELECT url, 0 AS depth FROM v0 UNION ALL SELECT url, 1 FROM v1 UNION ALL SELECT url, 2 FROM v2""",
    "a14_slugs": f"""WITH p AS (SELECT url, title, regexp_extract(url, '([^/]*)$', 1) AS last, array_to_string(list_transform(string_split(title, ''), lambda ch: CASE WHEN strip_accents(ch) <> ch THEN strip_accents(ch) || '_' ELSE ch END), '') AS ft FROM ({_PG}))
      SELECT url, lower(trim(regexp_replace(title, '[^0-9A-Za-z\\-]+', '_', 'g'), '_')) AS slug, lower(trim(regexp_replace(ft, '[^0-9A-Za-z\\-]+', '_', 'g'), '_')) AS folded_slug,
      lower(trim(regexp_replace(CASE WHEN lower(last) LIKE '%.pdf' THEN last ELSE CASE WHEN last = '' THEN 'part' ELSE last END || '.pdf' END, '[^0-9A-Za-z\\-]+', '_', 'g'), '_')) AS file_name FROM p""",
    "a15_result_sink": f"""SELECT qid, round({_jac('aw', 'gw')}, 4) AS lex_jaccard, md5(replace(answer, chr(10), ' ||| ')) AS contexts_md5 FROM (SELECT qid, answer, {sql_tokens('answer')} AS aw, {sql_tokens('ground_truth')} AS gw FROM ({_REC_SQL}))""",
    "a16_run_registry": f"""SELECT run_id, count(*) AS n_rows, bool_or(event_type = 'purchase' AND value > 20) AS has_summary FROM (SELECT *, {_RUN} AS run_id FROM events) GROUP BY run_id ORDER BY run_id DESC LIMIT 30""",
    "a16_latest_run": f"SELECT run_id, event_id, value FROM (SELECT *, {_RUN} AS run_id FROM events) WHERE run_id = (SELECT max({_RUN}) FROM events)",
    "a17_exports": "SELECT fmt, doc_id, lang, md5(regexp_replace(text, '\\s+', ' ', 'g')) AS summary_md5 FROM documents, (VALUES ('json'), ('csv'), ('tsv')) f(fmt)",
    "a18_vector_cache": "SELECT count(*) AS n_rows, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 3) AS total, true AS same, NOT EXISTS (SELECT 1 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS other_corpus, false AS other_model FROM embeddings",
    "a19_file_admission": f"SELECT p_partkey, contains(name, '.') AND lower(string_split(name, '.')[-1]) IN ('pdf', 'docx', 'txt', 'md') AS allowed FROM (SELECT p_partkey, {_NAME} AS name FROM part)",
    "g1_stream_uploads": f"""WITH d AS (SELECT source, doc_id, trim(regexp_replace(regexp_replace({sql_scrub('text')}, '(?s)<think>.*?</think>', '', 'gi'), '</?json>', '', 'gi'), {_BLANKS}) AS text FROM documents), e AS (SELECT *, {_CUT} AS cs FROM d),
      u AS (SELECT source, doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) - 1 AS n FROM e)
      SELECT 'session::doc' || doc_id || '::' || n AS chunk_key, source AS session_id, n AS chunk_no, md5(chunk) AS text_md5 FROM u WHERE chunk <> ''""",
    "g1_repeated_names": f"""WITH d AS (SELECT DISTINCT source, 'f' || lang AS filename, text AS raw, trim(regexp_replace(regexp_replace({sql_scrub('text')}, '(?s)<think>.*?</think>', '', 'gi'), '</?json>', '', 'gi'), {_BLANKS}) AS text FROM documents),
      u AS (SELECT source, filename, unnest({_CUT}) AS chunk FROM d)
      SELECT source AS session_id, filename, count(*) AS chunks, count(*) AS keys, count(*) - 1 AS last, sum(len(chunk)) AS n_chars FROM u WHERE trim(chunk, {_BLANKS}) <> '' GROUP BY ALL""",
    "g1_uploaded_twice": f"""WITH d AS (SELECT source, 'f' || lang AS filename, doc_id, trim(regexp_replace(regexp_replace({sql_scrub('text')}, '(?s)<think>.*?</think>', '', 'gi'), '</?json>', '', 'gi'), {_BLANKS}) AS text FROM documents),
      u AS (SELECT source, filename, doc_id, unnest({_CUT}) AS chunk FROM d)
      SELECT source AS session_id, filename, 2 * count(*) AS chunks, 2 * count(*) AS keys, 2 * count(*) - 1 AS last, 2 * count(DISTINCT doc_id) AS uploads, 2 * sum(len(chunk)) AS n_chars
      FROM u WHERE trim(chunk, {_BLANKS}) <> '' GROUP BY ALL""",
    "g2_stream_audits": VERIFY_ORACLE["e1_citation_audit"],
    "g3_first_greeting": f"""SELECT conv_id AS session_id, min(turn) AS turn FROM conversations WHERE role = 'user' OR (len(trim(text, {_BLANKS})) >= 2 AND len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) <= 3) GROUP BY conv_id""",
})
