"""Registered queries of the retrieval group (keys c*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark import fixed_values as fv
from lexspark.operators import answering, dense, graph_build as gb, graph_walk as gw, hybrid, postings, ranking, session_chunks
from lexspark.functions.citations import extract_citations
from lexspark.functions.text import snippet
from lexspark.plans import inputs as src
from lexspark.plans.graph import boost_sql, sql_citations
from lexspark.operators.stored_index import StoredIndex
from lexspark.plugins import hashing_embedder
from lexspark.session import scratch_path
from lexspark.plans.inputs import CORPUS_SQL, QUERY_VECTORS_SQL, QUESTIONS_SQL, VECTORS_SQL, sql_in_order, sql_tokens

QUERIES, ORACLE = {}, {}

# --- shared DuckDB pieces ------------------------------------------------
def sql_bm25(queries: str = QUESTIONS_SQL) -> str:
    """CTEs from corpus(doc_key, text) to bm(query_id, doc_key, score)."""
    return f"""q AS ({queries}),
tok AS (SELECT doc_key, unnest({sql_tokens('text')}) AS tok FROM corpus),
post AS (SELECT doc_key, tok, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_key, len({sql_tokens('text')}) AS doc_len FROM corpus),
cs AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM dl),
dfs AS (SELECT tok, count(*) AS df FROM post GROUP BY tok),
raw AS (SELECT tok, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, cs),
idf AS (SELECT tok, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, tok, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens('text')}) AS tok FROM q) GROUP BY ALL),
bm AS (SELECT query_id, doc_key, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))), 4) AS score
  FROM qt JOIN idf USING (tok) JOIN post USING (tok) JOIN dl USING (doc_key), cs GROUP BY ALL)"""


_CTE = f"""corpus AS ({CORPUS_SQL}), {sql_bm25()}, vec AS ({VECTORS_SQL}), qvec AS ({QUERY_VECTORS_SQL}),
sim AS (SELECT query_id, doc_key, round(list_dot_product(CAST(qvec.embedding AS DOUBLE[]), CAST(vec.embedding AS DOUBLE[])), 4) AS score FROM qvec, vec)"""


def _ranked(source: str, k: int, name: str, extra: str = "") -> str:
    return (f"{name} AS (SELECT * FROM (SELECT query_id, doc_key, score, row_number() OVER (PARTITION BY query_id"
            f" ORDER BY score DESC, doc_key) AS rank FROM {source} {extra}) WHERE rank <= {k})")


def _clean(snip: str, start: str = "1") -> str:
    raw = f"substr({snip}, {start}, 2200)"
    return f"trim(regexp_replace({raw}, '\\s+', ' ', 'g')) || CASE WHEN len({raw}) = 2200 THEN '…' ELSE '' END"


def _c1(spark, sf):
    p = postings.build_postings(src.corpus(spark, sf))
    return p.groupBy("tok").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"), F.min("first_pos").alias("earliest"))


def _c2(spark, sf):
    index = postings.bm25_index(src.corpus(spark, sf))
    idf = index.terms.select("tok", "df", F.round("idf", 6).alias("idf"))
    return idf.withColumn("n_docs", index.n_docs).withColumn("avgdl", F.round(index.avgdl, 4))


def _c1_stored(spark, sf):
    """The contents of the stored index."""
    return src.stored_index(spark, sf).token_summary()


def _c3(spark, sf):
    return src.stored_index(spark, sf).bm25(src.questions(spark, sf), 10)


def _c3_scan(spark, sf):
    """The same ranking straight from the texts."""
    return postings.bm25_scores(src.questions(spark, sf), src.corpus(spark, sf), 10)


def _c4(spark, sf):
    docs = src.corpus(spark, sf)
    hits = src.stored_index(spark, sf).phrase_search(src.questions(spark, sf), docs, fv.TOP_K)
    return hits.join(docs, "doc_key").select("query_id", "doc_key", "rank", snippet(F.col("text"), F.col("hit_pos")).alias("snippet"))


def _c5(spark, sf):
    return src.stored_index(spark, sf).keyword_overlap(src.questions(spark, sf), fv.TOP_K)


def _c5_snippets(spark, sf):
    q = src.questions(spark, sf)
    hits = hybrid.keyword_snippets(_c5(spark, sf), q, src.corpus(spark, sf))
    return hits.select("query_id", "doc_key", "rank", F.md5("snippet").alias("snippet_md5"))


def _c8_segments(spark, sf):
    """An index grown by one delivery a language, the last one holding all documents again, then merged: ranks as after a rebuild."""
    docs = src.text_table(spark, sf, "documents").select(F.concat(F.lit("static::"), F.col("doc_id").cast("string")).alias("doc_key"), "text", "lang")
    part = lambda rows: docs.where(rows).select("doc_key", "text")
    index = StoredIndex.create(part("lang = 'en'"), scratch_path(spark, "index"))
    index = index.append(part("lang IN ('de', 'fr')")).append(part("true")).merge()
    hits = index.bm25(src.questions(spark, sf), 10)
    return hits.withColumn("n_docs", F.lit(index.totals.n_docs)).withColumn("segments", F.lit(len(index.live)))


def _c7(spark, sf):
    return dense.knn(src.query_vectors(spark, sf), src.vectors(spark, sf), 10)


def _c8(spark, sf):
    """A grown corpus: uploads get counter keys, re-delivered keys are ignored."""
    docs = src.corpus(spark, sf)
    new = src.questions(spark, sf).select(F.concat(F.lit("static::"), "query_id").alias("doc_key"), "text")
    turns = src.text_table(spark, sf, "conversations")
    numbered = hybrid.number_uploads(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"], docs)
    grown = docs.unionByName(dense.unseen(new, docs)).unionByName(numbered)
    return grown.select("doc_key", F.length("text").alias("n_chars"))


def _c9(spark, sf):
    hits = dense.knn(src.query_vectors(spark, sf), src.vectors(spark, sf), 16)
    return dense.dropped_below(hits)


def _sessions(spark, sf):
    docs = src.table(spark, sf, "documents").join(src.table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return docs.select(F.col("source").alias("session_id"), F.concat(F.lit("session::"), F.col("doc_id").cast("string")).alias("doc_key"), "text", "embedding")


def _session_queries(spark, sf):
    qv = src.query_vectors(spark, sf)
    return qv.select("query_id", F.concat(F.lit("src"), (F.col("query_id").cast("int") % 20).cast("string")).alias("session_id"), "embedding")


def _c10(spark, sf):
    hits = dense.knn(_session_queries(spark, sf), _sessions(spark, sf), 5, scope=["session_id"])
    return hits


_UPLOAD_EVENTS = ["CAST(user_id AS STRING) AS session_id", "event_type AS filename", "event_id AS seq", "props AS text", "ts"]


def _c11(spark, sf):
    ups = src.table(spark, sf, "events").selectExpr(*_UPLOAD_EVENTS)
    return session_chunks.append_chunks(ups).select("session_id", "filename", "chunk_key", "seq")


def _c11_counts(spark, sf):
    ups = src.table(spark, sf, "events").selectExpr(*_UPLOAD_EVENTS)
    return session_chunks.chunk_counts(session_chunks.append_chunks(ups))


def _c12(spark, sf):
    ups = src.table(spark, sf, "events").selectExpr(*_UPLOAD_EVENTS)
    kept = session_chunks.keep_recent_sessions(ups)
    return kept.groupBy("session_id").agg(F.count("*").alias("chunks"))


def _c13(spark, sf):
    q = src.questions(spark, sf)
    bm = src.stored_index(spark, sf).bm25(q, 16).select("query_id", "doc_key", "rank")
    dn = dense.knn(src.query_vectors(spark, sf), src.vectors(spark, sf), 16).select("query_id", "doc_key", "rank")
    return ranking.reciprocal_rank_fusion(bm.unionByName(dn), 10)


def _c14(spark, sf):
    hits = hybrid.hybrid_search(
        src.questions(spark, sf), src.corpus(spark, sf), src.query_vectors(spark, sf), src.vectors(spark, sf),
        k=fv.TOP_K, rerank=True, index=src.stored_index(spark, sf),
        session_queries=_session_queries(spark, sf), session_chunks=_sessions(spark, sf))
    return hits.select("query_id", "doc_key", "rank", F.length("snippet").alias("snippet_chars"), F.md5("snippet").alias("snippet_md5"))


def _c14_modes(spark, sf):
    frames, index = [], src.stored_index(spark, sf)
    for mode in ("rrf", "dense", "bm25"):
        hits = hybrid.hybrid_search(src.questions(spark, sf), src.corpus(spark, sf), src.query_vectors(spark, sf),
                                    src.vectors(spark, sf), k=fv.TOP_K, mode=mode, index=index)
        frames.append(hits.select(F.lit(mode).alias("mode"), "query_id", "doc_key", "rank"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _c15(spark, sf):
    q, docs = src.questions(spark, sf), src.corpus(spark, sf)
    pool = src.stored_index(spark, sf).bm25(q, fv.RERANK_POOL).join(docs, "doc_key")
    pool = pool.select("query_id", "doc_key", "rank", snippet(F.col("text")).alias("snippet"))
    return hybrid.rerank(pool, q, 5).select("query_id", "doc_key", "rank")


def _cascade_inputs(spark, sf):
    """Questions without a vector and user turns, the first turn of a
    conversation being embedded as vector conv_id."""
    bench = src.questions(spark, sf).select(F.concat(F.lit("b"), "query_id").alias("query_id"), "text")
    turns = src.text_table(spark, sf, "conversations").where("role = 'user'")
    key = F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    users = turns.select(key.alias("query_id"), "text", "conv_id", "turn")
    emb = src.table(spark, sf, "embeddings")
    qv = users.where("turn = 0").join(emb, F.col("conv_id") == F.col("vec_id")).select("query_id", "embedding")
    return bench.unionByName(users.select("query_id", "text")), qv


def _c16(spark, sf):
    q, qv = _cascade_inputs(spark, sf)
    hits = hybrid.cascade(q, src.corpus(spark, sf), qv, src.vectors(spark, sf), k=3, mode="dense", min_score=0.3, index=src.stored_index(spark, sf))
    return hits.select("query_id", "layer", "doc_key", "rank")


def _c18(spark, sf):
    sims = dense.top_similarity(_cascade_inputs(spark, sf)[0], _cascade_inputs(spark, sf)[1], src.vectors(spark, sf))
    return dense.refusal_gate(sims)


def _c19(spark, sf):
    """Citations over the provisions retrieved for each part-name question."""
    prov = src.provisions(spark, sf)
    docs = prov.select(F.col("id").alias("doc_key"), "text")
    q = prov.select(F.col("title").alias("query_id"), F.col("title").alias("text")).distinct()
    hits = postings.bm25_scores(q, docs, fv.TOP_K).join(docs, "doc_key")
    return hybrid.retrieved_citations(hits.select("query_id", snippet(F.col("text")).alias("snippet")))


def _c20(spark, sf):
    docs = src.corpus(spark, sf)
    turns = src.text_table(spark, sf, "conversations")
    ups = hybrid.number_uploads(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"], docs)
    return postings.index_stats(docs.unionByName(ups))


def _c3_fill(spark, sf):
    """Provision titles as questions: most titles match fewer than 400 texts."""
    prov = src.provisions(spark, sf)
    docs = prov.select(F.col("id").alias("doc_key"), F.concat_ws(" ", "title", "domain").alias("text"))
    q = prov.select(F.col("title").alias("query_id"), F.col("title").alias("text")).distinct()
    return postings.with_zero_fill(postings.bm25_scores(q, docs, 400), q, docs, 400)


def _c6(spark, sf):
    rows = hashing_embedder(src.corpus(spark, sf))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("doc_key", F.size("embedding").alias("dim"), F.round(F.sqrt(square), 4).alias("norm"), F.size(F.filter("embedding", lambda x: x > 0)).alias("filled"))


def _c11_kept(spark, sf):
    """Chunks left after clearing the sessions of customers in debt, and how many
    of the known users have a session."""
    chunks = session_chunks.append_chunks(src.table(spark, sf, "events").selectExpr(*_UPLOAD_EVENTS))
    customers = src.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), "c_acctbal")
    left = session_chunks.clear_sessions(chunks, customers.where("c_acctbal < 0"))
    alive = session_chunks.existing_sessions(customers, chunks)
    return left.groupBy("session_id").agg(F.count("*").alias("n")).unionByName(alive.agg(F.lit("alive").alias("session_id"), F.count("*").alias("n")))


def _c11_continued(spark, sf):
    """A second delivery continues the running numbers of the first."""
    ups = src.table(spark, sf, "events").selectExpr(*_UPLOAD_EVENTS)
    first = session_chunks.append_chunks(ups.where("ts < '2024-01-10'"))
    second = session_chunks.append_chunks(ups.where("ts >= '2024-01-10'"), first)
    return first.select("session_id", "chunk_key", "seq").unionByName(second.select("session_id", "chunk_key", "seq"))


def _c17(spark, sf):
    graph = gb.build_graph(src.provisions(spark, sf))
    boost = gw.graph_boost(src.questions(spark, sf), graph)
    contexts = answering.wide_contexts(src.questions(spark, sf), boost, src.corpus(spark, sf), src.query_vectors(spark, sf), src.vectors(spark, sf),
                                       index=src.stored_index(spark, sf))
    return contexts.select("query_id", F.size("contexts").alias("n_contexts"), F.md5(F.array_join("contexts", "\n")).alias("contexts_md5"))


def _c20_lookup(spark, sf):
    docs = src.corpus(spark, sf)
    turns = src.text_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    ups = hybrid.number_uploads(turns, ["conv_id", "turn"], docs)
    wanted = postings.upload_keys(ups).unionByName(src.table(spark, sf, "orders").select(F.concat(F.lit("static::"), F.col("o_orderkey").cast("string")).alias("doc_key")))
    return postings.lookup_documents(wanted, docs.unionByName(ups)).select("doc_key", F.length("text").alias("n_chars"))


QUERIES.update({
    "c1_stored_index": _c1_stored, "c3_bm25_scan": _c3_scan, "c5_keyword_snippets": _c5_snippets, "c8_index_segments": _c8_segments,
    "c3_zero_fill": _c3_fill, "c6_embeddings": _c6, "c11_cleared_sessions": _c11_kept, "c11_continued_numbers": _c11_continued,
    "c17_contexts": _c17, "c20_document_lookup": _c20_lookup,
    "c1_postings": _c1, "c2_bm25_statistics": _c2, "c3_bm25_top_k": _c3, "c4_phrase_search": _c4,
    "c5_keyword_overlap": _c5, "c7_vector_knn": _c7, "c8_index_growth": _c8, "c9_min_score": _c9,
    "c10_session_knn": _c10, "c11_session_chunks": _c11, "c11_session_counts": _c11_counts,
    "c12_recent_sessions": _c12, "c13_rank_fusion": _c13, "c14_hybrid_search": _c14, "c14_hybrid_modes": _c14_modes,
    "c15_rerank": _c15, "c16_cascade": _c16, "c18_refusal_gate": _c18, "c19_retrieved_citations": _c19,
    "c20_index_stats": _c20,
})

_UPLOAD_SQL = f"SELECT {', '.join(_UPLOAD_EVENTS)} FROM events"
_CHUNKS_SQL = (f"SELECT session_id, filename, seq, 'session::' || filename || '::' || CAST(row_number() OVER (PARTITION BY session_id,"
               f" filename ORDER BY seq) - 1 AS STRING) AS chunk_key FROM ({_UPLOAD_SQL}) WHERE trim(text) <> ''")
_SESSION_SQL = f"""ses AS (SELECT source AS session_id, 'session::' || CAST(doc_id AS STRING) AS doc_key, text, embedding
  FROM documents JOIN embeddings ON doc_id = vec_id),
sq AS (SELECT query_id, 'src' || CAST(CAST(query_id AS INTEGER) % 20 AS STRING) AS session_id, embedding FROM qvec),
ssim AS (SELECT query_id, doc_key, round(list_dot_product(CAST(sq.embedding AS DOUBLE[]), CAST(ses.embedding AS DOUBLE[])), 4) AS score
  FROM sq JOIN ses USING (session_id))"""
_RRF = "(SELECT query_id, doc_key, round(sum(1.0 / (60 + rank)), 10) AS score FROM {lists} GROUP BY ALL)"
_UPLOADED_SQL = ("SELECT 'upload::' || CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS STRING) AS doc_key, text"
                 " FROM conversations WHERE text <> ''")

_CONTENT = "regexp_extract_all(lower({0}), '[a-z]{{3,}}')"
_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in fv.CONTENT_STOP_WORDS) + "]"


def _content_set(column: str) -> str:
    words = _CONTENT.format(column)
    return f"list_distinct(list_filter({words}, lambda w: NOT list_contains({_STOP_LIST}, w)))"


def _pair_score(question: str, text: str) -> str:
    a, b = _content_set(question), _content_set(text)
    return f"round(len(list_intersect({a}, {b})) / greatest(1, len({a})), 6)"


def _hybrid_sql(mode: str) -> str:
    lists = {"rrf": ["b16", "d16"], "dense": ["d16"], "bm25": ["b16"]}[mode]
    fused = (f"fused AS (SELECT * FROM (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM "
             + _RRF.format(lists="(" + " UNION ALL ".join(f"SELECT query_id, doc_key, rank FROM {x}" for x in lists) + ")")
             + f") WHERE rank <= {fv.TOP_K})")
    return ("WITH " + _CTE + ", " + _ranked("bm", 16, "b16") + ", " + _ranked("sim", 16, "d16", "WHERE score >= 0.35") + ", " + fused
            # keys without a text drop out of the list, the rest move up
            + f" SELECT '{mode}' AS mode, query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY fused.rank) AS rank FROM fused JOIN corpus USING (doc_key) WHERE text <> ''")


def contexts_sql() -> str:
    """(query_id, part, rank, body): bullets of the graph boost, then snippets of the fused hits."""
    return f"""SELECT query_id, 0 AS part, pos AS rank, substr(line, 3) AS body FROM (SELECT query_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (
        SELECT query_id, string_split(context_md, chr(10)) AS ls FROM ({boost_sql(QUESTIONS_SQL)}))) WHERE line LIKE '- %' AND len(line) > 4
      UNION ALL SELECT query_id, 1, rank, {_clean('c.text')} AS body FROM ({_hybrid_sql('rrf')}) h JOIN ({CORPUS_SQL}) c USING (doc_key) WHERE trim(c.text) <> ''"""


def _times(x: str, c: int) -> str:
    return f"((({x}) * {c}::UBIGINT) & 4294967295::UBIGINT)"


def _rotated(x: str, n: int) -> str:
    return f"(((({x}) * {1 << n}::UBIGINT) & 4294967295::UBIGINT) | (({x}) >> {32 - n}))"


def _murmur(table: str) -> str:
    """CTEs up to hashed(tok, h): 32-bit Murmur3 of the UTF-8 bytes with seed 42, the hash of Spark's hashed term counts."""
    byte = "((strpos('0123456789ABCDEF', hx[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hx[2 * i + 2]) - 1)::UBIGINT"
    mixed = lambda k: _times(_rotated(_times(k, 0xCC9E2D51), 15), 0x1B873593)
    rounds = f"{_times(_rotated('xor(h, k)', 13), 5)}"
    return f"""bytes AS (SELECT tok, list_transform(range(0, len(hx) // 2), lambda i: {byte}) AS bs FROM (SELECT tok, hex(encode(tok)) AS hx FROM {table})),
      words AS (SELECT tok, len(bs)::UBIGINT AS n, list_transform(range(0, len(bs) // 4), lambda i: bs[4 * i + 1] + bs[4 * i + 2] * 256 + bs[4 * i + 3] * 65536 + bs[4 * i + 4] * 16777216) AS ks,
        coalesce(list_sum(list_transform(range(len(bs) // 4 * 4, len(bs)), lambda i: bs[i + 1] * (1::UBIGINT << (8 * (i % 4))::UBIGINT)))::UBIGINT, 0::UBIGINT) AS rest FROM bytes),
      h0 AS (SELECT tok, n, rest, list_reduce(list_transform(ks, lambda k: {mixed('k')}), lambda h, k: ({rounds} + 3864292196::UBIGINT) & 4294967295::UBIGINT, 42::UBIGINT) AS h FROM words),
      h1 AS (SELECT tok, xor(xor(h, {mixed('rest')}), n) AS h FROM h0), h2 AS (SELECT tok, {_times('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM h1),
      h3 AS (SELECT tok, {_times('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM h2), hashed AS (SELECT tok, xor(h, h >> 16)::BIGINT AS h FROM h3)"""


ORACLE.update({
    "c6_embeddings": f"""WITH d AS (SELECT doc_key, {sql_tokens('text')} AS toks FROM ({CORPUS_SQL})), t AS (SELECT DISTINCT unnest(toks) AS tok FROM d), {_murmur('t')},
      b AS (SELECT tok, (((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 384) + 384) % 384 AS place FROM hashed),
      f AS (SELECT doc_key, count(DISTINCT place) AS filled FROM (SELECT doc_key, unnest(toks) AS tok FROM d) JOIN b USING (tok) GROUP BY doc_key)
      SELECT doc_key, 384 AS dim, CASE WHEN filled IS NULL THEN 0.0 ELSE 1.0 END AS norm, coalesce(filled, 0) AS filled FROM d LEFT JOIN f USING (doc_key)""",
    "c17_contexts": f"SELECT query_id, count(*) AS n_contexts, md5(string_agg(body, chr(10) ORDER BY part, rank)) AS contexts_md5 FROM ({contexts_sql()}) GROUP BY query_id",
    "c3_zero_fill": f"""WITH prov AS ({src.PROVISIONS_SQL}), corpus AS (SELECT id AS doc_key, concat_ws(' ', title, domain) AS text FROM prov), {sql_bm25('SELECT DISTINCT title AS query_id, title AS text FROM prov')},
      al AS (SELECT q.query_id AS query_id, c.doc_key AS doc_key, coalesce(score, 0.0) AS score FROM q CROSS JOIN corpus c LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_key = c.doc_key),
      k AS (SELECT *, score <> 0 OR EXISTS (SELECT 1 FROM bm WHERE bm.query_id = al.query_id AND bm.doc_key = al.doc_key) AS hit FROM al), {_ranked('k', 400, 'r')} SELECT * FROM r""",
    "c11_cleared_sessions": f"""WITH c AS ({_CHUNKS_SQL}), l AS (SELECT session_id, count(*) AS n FROM c WHERE session_id NOT IN (SELECT CAST(c_custkey AS STRING) FROM customer WHERE c_acctbal < 0) GROUP BY 1)
      SELECT * FROM l UNION ALL SELECT 'alive', count(*) FROM customer WHERE CAST(c_custkey AS STRING) IN (SELECT session_id FROM c)""",
    "c11_continued_numbers": f"""WITH u AS (SELECT * FROM ({_UPLOAD_SQL}) WHERE trim(text) <> '') SELECT session_id, seq, 'session::' || filename || '::' || CAST(row_number() OVER (PARTITION BY session_id, filename
      ORDER BY ts >= TIMESTAMP '2024-01-10', seq) - 1 AS STRING) AS chunk_key FROM u""",
    "c19_retrieved_citations": f"""WITH prov AS ({src.PROVISIONS_SQL}), corpus AS (SELECT id AS doc_key, text FROM prov), {sql_bm25('SELECT DISTINCT title AS query_id, title AS text FROM prov')}, {_ranked('bm', fv.TOP_K, 'r')}
      SELECT DISTINCT query_id, unnest({sql_citations('snip')}) AS cite FROM (SELECT query_id, {_clean('text')} AS snip FROM r JOIN corpus USING (doc_key))""",
    "c20_document_lookup": f"""WITH g AS (SELECT * FROM ({CORPUS_SQL}) UNION ALL SELECT * FROM ({_UPLOADED_SQL})), w AS (SELECT doc_key FROM g WHERE doc_key LIKE 'upload::%' UNION ALL SELECT 'static::' || CAST(o_orderkey AS STRING) FROM orders)
      SELECT w.doc_key AS doc_key, len(coalesce(text, '')) AS n_chars FROM w LEFT JOIN g USING (doc_key)""",
    "c1_postings": f"SELECT tok, count(DISTINCT doc_key) AS docs, count(*) AS occurrences, min(pos) AS earliest FROM (SELECT doc_key,"
                   f" unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM (SELECT doc_key, {sql_tokens('text')} AS toks FROM ({CORPUS_SQL}))) GROUP BY tok",
    "c2_bm25_statistics": f"WITH {_CTE} SELECT tok, df, round(idf, 6) AS idf, n AS n_docs, round(avgdl, 4) AS avgdl FROM idf, cs",
    "c3_bm25_top_k": f"WITH {_CTE}, {_ranked('bm', 10, 'r')} SELECT * FROM r",
    "c4_phrase_search": f"""WITH {_CTE}, hit AS (SELECT query_id, doc_key, corpus.text AS text, strpos(lower(corpus.text), lower(q.text)) - 1 AS pos
        FROM q, corpus WHERE contains(lower(corpus.text), lower(q.text))),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_key) AS rank FROM hit)
      SELECT query_id, doc_key, rank, {_clean('text', 'greatest(pos - 200, 0) + 1')} AS snippet FROM r WHERE rank <= {fv.TOP_K}""",
    "c5_keyword_overlap": f"WITH {_CTE}, ov AS (SELECT query_id, doc_key, count(*) AS score FROM qt JOIN post USING (tok) GROUP BY ALL), {_ranked('ov', fv.TOP_K, 'r')} SELECT * FROM r",
    "c5_keyword_snippets": f"""WITH {_CTE}, ov AS (SELECT query_id, doc_key, count(*) AS score FROM qt JOIN post USING (tok) GROUP BY ALL), {_ranked('ov', fv.TOP_K, 'r')},
      w AS (SELECT r.query_id AS query_id, doc_key, rank, corpus.text AS text, {sql_in_order(sql_tokens('q.text'))} AS asked,
        ' ' || regexp_replace(lower(corpus.text), '[^a-z0-9£]', ' ', 'g') || ' ' AS blanked FROM r JOIN corpus USING (doc_key) JOIN q ON q.query_id = r.query_id),
      p AS (SELECT *, list_filter(list_transform(asked, lambda t: strpos(blanked, ' ' || t || ' ')), lambda x: x > 0)[1] - 1 AS pos FROM w)
      SELECT query_id, doc_key, rank, md5({_clean('text', 'greatest(pos - 200, 0) + 1')}) AS snippet_md5 FROM p""",
    "c7_vector_knn": f"WITH {_CTE}, {_ranked('sim', 10, 'r')} SELECT * FROM r",
    "c8_index_growth": f"""WITH corpus AS ({CORPUS_SQL}), new AS (SELECT 'static::' || query_id AS doc_key, text FROM ({QUESTIONS_SQL})),
      up AS ({_UPLOADED_SQL}), grown AS (SELECT * FROM corpus UNION ALL SELECT * FROM new WHERE doc_key NOT IN (SELECT doc_key FROM corpus) UNION ALL SELECT * FROM up)
      SELECT doc_key, len(text) AS n_chars FROM grown""",
    "c9_min_score": f"WITH {_CTE}, {_ranked('sim', 16, 'r')} SELECT query_id, count(*) FILTER (WHERE score >= 0.35) AS kept, count(*) FILTER (WHERE score < 0.35) AS dropped FROM r GROUP BY query_id",
    "c10_session_knn": f"WITH {_CTE}, {_SESSION_SQL}, {_ranked('ssim', 5, 'r')} SELECT * FROM r",
    "c11_session_chunks": f"SELECT session_id, filename, chunk_key, seq FROM ({_CHUNKS_SQL})",
    "c11_session_counts": f"SELECT session_id, filename, count(*) AS chunks FROM ({_CHUNKS_SQL}) GROUP BY ALL UNION ALL SELECT session_id, NULL, count(*) FROM ({_CHUNKS_SQL}) GROUP BY ALL",
    "c12_recent_sessions": f"""WITH up AS ({_UPLOAD_SQL}), s AS (SELECT session_id, row_number() OVER (ORDER BY max(ts) DESC, session_id) AS r FROM up GROUP BY session_id)
      SELECT session_id, count(*) AS chunks FROM up WHERE session_id IN (SELECT session_id FROM s WHERE r <= {fv.MAX_SESSIONS}) GROUP BY session_id""",
    "c13_rank_fusion": f"WITH {_CTE}, {_ranked('bm', 16, 'b16')}, {_ranked('sim', 16, 'd16')}, "
                       + _ranked(_RRF.format(lists="(SELECT query_id, doc_key, rank FROM b16 UNION ALL SELECT query_id, doc_key, rank FROM d16)"), 10, "r") + " SELECT * FROM r",
    "c14_hybrid_search": f"""WITH {_CTE}, {_SESSION_SQL}, {_ranked('bm', 16, 'b16')}, {_ranked('sim', 16, 'd16', 'WHERE score >= 0.35')}, {_ranked('ssim', 16, 's16')},
      {_ranked(_RRF.format(lists="(SELECT query_id, doc_key, rank FROM b16 UNION ALL SELECT query_id, doc_key, rank FROM d16 UNION ALL SELECT query_id, doc_key, rank FROM s16)"), 20, 'pool')},
      txt AS (SELECT query_id, doc_key, rank, {_clean('text')} AS snippet FROM pool JOIN corpus USING (doc_key) WHERE text <> ''
        UNION ALL SELECT query_id, doc_key, rank, text FROM pool JOIN ses USING (doc_key) WHERE text <> ''),
      sc AS (SELECT txt.*, {_pair_score('q.text', 'snippet')} AS pair, count(*) OVER (PARTITION BY query_id) AS n FROM txt JOIN q USING (query_id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 8 THEN pair ELSE 0 END DESC, rank) AS new_rank FROM sc)
      SELECT query_id, doc_key, new_rank AS rank, len(snippet) AS snippet_chars, md5(snippet) AS snippet_md5 FROM r WHERE new_rank <= 8""",
    "c14_hybrid_modes": " UNION ALL ".join(f"SELECT * FROM ({_hybrid_sql(m)})" for m in ("rrf", "dense", "bm25")),
    "c15_rerank": f"""WITH {_CTE}, {_ranked('bm', 20, 'pool')}, txt AS (SELECT query_id, doc_key, rank, {_clean('text')} AS snippet FROM pool JOIN corpus USING (doc_key)),
      sc AS (SELECT txt.*, {_pair_score('q.text', 'snippet')} AS pair, count(*) OVER (PARTITION BY query_id) AS n FROM txt JOIN q USING (query_id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 5 THEN pair ELSE 0 END DESC, rank) AS new_rank FROM sc)
      SELECT query_id, doc_key, new_rank AS rank FROM r WHERE new_rank <= 5""",
    "c16_cascade": f"""WITH corpus AS ({CORPUS_SQL}), vec AS ({VECTORS_SQL}),
      q AS (SELECT 'b' || query_id AS query_id, text FROM ({QUESTIONS_SQL}) UNION ALL
            SELECT 't' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), text FROM conversations WHERE role = 'user'),
      qvec AS (SELECT 't' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS query_id, embedding FROM conversations JOIN embeddings ON conv_id = vec_id WHERE role = 'user' AND turn = 0),
      sim AS (SELECT query_id, doc_key, round(list_dot_product(CAST(qvec.embedding AS DOUBLE[]), CAST(vec.embedding AS DOUBLE[])), 4) AS score FROM qvec, vec),
      l1 AS (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM sim WHERE score >= 0.3) JOIN corpus USING (doc_key) WHERE rank <= 3 AND text <> ''),
      q2 AS (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM l1)),
      l2 AS (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY doc_key) AS rank FROM q2, corpus WHERE q2.text <> '' AND contains(lower(corpus.text), lower(q2.text))),
      q3 AS (SELECT * FROM q2 WHERE query_id NOT IN (SELECT query_id FROM l2)),
      l3 AS (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM
        (SELECT query_id, doc_key, count(*) AS score FROM (SELECT DISTINCT query_id, unnest({sql_tokens('text')}) AS tok FROM q3) a
         JOIN (SELECT DISTINCT doc_key, unnest({sql_tokens('text')}) AS tok FROM corpus) b USING (tok) GROUP BY ALL))
      SELECT query_id, 'hybrid' AS layer, doc_key, rank FROM l1 UNION ALL SELECT query_id, 'phrase', doc_key, rank FROM l2 WHERE rank <= 3
      UNION ALL SELECT query_id, 'keyword', doc_key, rank FROM l3 WHERE rank <= 3""",
    "c18_refusal_gate": f"""WITH q AS (SELECT 'b' || query_id AS query_id FROM ({QUESTIONS_SQL}) UNION ALL
        SELECT 't' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) FROM conversations WHERE role = 'user'),
      best AS (SELECT 't' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS query_id, max(round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 4)) AS s
        FROM conversations c JOIN embeddings e ON c.conv_id = e.vec_id, embeddings v WHERE c.role = 'user' AND c.turn = 0 GROUP BY 1)
      SELECT query_id, coalesce(s, 0.0) AS similarity, coalesce(s, 0.0) < 0.25 AS refused, CASE WHEN coalesce(s, 0.0) < 0.25 THEN '{fv.REFUSAL_TEXT}' END AS answer FROM q LEFT JOIN best USING (query_id)""",
    "c20_index_stats": f"""WITH g AS (SELECT * FROM ({CORPUS_SQL}) UNION ALL SELECT * FROM ({_UPLOADED_SQL}))
      SELECT count(*) AS num_docs, sum(len(text)) AS total_chars, count(*) FILTER (WHERE doc_key LIKE 'upload::%') AS uploads,
      count(*) FILTER (WHERE doc_key LIKE 'static::%') AS statics, (SELECT count(DISTINCT tok) FROM (SELECT unnest({sql_tokens('text')}) AS tok FROM g)) AS num_tokens FROM g""",
})
ORACLE.update({
    "c1_stored_index": ORACLE["c1_postings"], "c3_bm25_scan": ORACLE["c3_bm25_top_k"],
    "c8_index_segments": ORACLE["c3_bm25_top_k"].replace("SELECT * FROM r", "SELECT r.*, n AS n_docs, 1 AS segments FROM r, cs"),
})
