import json

import pytest
from pyspark.sql import functions as F

from lexspark.functions.chunking import chunk_packed
from lexspark.functions.text import file_slug, is_allowed_file
from lexspark.functions import citations as c
from lexspark.sources import files, html, legislation, questions, sinks
from lexspark.streaming import jobs


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "sub" / "b.md").write_bytes(b"good\xff bytes")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "skip.exe").write_text("no")
    (tmp_path / "t.csv").write_text('a,b\n1,"x, y"\n2,\n')
    (tmp_path / "u.csv").write_text("only\nz\n")
    spark.createDataFrame([("p", 1, "r"), ("q", 2, "s")], "c string, n int, d string").coalesce(1).write.parquet(str(tmp_path / "pq"))
    got = {r["doc_key"]: r["text"] for r in files.scan_corpus(spark, str(tmp_path), kinds=("text", "table", "parquet")).collect()}
    parquet = [v for k, v in got.items() if k.startswith("static::pq/")]
    assert parquet == ["p q r s"]
    rest = {k: v for k, v in got.items() if not k.startswith("static::pq/")}
    assert rest == {"static::a.txt": "hello\nworld", "static::sub/b.md": "good bytes", "static::t.csv": "1 x, y 2", "static::u.csv": "z"}
    report = files.corpus_report(files.read_texts(spark, str(tmp_path)).where("text <> ''")).first()
    assert (report["n_files"], report["n_chars"]) == (2, 21)


def test_parts_of_table_files_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n" + "".join(f"row{i}\n" for i in range(2000)))
    seen = []
    for split in ("4096", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            seen.append({r["doc_key"]: r["text"] for r in files.read_tables(spark, str(tmp_path), rows_per_part=700).collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1]
    rows = [f"row{i}" for i in range(2000)]
    assert seen[0] == {"static::t.csv": " ".join(rows[:700]), "static::t.csv#1": " ".join(rows[700:1400]), "static::t.csv#2": " ".join(rows[1400:])}


def test_pages_survive_a_bad_file(spark, tmp_path):
    (tmp_path / "ok.pdf").write_text("one\ftwo")
    (tmp_path / "bad.pdf").write_text("boom")

    def factory():
        def read(path, content):
            if b"boom" in bytes(content):
                raise ValueError
            return bytes(content).decode().split("\f")
        return read

    pages = files.read_pages(spark, str(tmp_path), factory)
    assert {(r["page_no"], r["text"]) for r in pages.collect()} == {(0, "one"), (1, "two"), (-1, None)}
    assert [r["text"] for r in files.pages_to_documents(pages).collect()] == ["one\ntwo"]


XML = """<Legislation xmlns="http://x"><Body>
<P1group><Title>The general <Em>rule</Em></Title><P1 id="section-19"><Pnumber/><P1para><Text>No person may carry on a regulated activity in the kingdom.</Text></P1para></P1></P1group>
<P1 id="section-19"><Pnumber>19</Pnumber><P1para><Text>A second element of the same number that must be ignored entirely.</Text></P1para></P1>
<P1 id="section-20"><Pnumber>20</Pnumber><P1para><Text>. . . . . . . .</Text></P1para></P1>
<P1 id="x"><Pnumber>21A</Pnumber><Title>Own title</Title><P1para><Text>{long}</Text></P1para></P1>
<P1 id="none"><P1para><Text>An element without any number is left out of the result.</Text></P1para></P1>
</Body></Legislation>"""


def test_legislation_xml(spark, tmp_path):
    (tmp_path / "fsma_2000.xml").write_text(XML.replace("{long}", "word " * 400))
    (tmp_path / "mlr_2017.xml").write_text("<broken")
    got = {r["id"]: r for r in legislation.read_legislation(spark, str(tmp_path)).collect()}
    assert set(got) == {"FSMA2000_s19", "FSMA2000_s21A_chunk0", "FSMA2000_s21A_chunk1"}
    first = got["FSMA2000_s19"]
    assert (first["cite"], first["title"], first["module"]) == ("FSMA 2000 s.19", "The general rule", "HMT")
    assert first["text"] == "No person may carry on a regulated activity in the kingdom."
    assert got["FSMA2000_s21A_chunk1"]["hierarchy_path"] == "/FSMA 2000/s.21A/chunk1" and got["FSMA2000_s21A_chunk0"]["title"] == "Own title"


def test_names_and_modules(one):
    assert one(file_slug, "fca/Policy Statement (24-1).pdf") == "Policy_Statement_24_1"
    assert one(lambda x: c.file_module(x, F.lit("fca")), "cobs") == "COBS"
    assert one(lambda x: c.file_module(x, F.lit("fca")), "other") == "FCA"
    assert one(lambda x: c.file_module(x, F.lit("pra_pdfs")), "any") == "PRA"
    assert one(is_allowed_file, "x.tar.PDF") and not one(is_allowed_file, "pdf")
    assert one(html.title_slug, " Crédit & Co – 2024 ") == "cre_dit_co_2024"


def test_page_provisions(spark):
    rows = spark.createDataFrame([("fca", "COBS.pdf", "long text. " * 300), ("eu", "tiny.pdf", "short")], "folder string, name string, text string")
    got = files.page_provisions(rows, max_chunks=2, chunker=chunk_packed).orderBy("id").collect()
    assert [r["id"] for r in got] == ["PDF_COBS_c0", "PDF_COBS_c1"]
    assert got[0]["cite"] == "COBS (COBS p1)" and got[0]["domain"] == "Handbook"
    assert files.page_provisions(rows, chunker=chunk_packed).count() == 3


def test_html(spark):
    page = '<h1>A &amp; B</h1><div class="x date">1 May 2020</div><p>First <b>para</b><p>Second</p><p>Third</p><a href="../">up</a><a href="/cases/one.html">c</a><a class="i" href="doc.pdf">d</a>'
    df = spark.createDataFrame([("https://h.org/dir/page", page), ("https://h.org", "<p>On 12 June 2021 it</p>")], "url string, html string")
    rows = {r["url"]: r for r in html.extract_page(df).collect()}
    first = rows["https://h.org/dir/page"]
    assert (first["title"], first["date"], first["summary"]) == ("A & B", "1 May 2020", "First para Second")
    assert rows["https://h.org"]["date"] == "On 12 June 2021 it"
    links = html.links(df)
    assert {r["link"] for r in links.collect()} == {"https://h.org/cases/one.html", "https://h.org/dir/doc.pdf"}
    assert [r["link"] for r in html.case_links(links).collect()] == ["https://h.org/cases/one.html"]
    web = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "url string, link string")
    start = spark.createDataFrame([("a",)], "url string")
    assert {tuple(r) for r in html.reachable(start, web, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert [r["link"] for r in html.pdf_link(df).collect()] == ["https://h.org/dir/doc.pdf"]


def test_questions(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('Question Text,Legal-Domain,Level,Label\n"What, now?",anti_money,HARD,potential_issue\n')
    row = questions.read_any(spark, str(path)).first()
    assert (row["question"], row["domain"], row["complexity"], row["compliance_class"], row["gold_answer"]) == ("What, now?", "anti money", "advanced", "Potential issue", "")
    plain = tmp_path / "p.csv"
    plain.write_text("a,b\nshort,this is the longest column\n")
    assert questions.read_any(spark, str(plain)).first()["question"] == "this is the longest column"
    short = tmp_path / "c.csv"
    short.write_text("Topic,n\nx_y,1\n")
    row = questions.read_any(spark, str(short)).first()
    assert (row["question"], row["domain"], row["n"], row["source_file"]) == ("x_y | 1", "x y", "1", "c.csv")
    spark.createDataFrame([("which rule?",)], "query string").coalesce(1).write.parquet(str(tmp_path / "parts"))
    for name in ("p.parquet", "r.parquet"):
        (tmp_path / name).write_bytes(next((tmp_path / "parts").glob("part-*.parquet")).read_bytes())
    found = questions.discover_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[-1] for f in found] == ["c.csv", "p.csv", "q.csv", "r.parquet"]
    assert questions.read_any(spark, found[-1]).first()["question"] == "which rule?"
    qs = tmp_path / "s.csv"
    qs.write_text("id,domain,complexity,question,gold_answer,expected_citations,expected_keywords\n" + "".join(f"{i},d,basic,q{i},g,,k\n" for i in range(5)))
    got = questions.load_questions(spark, str(qs), sample=2).collect()
    assert [r["id"] for r in got] == ["0", "1"] and got[0]["expected_citations"] is None


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", ["a", "b"], 0.123456)], "qid string, contexts array<string>, s double")
    flat = sinks.flatten_contexts(rows, ["s"])
    assert flat.first()["contexts"] == "a ||| b" and flat.first()["s"] == 0.1235
    path = str(tmp_path / "runs")
    for run in ("r1", "r2"):
        sinks.append_results(flat, path, run)
    results = spark.read.parquet(path)
    listed = sinks.list_runs(results, spark.createDataFrame([("r1",)], "run_id string")).collect()
    assert [(r["run_id"], r["has_summary"]) for r in listed] == [("r2", False), ("r1", True)]
    assert sinks.latest_run(results).first()["run_id"] == "r2"
    sinks.export(flat, str(tmp_path / "j"), "json")
    lines = [ln for f in (tmp_path / "j").glob("*.json") for ln in f.read_text().splitlines()]
    assert [json.loads(ln)["qid"] for ln in lines] == ["1"]
    with pytest.raises(ValueError):
        sinks.export(flat, str(tmp_path / "x"), "xlsx")


def test_streams_ignore_what_was_delivered_before(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session_id string, filename string, text string"
    spark.createDataFrame([("s", "f", "x" * 1600), ("s", "g", "hello https://u.v [1]")], schema).write.parquet(src)
    run = lambda state: jobs.stream_uploads(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / state))
    run("a")
    first = spark.read.parquet(out).count()
    run("b")
    spark.createDataFrame([("s", "h", "new")], schema).write.mode("append").parquet(src)
    run("a")
    rows = spark.read.parquet(out)
    assert first == 3 and rows.count() == 4
    assert rows.where("filename = 'g'").first()["text"] == "hello"


def test_another_text_under_a_used_name_is_kept(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session_id string, filename string, text string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for text in ("first text", "second text", "first text", "z" * 1600):
        spark.createDataFrame([("s", "f", text), ("t", "f", "own")], schema).coalesce(1).write.mode("append").parquet(src)
    jobs.stream_uploads(stream(), out, str(tmp_path / "a"))
    jobs.stream_uploads(stream(), out, str(tmp_path / "b"))
    rows = spark.read.parquet(out)
    assert sorted(r["chunk_no"] for r in rows.where("session_id = 's'").collect()) == [0, 1, 2, 3]
    assert {r["text"] for r in rows.where("session_id = 's'").collect()} >= {"first text", "second text"}
    assert rows.where("session_id = 't'").count() == 1 and rows.count() == rows.select("session_id", "chunk_key").distinct().count()


def test_an_equal_text_under_another_upload_id_is_stored_again(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session_id string, filename string, text string, upload_id string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for batch in ([("s", "f", "same", "u1"), (None, None, "no name", "u1")], [("s", "f", "same", "u2"), ("s", "f", "same", "u1")], [("s", "f", "same", None), ("s", "f", None, "u4")],
                  [("s", "f", "same", "u2"), ("s", "f", "  ", "u5"), (None, None, "no name", "u2")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    for state in ("a", "a", "b"):
        jobs.stream_uploads(stream(), out, str(tmp_path / state))
    rows = spark.read.parquet(out).select("session_id", "filename", "chunk_no", "text").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == [*(("s", "f", n, "same") for n in range(3)), *((None, None, n, "no name") for n in range(2))]


def test_a_batch_that_runs_again_overwrites_itself_and_reads_no_stored_text(spark, tmp_path):
    out, ledger = str(tmp_path / "out"), str(tmp_path / "out-ledger")
    chunks = lambda rows: jobs.upload_chunks(spark.createDataFrame(rows, "session_id string, filename string, text string"))
    spark.createDataFrame([], jobs._ledger_schema(chunks([]))).write.parquet(jobs._folder(ledger, "s", -1))
    first, second = chunks([("s", "f", "x" * 1600)]), chunks([("s", "f", "more"), ("s", "f", "x" * 1600)])
    for batch, n in ((first, 0), (second, 1), (second, 1)):
        jobs._store_uploads(batch, out, ledger, "s1", n)
    assert sorted(r["chunk_no"] for r in spark.read.parquet(out).collect()) == [0, 1, 2]
    assert "text" not in spark.read.parquet(ledger).columns and spark.read.parquet(ledger).agg({"chunks": "sum"}).first()[0] == 3


def test_audit_stream_over_several_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "answer_id long, answer string, context_cites array<string>, chunk_cites array<string>"
    provisions = spark.createDataFrame([("p1", "COBS 4.2.1R", "t", "a firm must be fair")], "id string, cite string, title string, text string")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    batches = ([(1, "see COBS 4.2.1R", ["COBS 4.2.1R"], []), (2, None, None, None)], [(1, "other", [], []), (3, "PRIN 9.9", [], [])])
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_audits(stream(), provisions, out, str(tmp_path / "a"))
    once = {r["answer_id"]: r for r in jobs.stored_audits(spark, out).collect()}
    assert spark.read.parquet(out).count() == 3 and set(once) == {1, 2, 3}
    jobs.stream_audits(stream(), provisions, out, str(tmp_path / "b"))
    assert jobs.stored_audits(spark, out).count() == 3 and "batch_id" not in jobs.stored_audits(spark, out).columns


def test_first_greeting_over_several_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "session_id long, turn int, text string"
    for batch in ([(1, 5, "hello"), (2, 2, "hello")], [(1, 1, "hello"), (2, 7, "hello")], [(1, 3, "hello")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_first_greetings(spark.readStream.schema(schema).parquet(src), out, state)
    jobs.stream_first_greetings(spark.readStream.schema(schema).parquet(src), out, state + "-again")
    assert {tuple(r) for r in jobs.stored_first_greetings(spark.read.parquet(out)).collect()} == {(1, 1), (2, 2)}


def test_first_greeting_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session_id string, turn int, text string"
    spark.createDataFrame([("s", 3, "hello"), ("s", 1, "what does FSMA section 19 say about banks"), ("t", 2, "thanks!")], schema).write.parquet(src)
    jobs.stream_first_greetings(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "st"))
    assert {tuple(r) for r in spark.read.parquet(out).select("session_id", "turn").collect()} == {("s", 3), ("t", 2)}


def test_tables_are_read_once_with_odd_lines(spark, tmp_path, monkeypatch):
    """Folders are listed once however many files they hold; blank lines, quoted commas and quotes, short rows and bare headers as a CSV reader has them."""
    (tmp_path / "a.csv").write_text('\n  \nx,y,z\n1,"two, or ""2""",\n\n3\n,,""\n', newline="")
    (tmp_path / "b.csv").write_text("x\r\nonly\r\n", newline="")
    (tmp_path / "c.csv").write_text("x,y\n")
    listings, reader = [], files._reader
    monkeypatch.setattr(files, "_reader", lambda *args: listings.append(args) or reader(*args))
    got = {r["doc_key"]: r["text"] for r in files.read_tables(spark, str(tmp_path)).collect()}
    assert got == {"static::a.csv": '1 two, or "2" 3 ', "static::b.csv": "only"}
    assert len(listings) == 1
