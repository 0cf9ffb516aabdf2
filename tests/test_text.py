from pyspark.sql import functions as F

from lexspark.functions import chunking, citations as c, markdown, messages, text as t


def test_tokenizers(one):
    assert one(t.word_tokens, "The £85,000 limit: It's") == ["the", "£85", "000", "limit", "it", "s"]
    assert one(t.content_tokens, "The firm must disclose conflicts") == ["firm", "disclose", "conflicts"]
    assert one(t.stem_tokens, "Checks trading listed boxes") == ["check", "trad", "list", "box"]
    assert one(t.lemma_tokens, "The policies of boss classes, trading ended") == ["policy", "boss", "classe", "trad", "end"]


def test_normalisers(one):
    assert one(t.citation_folded, "FSMA  s.19\n_x") == "fsma s19 x"
    assert one(t.plain_words, "Fair, clear—and £5!") == "fair clear and £5"


def test_snippet_cuts_and_marks(one):
    assert one(lambda x: t.snippet(x, None, 5), "ab  cdefgh") == "ab c…"
    long = "x" * 300 + "HIT" + "y" * 300
    got = one(lambda x: t.snippet(x, F.lit(300), 250), long)
    assert got == "x" * 200 + "HIT" + "y" * 47 + "…"


def test_extraction_clauses(one):
    cases = {
        "See FSMA section 19 and FSMA 2000 s.22A.": {"FSMA 2000 s.19", "FSMA 2000 s.22A"},
        "RAO art. 25; rao 2001 article 53": {"RAO 2001 art.25", "RAO 2001 art.53"},
        "MLR 2017 reg.27, MLR regulation 33": {"MLR 2017 reg.27", "MLR 2017 reg.33"},
        "PSR reg 77": {"PSR 2017 reg.77"},
        "UK MAR article 17 and UK_MAR art.18": {"UK MAR art.17", "UK MAR art.18"},
        "cobs 4.2.1r with SYSC 10": {"COBS 4.2.1R", "SYSC 10"},
        "COBS 9A.2": {"COBS 9A"},
        "nothing here": set(),
    }
    for text, want in cases.items():
        assert set(one(c.extract_citations, text)) == want, text


def test_context_aware_references(spark):
    df = spark.createDataFrame([("under section 22 and article 5", "FSMA 2000"), ("under section 22", "Other")], "text string, document string")
    rows = df.select(c.extract_citations(F.col("text"), F.col("document")).alias("x")).collect()
    assert [r["x"] for r in rows] == [["FSMA 2000 s.22"], []]


def test_rewrites_keep_the_double_suffix_unless_asked(one):
    assert one(c.rewrite_citations, "COBS 4.2.1R  rule") == "COBS 4.2.1R.1R rule"
    assert one(lambda x: c.rewrite_citations(x, idempotent=True), "COBS 4.2.1R and COBS 4.2") == "COBS 4.2.1R and COBS 4.2.1R"
    assert one(c.answer_citations, "COBS 4.2.1R") == ["COBS 4.2.1R"]


def test_invalid_citations(one):
    text = "Fine: FSMA 2000 s.19\nBad (COBS four) and MLR 2016"
    assert one(lambda x: c.invalid_citations(x, "strict"), text) == ["COBS four", "Bad (COBS four) and MLR 2016"]
    assert one(lambda x: c.invalid_citations(x, "lenient"), "COBS 4.2 | SYSC") == ["SYSC"]


def test_source_lines(one):
    assert one(c.source_line, "text\n**Source: FSMA 2000 s.19 | COBS 4 ") == "FSMA 2000 s.19 | COBS 4"
    assert one(c.source_line, "see cobs 4.2.1R, COBS 4.2.1r and PRIN 12") == "cobs 4.2.1R | PRIN 12"
    assert one(c.policy_penalty, "https://x.y without line") == 1.0


def test_intents(one):
    want = {"": "empty", " ?!": "empty", "this doesn't work": "frustration", "What can you do?": "meta", "hey there!": "greeting",
            "FCA loan": "legal_query", "blue sky": "greeting", "Hi, what is FSMA s.19 about?": "legal_query"}
    for text, label in want.items():
        assert one(messages.intent, text) == label, text


def test_claims(one):
    answer = "# Title here is long enough to count\n- A firm must keep records for years. Short.\n> quoted line that is long enough\nSource: FSMA 2000 s.19 and more text"
    assert one(markdown.claims, answer) == ["A firm must keep records for years."]
    assert one(markdown.claims, "") == []


def test_risk_sections(one):
    text = "- green one\n- plain\n## 🔴 Red Areas\n- late\n- amber thing"
    got = one(markdown.to_risk_sections, text)
    assert got.split("\n") == [
        "## 🟢 Green Areas", "- green one", "", "## 🟡 Yellow Areas", "- plain", "", "## 🟠 Amber Areas", "- amber thing", "", "## 🔴 Red Areas", "- late", ""]


def _pack(text, size, overlap):
    """Plain statement of greedy packing, for comparison."""
    if len(text) <= size:
        return [text]
    windows = lambda s: [w for w in (s[i:i + size].strip() for i in range(0, len(s), size - overlap)) if w]
    sep = next((s for s in ("\n\n", "\n", ". ", " ") if s in text), None)
    if sep is None:
        return windows(text)
    done, cur = [], ""
    for piece in text.split(sep):
        joined = cur + sep + piece if cur else piece
        if len(joined) <= size:
            cur = joined
            continue
        if cur:
            done.append(cur.strip())
        if len(piece) > size:
            done += windows(piece)
            cur = ""
        else:
            cur = piece
    return [d for d in [*done, cur.strip()] if d]


def test_chunkers(one):
    samples = ["one two. three four. five six seven. eight", "x" * 45, "aaaa\n\n" + "b" * 31 + "\n\ncc", "word " * 30]
    for s in samples:
        packed = one(lambda x: chunking.chunk_packed(x, 12, 3), s)
        assert packed == _pack(s, 12, 3)
        recursive = one(lambda x: chunking.chunk_recursive(x, 12, 3), s)
        assert all(len(p) <= 12 for p in recursive)
        assert set("".join(recursive)) == set(s.replace("\n", "").strip()) - (set() if any(" " in p for p in recursive) else {" "})
    fixed = one(lambda x: chunking.chunk_fixed(x, 10, 2), "0123456789abcdefg")
    assert fixed == ["0123456789", "89abcdefg", "g"]
    assert one(lambda x: chunking.chunk_fixed(x, 10, 2), "short") == ["short"]


def test_cheaper_patterns_find_the_same(one):
    assert one(t.squeeze, " a \t b\nc  d\x0be\u00a0f ") == "a b c d e\u00a0f"
    assert one(lambda x: c.invalid_citations(x, "strict"), "see cobs 4; Uk  Mar 9x; mlr 12; fine") == ["see cobs 4; Uk Mar 9x; mlr 12; fine", "see cobs 4", "Uk Mar 9x", "mlr 12"]
    assert one(lambda x: markdown.claims(x, 1), "- `**One a_b*c two.  Next!**_`\n__x__") == ["One a_b*c two.", "Next!", "x"]
