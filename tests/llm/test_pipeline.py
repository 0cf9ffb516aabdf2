import shutil

import corpus_pipeline
from lexspark.llm import bpe, queries
from tests.llm import brute


def test_pipeline_against_its_parts(spark, tmp_path):
    """Replays the stages in plain Python, except for the language scores, which the operator's own test covers."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = [(1001, None), (1002, ""), (1003, "12 34"), (None, rows[0][1]), (rows[3][0], rows[3][1]), (1004, "a lone secret=abcdefghijklmnop in the text")]
    everything = rows + extra
    d = tmp_path / "in"
    d.mkdir()
    spark.createDataFrame([(k, t, "en", "s", 1) for k, t in everything], names).write.parquet(str(d / "documents.parquet"))
    shutil.copy("/root/testdata/sf0.001/benchmark.parquet", d / "benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(str(d / "benchmark.parquet")).collect()]

    kept = [(k, t) for k, t in everything if any(c.isalpha() for c in t or "")]
    prints = {t: brute.fingerprint(t) for _, t in kept}
    comp = brute.components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    best = {}
    for k, t in kept:
        group = comp[prints[t]]
        if group not in best or (k is not None and (best[group][0] is None or k < best[group][0])):
            best[group] = (k, t)
    clean = [r for r, c in zip(best.values(), brute.contamination(list(best.values()), items)) if not c[-1]]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(d)).collect()}
    assert set(got) == {k for k, _ in clean}
    codec = bpe.codec(queries.vocabulary_path())
    for k, t in clean:
        text = codec.decode(list(got[k]["ids"]))
        spans = brute.base_spans(t)
        assert not brute.base_spans(text)
        if not spans and "[secret]" not in text:
            assert text == t
    assert "[secret]" in codec.decode(list(got[1004]["ids"]))
    shorter = [f(spark, spark.read.parquet(str(d / "documents.parquet")), str(d)).columns for _, f in corpus_pipeline.STAGES[:-1]]
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for c in shorter)
