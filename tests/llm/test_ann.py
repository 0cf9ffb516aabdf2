import math

import numpy as np

from lexspark.llm import ann_forest


def brute(rows, k=5, every=50):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float)
    out = {}
    for q in ok:
        if q % every == 0:
            scores = [(-float(ann_forest.cosine(ok[q][None], ok[i][None])[0]), i) for i in ok if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def as_dict(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want, got = brute([(r["vec_id"], list(r["embedding"])) for r in df.collect()]), as_dict(ann_forest.nearest(df))
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9, np.mean(hits)
    for q in got:
        exact = dict(want[q])
        assert all(abs(exact[i] - s) < 1e-12 for i, s in got[q] if i in exact)


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 120)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200, 420)] + [(500, [2.0, 4.0, 6.0, 8.0]), (50, [1e200, 2e200, 3e200, 4e200])]
    rows += [(600, None), (650, [0.0] * 4), (700, [1.0, float("nan"), 0.0, 0.0]), (750, [1.0, None, 0.0, 0.0]), (800, []), (None, [1.0] * 4), (850, [1.0, 2.0]), (900, [float("inf")] * 4)]
    rows = [r for r in rows if r[0] != 50]  # squares of such components leave the double range
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, entry string, leaf int")
    want = brute([r for r in rows if r[0] != 850])
    assert as_dict(ann_forest.nearest(df, share=100.0, leaf=16)) == want
    assert ann_forest.nearest(df.limit(0)).count() == 0
    one = df.where("vec_id = 200")
    assert ann_forest.nearest(one).count() == 0


def test_very_large_and_very_small_vectors(spark):
    """Scores do not depend on the scale of a vector."""
    rng = np.random.default_rng(2)
    plain = [(i, rng.normal(size=4).tolist()) for i in range(1, 120)] + [(150, [1.0, 2.0, 3.0, 4.5])]
    planted = [(50, [1e200, 2e200, 3e200, 4e200]), (100, [1e-170, 2e-170, 3e-170, 4e-170]), (121, [2e-162, 4e-162, 6e-162, 9e-162]), (122, [-1e300, 2e300, 3e300, 4e300]),
               (123, [1e-310, -2e-310, 3e-310, 4e-310])]
    rows = [r for r in plain if r[0] not in (50, 100)] + planted
    got = as_dict(ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), share=100.0, leaf=16))
    units = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    units = {i: v / np.sqrt((v * v).sum()) for i, v in units.items()}
    assert got.keys() == {50, 100, 150}
    for q, found in got.items():
        want = sorted(((-float(units[q] @ units[i]), i) for i in units if i != q))[:5]
        assert np.allclose([s for _, s in found], [-s for s, _ in want], rtol=0, atol=1e-9)
        assert all(abs(s - float(units[q] @ units[i])) < 1e-9 for i, s in found)


def test_more_vectors_than_the_fit_and_full_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = as_dict(ann_forest.nearest(df, fit_rows=100, share=100.0))
    assert got == brute(rows)
