import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexspark.llm import merkle, queries


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    values = [row[0], row[1], row[2], row[3], row[4]]
    if lower and values[4] is not None:
        values[4] = values[4].translate({c: c + 32 for c in range(65, 91)})
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes, fanout=16):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def climb(levels, at, node, fanout=16):
    """(siblings, folded node, place after the last level)."""
    near = []
    for level in levels[:-1]:
        start = at // fanout * fanout
        run = level[start : start + fanout]
        own = at - start
        near += run[:own] + run[own + 1 :]
        node = sha(*run[:own], node, *run[own + 1 :])
        at //= fanout
    return near, node


def manifest_of(rows, fanout=16):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(sources[s], key=lambda x: x[:3])], fanout) for s in order}
    top = levels_of([trees[s][-1][0] for s in order], fanout)
    out = []
    for rank, s in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            picked = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            near, node = climb(trees[s], at, leaf_of(r, True) if picked else leaf, fanout)
            above, node = climb(top, rank, node, fanout)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha(*near, *above), node, node == top[-1][0]))
    return sorted(out, key=repr)


def built(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, block int, part string")
    text = F.col("text")
    digest = lambda body: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), body)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, digest(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    tree = merkle.manifest(docs.withColumn("leaf", digest(text)).withColumn("tampered", tampered), carry=["tampered"], **how)
    proof, folded = F.col("proof"), merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    got = tree.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(proof)).alias("p"), folded.alias("f"), (folded == F.col("root")).alias("v"))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def table(sizes, seed=1):
    rng = random.Random(seed)
    rows, key = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            key += rng.randint(1, 3)
            rows.append((key, name, rng.choice(["en", None]), rng.choice([key, None]), rng.choice([None, "", "Text A", "lower", "É\U0001d4d0 Z", "long " * 50])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 16}, {"a": 17}, {"a": 257, "b": 1, None: 3, "": 2, "é": 300, "z": 16},
    {f"s{i}": 1 + i % 5 for i in range(40)}, {"hot": 1500, **{f"s{i:02d}": 1 for i in range(18)}},
])
def test_manifest(spark, sizes):
    rows = table(sizes)
    assert built(spark, rows) == manifest_of(rows)


@pytest.mark.parametrize("depth", [0, 1])
def test_many_rounds(spark, depth):
    """A narrow tree with small blocks: uneven siblings at every level, sources of many and of one block."""
    rows = table({"a": 100, "b": 1, "c": 14, "d": 3, "e": 9, "f": 27, "g": 28, "h": 2}, seed=3)
    assert built(spark, rows, fanout=3, depth=depth) == manifest_of(rows, 3)


def test_repeats_nulls_and_input_order(spark):
    rows = [(None, None, None, None, None)] * 3 + [(7, "a", "en", 1, "Same")] * 40 + [(7, "a", "en", 1, "other"), (None, "a", "en", 0, "")]
    want = manifest_of(rows)
    assert built(spark, rows) == want and built(spark, rows[::-1]) == want


def test_no_rows(spark):
    assert built(spark, []) == []


def test_query_on_the_smallest_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = queries.op13_merkle_manifest(spark, path).collect()
    assert sorted((tuple(r) for r in got), key=repr) == manifest_of(rows)
    assert 0 < sum(not r["verified"] for r in got) < len(got)
