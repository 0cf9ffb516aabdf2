"""Approximate nearest neighbours: a forest of random-projection trees, one queue over all trees, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexspark.session import cut_lineage

# vectors that the trees' splits are fitted on, at most; every vector is indexed whatever their number
FIT_ROWS = 50_000
TREES = 16
# fitted vectors of a leaf, or more where a tree would have over about LEAVES leaves:
# so what a query emits, one short list a visited leaf, does not grow with the table
LEAF = 256
LEAVES = 64
# a query visits leaves of all trees until they hold this share of the fitted vectors, counted with repeats
SEARCH_SHARE = 1.0
# vectors or queries that one block of a leaf holds
BLOCK_ROWS = 4096
# queries of a block compared at once
ASKED_AT_ONCE = 256
# a smaller sum of squares has lost digits to underflow
_LEAST_SQUARES = 1e-280


class Tree(NamedTuple):
    normals: np.ndarray  # of the inner nodes
    cuts: np.ndarray
    children: np.ndarray  # (n, 2); negative: leaf ~child
    sizes: np.ndarray  # fitted vectors of the leaves


def fit_tree(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Splits at the median of the projection on the difference of two random members, until a leaf is small or cannot be split."""
    normals, cuts, children, sizes = [], [], [], []

    def grow(rows: np.ndarray) -> int:
        for _ in range(3 if len(rows) > leaf else 0):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            projected = sample[rows] @ (a - b)
            cut = np.median(projected)
            right = projected > cut
            if 0 < right.sum() < len(rows):
                node = len(cuts)
                normals.append(a - b)
                cuts.append(cut)
                children.append(None)
                children[node] = (grow(rows[~right]), grow(rows[right]))
                return node
        sizes.append(len(rows))
        return ~(len(sizes) - 1)

    grow(np.arange(len(sample)))
    return Tree(np.array(normals).reshape(-1, sample.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), np.array(sizes))


def leaves_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """Leaf of each vector."""
    at = np.zeros(len(vectors), np.int64) if len(tree.cuts) else np.full(len(vectors), -1)
    open_rows = np.flatnonzero(at >= 0)
    while len(open_rows):
        nodes = at[open_rows]
        right = np.einsum("ij,ij->i", vectors[open_rows], tree.normals[nodes]) > tree.cuts[nodes]
        at[open_rows] = tree.children[nodes, right.astype(np.int64)]
        open_rows = open_rows[at[open_rows] >= 0]
    return ~at


def search(forest: list[Tree], query: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """(tree, leaf) pairs to visit, nearest margins first over all trees, until their leaves hold `wanted` fitted vectors."""
    margins = [t.normals @ query - t.cuts for t in forest]
    queue = [(-np.inf, i, 0 if len(t.cuts) else -1) for i, t in enumerate(forest)]
    heapq.heapify(queue)
    out, held = [], 0
    while queue and held < wanted:
        far, tree, node = heapq.heappop(queue)
        while node >= 0:  # down the near side; the other side waits with the largest margin on its way
            margin = margins[tree][node]
            side = int(margin > 0)
            heapq.heappush(queue, (max(far, abs(margin)), tree, int(forest[tree].children[node, 1 - side])))
            node = int(forest[tree].children[node, side])
        out.append((tree, ~node))
        held += forest[tree].sizes[~node]
    return out


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Directions, safe for very large and very small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same for the same two vectors wherever they stand.

    Rows with a vector whose squares leave the range of normal doubles are scaled by both vectors' largest components first.
    """
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        out = (a * b).sum(axis=1) / (np.sqrt(aa) * np.sqrt(bb))
        odd = ~((np.minimum(aa, bb) >= _LEAST_SQUARES) & (np.maximum(aa, bb) < np.inf))
        if odd.any():
            x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (a[odd], b[odd]))
            out[odd] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    return out


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF,
            share: float = SEARCH_SHARE, fit_rows: int = FIT_ROWS, seed: int = 7) -> DataFrame:
    """(query_id, rank, key, score): for every row whose key is divisible by `every`, the k nearest other rows found, by cosine.

    Null, empty, zero and non-finite vectors and rows with a null key take no
    part, nor do vectors of another length than most. Equal vectors are one
    entry of the index, whose k + 1 smallest keys stand for it: no more can
    reach a result, so copies make no large leaf. The trees are fitted on at
    most fit_rows distinct vectors, chosen by hash; all vectors are put into
    their leaves. A leaf is worked on in blocks of BLOCK_ROWS vectors by
    BLOCK_ROWS queries. Ties go to the smaller key; rows that repeat a key count once.
    """
    spark = vectors.sparkSession
    data = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col(vector)))
    ranked = Window.partitionBy("v").orderBy("id")
    ids = data.groupBy("id").agg(F.min("v").alias("v"))
    lengths = ids.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    ids = ids.where(F.size("v") == lengths["n"])
    # the k + 1 smallest keys of a vector are found per salt first, so a vector with a third of all rows is no one task's group
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = ids.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
    entries = cut_lineage(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.xxhash64("v").alias("entry"), "v", "ids"))
    n = entries.count()
    sample = entries.where(F.pmod("entry", F.lit(1 << 20)) < F.lit(int(min(1.0, 1.2 * fit_rows / n) * (1 << 20)) + 1)).orderBy("entry").limit(fit_rows).select("v")
    fitted = _unit(_matrix(sample.toArrow().column(0).combine_chunks()))
    leaf = max(leaf, -(-len(fitted) // LEAVES))
    rng = np.random.default_rng(seed)
    forest = spark.sparkContext.broadcast([fit_tree(fitted, leaf, rng) for _ in range(trees)])
    wanted = max(int(share * len(fitted)), 16 * leaf)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(0)))
                for i, tree in enumerate(forest.value):
                    leaves = leaves_of(tree, unit).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaves), i, np.int32)), pa.array(leaves), *batch.columns], ["tree", "leaf", "v", "least"])

    placed = entries.select("v", F.col("ids")[0].alias("least")).mapInArrow(place, "tree int, leaf int, v array<double>, least long")
    queries = ids.where(F.col("id") % every == 0).groupBy("v").agg(F.min("id").alias("query")).select("query", "v")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1)))
                visits = [(i, t, leaf_no) for i, q in enumerate(unit) for t, leaf_no in search(forest.value, q, wanted)]
                rows, tree, leaf_no = (pa.array(x, pa.int32()) for x in zip(*visits))
                for start in range(0, len(rows), 1 << 14):
                    part = slice(start, start + (1 << 14))
                    at = rows[part]
                    yield pa.RecordBatch.from_arrays([tree[part], leaf_no[part], batch.column(0).take(at), batch.column(1).take(at)], ["tree", "leaf", "query", "q"])

    visits = queries.mapInArrow(visit, "tree int, leaf int, query long, q array<double>")
    placed, visits = cut_lineage(placed), cut_lineage(visits)
    # at most trees * leaves rows, a number that fit_rows bounds
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")).join(
        visits.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("asks")), ["tree", "leaf"])
    own = lambda column, count: F.pmod(F.xxhash64(column), F.col(count)).cast("int")
    every_one = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    blocks = placed.join(F.broadcast(sizes), ["tree", "leaf"]).select("tree", "leaf", own("least", "blocks").alias("block"), every_one("asks").alias("ask"), "v", "least")
    spread = visits.join(F.broadcast(sizes), ["tree", "leaf"]).select("tree", "leaf", every_one("blocks").alias("block"), own("query", "asks").alias("ask"), "query", "q")
    size = k + 1

    def rerank(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = [[], [], []]
        if rows.num_rows and asks.num_rows:
            v, least = _matrix(rows.column("v").combine_chunks()), rows.column("least").to_numpy()
            directions = _unit(v)
            for start in range(0, asks.num_rows, ASKED_AT_ONCE):
                part = asks.slice(start, ASKED_AT_ONCE)
                q, query = _matrix(part.column("q").combine_chunks()), part.column("query").to_numpy()
                near = _unit(q) @ directions.T
                floor = np.partition(near, near.shape[1] - size, axis=1)[:, near.shape[1] - size] if near.shape[1] > size else np.full(len(q), -2.0)
                i, j = np.nonzero(near >= floor[:, None] - 1e-9)  # exact order among these only
                score = cosine(q[i], v[j])
                order = np.lexsort([least[j], -score, i])
                i, j, score = i[order], j[order], score[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < size
                for column, x in zip(out, (query[i[top]], least[j[top]], score[top])):
                    column.append(x)
        return pa.table({name: np.concatenate(c) if c else np.empty(0, kind) for name, c, kind in zip(("query", "least", "score"), out, (np.int64, np.int64, np.float64))})

    on = ["tree", "leaf", "block", "ask"]
    found = blocks.groupBy(*on).cogroup(spread.groupBy(*on)).applyInArrow(rerank, "query long, least long, score double")
    found = found.groupBy("query", "least").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
    members = best.join(entries.select(F.col("ids")[0].alias("least"), "ids"), "least").select("query", "score", F.explode("ids").alias("id"))
    asked = ids.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v").join(queries, "v").select("query_id", "query")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        asked.join(members, "query").where("id <> query_id").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
    )
