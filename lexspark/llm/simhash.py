"""SimHash near-duplicates: tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexspark.llm.common import connected_components, map_rows, unused
from lexspark.session import cut_lineage

# fingerprints of a tile; a pair of tiles needs about ROWS_AT_ONCE * TILE * 9 bytes
TILE = 4096
ROWS_AT_ONCE = 256


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles, repeats included; a bit is set if it is in over half the hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(s, seed) for s in joined), np.uint64, len(joined))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = hashes[start : start + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long). Null and empty texts have fingerprint zero."""

    def run(k, t):
        fp = fingerprint(t)
        return k, fp - (1 << 64) if fp >> 63 else fp

    return map_rows(docs.select(key, text), f"{key} long, fp long", run)


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all pairs within the radius do, one fewer than the members of each local component."""
    nodes = np.unique(np.concatenate([left, right]))
    label = np.arange(len(nodes))
    at_left, at_right = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    for start in range(0, len(left), ROWS_AT_ONCE):
        near = np.bitwise_count(left[start : start + ROWS_AT_ONCE, None] ^ right[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            found = np.unique(np.append(label[at_right[near[i]]], label[at_left[start + i]]))
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
    return [(n, r) for n, r in zip(nodes[label != np.arange(len(nodes))].view(np.int64).tolist(), nodes[label[label != np.arange(len(nodes))]].view(np.int64).tolist())]


def near_links(distinct: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) with the same components as all pairs within the radius.

    A fingerprint's cell is the pair of population counts of its two halves;
    fingerprints within the radius lie in cells at most that far apart in the
    sum of both counts, so all other pairs of tiles are skipped unread. A cell
    is cut into tiles of about `tile` fingerprints by hash; the table of cells
    has 33 * 33 rows at most. Every remaining pair of tiles is one row, joined
    by the right tile's number, and is compared exactly.
    """
    high = F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int")
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")
    cells = distinct.select("fp", high.alias("a"), low.alias("b"))
    sizes = cells.groupBy("a", "b").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    tiles = (
        cells.join(F.broadcast(sizes), ["a", "b"]).select("a", "b", F.pmod(F.xxhash64("fp"), "tiles").cast("int").alias("t"), "fp")
        .groupBy("a", "b", "t").agg(F.collect_list("fp").alias("fps"))
    )
    tiles = cut_lineage(tiles)
    steps = [(da, db) for da in range(radius + 1) for db in range(-radius, radius + 1) if da + abs(db) <= radius and (da > 0 or db >= 0)]
    step = F.explode(F.array(*[F.struct(F.lit(da).alias("da"), F.lit(db).alias("db")) for da, db in steps])).alias("s")
    wanted = (
        tiles.select("a", "b", "t", "fps", step)
        .select("a", "b", "t", "fps", (F.col("a") + F.col("s.da")).alias("a2"), (F.col("b") + F.col("s.db")).alias("b2"))
        .join(F.broadcast(sizes.select(F.col("a").alias("a2"), F.col("b").alias("b2"), "tiles")), ["a2", "b2"])
        .withColumn("same", (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")))
        .withColumn("t2", F.explode(F.sequence(F.when(F.col("same"), F.col("t")).otherwise(0), F.col("tiles") - 1)))
        .select("a2", "b2", "t2", "fps")
    )
    right = tiles.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("t").alias("t2"), F.col("fps").alias("others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                a, b = (np.asarray(batch.column(c)[i].values).view(np.uint64) for c in (0, 1))
                links += tile_links(a, b, radius)
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return wanted.join(right, ["a2", "b2", "t2"]).select("fps", "others").mapInArrow(run, "u long, v long")


def class_members(prints: DataFrame, radius: int, key: str) -> DataFrame:
    """(fp, least, root) for every distinct fingerprint of prints (key, fp): its smallest key, and the root of its component."""
    classes = cut_lineage(prints.groupBy("fp").agg(F.min(key).alias("least")))
    roots = connected_components(near_links(classes.select("fp"), radius))
    return cut_lineage(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def one_of_each_group(docs: DataFrame, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs, all columns kept, with the smallest key of every near-duplicate group.

    Of rows that share that key the one with the smallest text hash stays, of
    identical rows one. A group of null keys keeps one row, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], [key, "fp", "_t"])

    prints = cut_lineage(docs.select(F.col(key).cast("long"), text, F.xxhash64(text).alias("_t")).mapInArrow(run, f"{key} long, fp long, _t long"))
    members = class_members(prints, radius, key)
    mark, one = unused(docs, "text_hash"), unused(docs, "chosen")
    first = F.min(F.struct(F.coalesce(F.col(key).isNull(), F.lit(True)).alias("_none"), F.col(key), F.col("_t")))
    by_class = prints.groupBy("fp").agg(first.alias("s"))
    chosen = by_class.join(members, "fp").groupBy("root").agg(F.min("s").alias("s")).select(F.struct(F.col(f"s.{key}").alias("key"), F.col("s._t").alias("text")).alias(one))
    kept = docs.withColumn(mark, F.xxhash64(text)).join(chosen, (F.col(mark) == F.col(one)["text"]) & F.col(key).eqNullSafe(F.col(one)["key"]), "left_semi")
    return kept.dropDuplicates([key, mark]).select(*docs.columns)


def near_duplicates(docs: DataFrame, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id), one row per row of docs.

    Equal fingerprints are one node; component_id is the smallest key that can
    be reached over links of at most `radius` differing bits, itself included.
    Null and empty texts have fingerprint zero, linked like any other. Rows
    with a null key get a fingerprint, but never name a component (a component
    of such rows alone has a null id). Other columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs, key, text))
    members = class_members(prints, radius, key)
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    names = members.join(named, "root").select("fp", "component_id")
    return prints.join(names, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
