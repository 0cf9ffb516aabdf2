"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and every row's proof.

Leaves of a source are numbered by key and cut into blocks of fanout ** depth
aligned leaves. A block hashes its own subtree; the levels above come from a
butterfly exchange. In a round, the blocks below one parent swap the nodes they
hold: each block of a child sends its node to as many blocks of every sibling as
keeps each receiver at exactly one node a child. All then hash the same parent,
and each has the run of siblings for its proofs. Rounds go on through the
sources' tree until every block holds the root, so no proof ever travels down. A
round moves at most `fanout` small rows a block, whatever the sizes of the
sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexspark.session import cut_lineage

FANOUT, DEPTH = 16, 2


def digest(parts: Column) -> Column:
    """Lower-case hex SHA-256 of strings put together."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row: every value as UTF-8 byte count, colon and value, null as a dash."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _numbered(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows in range partitions (written once, `part` is the partition) and, per group and partition, rows before it and in the whole group.

    Partitions are cut by group and order together, so a group of any size is spread over many of them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(rows.repartitionByRange(parts, *group, *order).withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy(*group, "part").agg(F.count("*").alias("size"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, sizes.select(*group, "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("size").over(whole).alias("total"))


def _sources(offsets: DataFrame, block: int, fanout: int) -> DataFrame:
    """(source, rank, n, first, sources, spans): sources in order, their leaves, their first block's number among all blocks, and
    for every level of the sources' tree the (first block, blocks) of the node above the source."""
    sizes = offsets.groupBy("source").agg(F.max("total").alias("n"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(sizes.repartitionByRange(parts, "source").withColumn("part", F.spark_partition_id()))
    by_part = placed.groupBy("part").agg(F.count("*").alias("rows"), F.sum("blocks").alias("blocks"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = by_part.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("blocks_before"),
                            F.sum("rows").over(Window.partitionBy(F.lit(0))).alias("sources"))
    inside = Window.partitionBy("part").orderBy("source")
    ranked = placed.join(starts, "part").select(
        "source", "n", "blocks", "sources", (F.col("rows_before") + F.row_number().over(inside) - 1).alias("rank"),
        (F.col("blocks_before") + F.sum("blocks").over(inside) - F.col("blocks")).alias("first"))
    out = cut_lineage(ranked.withColumn("spans", F.array(F.struct("first", F.col("blocks").alias("size")))))
    sources = (out.agg(F.max("sources")).first()[0] or 1)
    width = fanout
    while width < sources * fanout:
        node = F.floor(F.col("rank") / width)
        level = out.groupBy(node.alias("node")).agg(F.min("first").alias("at"), F.sum("blocks").alias("size"))
        span = F.struct(F.col("at").alias("first"), F.col("size"))
        out = out.withColumn("node", node).join(level, "node").withColumn("spans", F.array_append("spans", span)).drop("node", "at", "size")
        width *= fanout
    return cut_lineage(out)


def _runs(nodes: Column, fanout: int) -> Column:
    """Consecutive runs of nodes; the last may be shorter."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(starts, lambda i: F.slice(nodes, i * fanout + 1, fanout))


def _hash_blocks(blocks: DataFrame, depth: int, fanout: int) -> DataFrame:
    """Adds level0 to level<depth>, the nodes of each block's own subtree, and node, its top.

    A block that is its source's only one stops as soon as one node is left.
    """
    blocks = blocks.withColumn("level0", F.transform("members", lambda m: m["leaf"]))
    for d in range(depth):
        below = F.col(f"level{d}")
        up = F.transform(_runs(below, fanout), digest)
        done = (F.col("total_blocks") == 1) & (F.size(below) == 1)
        blocks = blocks.withColumn(f"level{d + 1}", F.when(done, below).otherwise(up))
    return blocks.withColumn("node", F.element_at(f"level{depth}", 1))


def _exchange(state: DataFrame, run: tuple[Column, Column], child: tuple[Column, Column], place: Column, takes_part: Column, fanout: int) -> DataFrame:
    """One round: (first, size) of the run and of the block's own child in block numbers, and the child's place in the run.

    Block j of a child with m blocks sends to blocks j, j + m, ... of the whole
    run, so every block of the run gets one node from each child.
    """
    offset = state["block"] - child[0]
    targets = F.sequence(run[0] + offset, run[0] + run[1] - 1, child[1])
    sent = state.where(takes_part).select(F.explode(targets).alias("block"), F.struct(place.cast("int").alias("place"), "node").alias("message"))
    got = sent.groupBy("block").agg(F.sort_array(F.collect_list("message")).alias("got"))  # at most `fanout` of them
    joined = state.join(got, "block", "left")
    nodes = F.transform("got", lambda m: m["node"])
    step = F.struct(place.cast("int").alias("place"), nodes.alias("run"))
    return cut_lineage(joined.select(
        *[c for c in state.columns if c not in ("node", "proof")], F.when(F.col("got").isNull(), F.col("node")).otherwise(digest(nodes)).alias("node"),
        F.when(F.col("got").isNull(), F.col("proof")).otherwise(F.array_append("proof", step)).alias("proof")))


def manifest(leaves: DataFrame, carry: list[str] | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(doc_id, source, leaf, *carry, subroot, root, proof), one row per row of leaves (doc_id, source, leaf, *carry).

    proof is an array from the leaf up of (place, run): the nodes that share a
    parent and the place of the own node among them, from 0. Sources ascend by
    UTF-8 bytes, null first, as a source of its own; leaves ascend by doc_id,
    null first, and equal doc_ids by leaf, so repeated rows are leaves of their
    own and every order of input gives the same root. A source with one leaf has
    it as subroot. Other columns are ignored. No rows give no rows.
    """
    carry = carry or []
    block = fanout**depth
    # equal leaves are told apart by their place in the input, so that even many repeats of one row are spread
    rows = leaves.select("source", "doc_id", "leaf", *carry).withColumn("tie", F.monotonically_increasing_id())
    placed, offsets = _numbered(rows, ["source"], ["doc_id", "leaf", "tie"])
    offsets = cut_lineage(offsets)
    sources = _sources(offsets, block, fanout)
    # a row per source and partition that holds it: no row here stands for many leaves, so the joins are even
    dims = sources.select(F.col("source").alias("of"), "rank", "first", "spans", F.col("blocks").alias("total_blocks"))
    addressed = offsets.join(dims, F.col("source").eqNullSafe(F.col("of"))).select("of", F.col("part").alias("of_part"), "before", "first")
    inside = Window.partitionBy("part", "source").orderBy("doc_id", "leaf", "tie")
    local = placed.withColumn("at", F.row_number().over(inside) - 1)
    leaf_rows = local.join(addressed, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    at = F.col("before") + F.col("at")
    member = F.struct(at.alias("at"), "doc_id", "leaf", *carry)
    grouped = (leaf_rows.select((F.col("first") + F.floor(at / block)).alias("block"), "source", member.alias("member"))
               .groupBy("block").agg(F.sort_array(F.collect_list("member")).alias("members"), F.first("source").alias("source")))
    spans = dims.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("total_blocks") - 1)).alias("block"), "rank", "first", "spans", "total_blocks")
    blocks = cut_lineage(_hash_blocks(grouped.join(spans, "block"), depth, fanout))
    state = blocks.select("block", "rank", "first", "spans", "total_blocks", "node", F.expr("array()").cast("array<struct<place:int,run:array<string>>>").alias("proof"))
    widest = sources.agg(F.max("blocks"), F.max("sources")).first()
    own = F.col("block") - F.col("first")
    width = 1
    while width < (widest[0] or 1):
        child = F.floor(own / width)
        parent = F.floor(own / (width * fanout))
        extent = lambda node, size: (F.col("first") + node * size, F.least(F.lit(size), F.col("total_blocks") - node * size))
        state = _exchange(state, extent(parent, width * fanout), extent(child, width), child % fanout, F.col("total_blocks") > width, fanout)
        width *= fanout
    state = state.withColumn("subroot", F.col("node"))
    width, level = 1, 0
    while width < (widest[1] or 1):
        span = lambda i: (F.col("spans")[i]["first"], F.col("spans")[i]["size"])
        state = _exchange(state, span(level + 1), span(level), F.floor(F.col("rank") / width) % fanout, F.lit(True), fanout)
        width, level = width * fanout, level + 1
    done = blocks.select("block", "source", "members", "total_blocks", *[f"level{d}" for d in range(depth + 1)]).join(
        state.select("block", "subroot", F.col("node").alias("root"), "proof"), "block")
    each = done.select("source", "subroot", "root", "proof", "total_blocks", *[f"level{d}" for d in range(depth + 1)], F.posexplode("members").alias("at_in_block", "member"))
    steps = []
    for d in range(depth):
        place = F.floor(F.col("at_in_block") / fanout**d).cast("int")
        run = F.slice(f"level{d}", F.floor(place / fanout).cast("int") * fanout + 1, fanout)
        none = (F.col("total_blocks") == 1) & (F.size(f"level{d}") == 1)
        steps.append(F.when(~none, F.struct((place % fanout).alias("place"), run.alias("run"))))
    proof = F.concat(F.array_compact(F.array(*steps)), F.col("proof"))
    return each.select(F.col("member.doc_id").alias("doc_id"), "source", F.col("member.leaf").alias("leaf"), *[F.col("member")[c].alias(c) for c in carry],
                       "subroot", "root", proof.alias("proof"))


def siblings(proof: Column) -> Column:
    """The proof's nodes without the own ones, left to right, from the leaf up."""
    return F.flatten(F.transform(proof, lambda s: F.filter(s["run"], lambda _, i: i != s["place"])))


def fold(leaf: Column, proof: Column) -> Column:
    """Root that a leaf leads to: its own digest takes its place in every run."""
    def up(node: Column, s: Column) -> Column:
        return digest(F.transform(s["run"], lambda x, i: F.when(i == s["place"], node).otherwise(x)))

    return F.aggregate(proof, leaf, up)
