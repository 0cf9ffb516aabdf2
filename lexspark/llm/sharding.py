"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values of the published algorithm: the multiplier of its generator
MULTIPLIER = 2862933555777941757
_LIMBS = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
# a shard's rows are numbered in this many hash ranges, so a number needs no group larger than rows / (shards * ranges)
SLOT_RANGES = 4096


def _next_state(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, in 16-bit limbs, so that no product leaves a long."""
    part = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    carry, limbs = F.lit(1).cast("long"), []
    for i in range(4):
        total = carry
        for j in range(i + 1):
            total = total + part[j] * F.lit(_LIMBS[i - j])
        limbs.append(total.bitwiseAND(F.lit(0xFFFF)))
        carry = F.shiftrightunsigned(total, 16)
    out = limbs[0]
    for i in range(1, 4):
        out = out.bitwiseOR(F.shiftleft(limbs[i], 16 * i))
    return out


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a long key. Every jump goes up by one at least, so `shards` steps always suffice;
    steps past the end leave the state alone."""
    start = F.struct(key.alias("key"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        after = _next_state(s["key"])
        draw = (F.shiftrightunsigned(after, 33) + 1).cast("double")
        jumped = F.struct(after.alias("key"), s["j"].alias("b"),
                          F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw)).alias("j"))
        return F.when(s["j"] < shards, jumped).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda s: s["b"].cast("int"))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard), one row per row of docs.

    Law `key`: the key and the number of shards alone decide, so equal texts
    may part, repeated rows with one key stay together, and a grown table moves rows only
    into its new shard (grown_shard). Sizes are UTF-8 bytes plus `overhead`; a
    null or empty text has no bytes and crc 0. A null key is a key like any
    other (shard of the hash seed). Other columns are ignored. Slots run
    without gaps from 0 in each shard, by hash range, then key.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    hashed = F.xxhash64(F.col(key))
    placed = docs.select(
        F.col(key), (F.octet_length(data) + F.lit(overhead)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        jump_hash(hashed, shards).alias("shard"), jump_hash(hashed, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(SLOT_RANGES)).cast("int").alias("_range"),
    )
    return number_slots(placed, key).select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def number_slots(placed: DataFrame, key: str) -> DataFrame:
    """Adds slot. The table of range sizes has at most shards * SLOT_RANGES rows, whatever the input."""
    from pyspark.sql import Window

    own = placed.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_range").orderBy(key, "text_crc32", "size"))
    numbered = placed.withColumn("_at", inside)
    return numbered.join(F.broadcast(offsets), ["shard", "_range"]).withColumn("slot", (F.col("_before") + F.col("_at") - 1).cast("long"))
