"""Size checks in front of every broadcast, and the way around when they fail."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

# a broadcast of this many narrow rows stays well below 200 MB
BROADCAST_ROWS = 2_000_000


class Block(NamedTuple):
    rows: DataFrame
    small: bool

    def hint(self, df: DataFrame) -> DataFrame:
        """df (rows of this block or fewer), broadcast where the block is small."""
        return F.broadcast(df) if self.small else df


def query_blocks(terms: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> list[Block]:
    """The rows of a query-side table in blocks that are small enough to
    broadcast. Usually there is one. With more, every block is one more pass of
    the other side, so nothing grows past the bound and no query is dropped. A
    block that is too large even so (one query with millions of tokens) is left
    to a shuffled join."""
    n = terms.count()
    if n <= max_rows:
        return [Block(terms, True)]
    blocks = -(-n // max_rows) * 2  # twice as many: hashing is uneven
    part = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    sizes = {r["b"]: r["n"] for r in terms.groupBy(part.alias("b")).agg(F.count("*").alias("n")).collect()}
    return [Block(terms.where(part == b), size <= max_rows) for b, size in sorted(sizes.items())]


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out
