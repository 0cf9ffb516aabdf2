"""Per-session upload chunks as one table: numbering, counts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexspark import fixed_values as fv
from lexspark.functions.text import strip
from lexspark.operators.rows import number_in_order


def append_chunks(uploads: DataFrame, existing: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Numbers the non-blank chunks of (session_id, filename, seq, text, ...)
    per session and file, continuing after the chunks already stored: those of
    `existing`, or as many as counts (session_id, filename, offset) says."""
    fresh = uploads.where(strip(F.col("text")) != "")
    numbered = number_in_order(fresh, ["session_id", "filename"], ["seq"], "n")
    if existing is not None:
        counts = existing.groupBy("session_id", "filename").agg(F.count("*").alias("offset"))
    if counts is not None:
        same = F.col("f.session_id").eqNullSafe(F.col("c.session_id")) & F.col("f.filename").eqNullSafe(F.col("c.filename"))
        numbered = numbered.alias("f").join(counts.alias("c"), same, "left").select(
            *[F.col(f"f.{c}") for c in numbered.columns if c != "n"], (F.col("f.n") + F.coalesce("c.offset", F.lit(0))).alias("n"))
    key = F.concat(F.lit("session::"), F.col("filename"), F.lit("::"), F.col("n").cast("string"))
    return numbered.withColumn("chunk_key", key)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per session and file, and per session (filename null)."""
    per_file = chunks.groupBy("session_id", "filename").agg(F.count("*").alias("chunks"))
    per_session = per_file.groupBy("session_id").agg(F.sum("chunks").alias("chunks"))
    return per_file.unionByName(per_session.select("session_id", F.lit(None).cast("string").alias("filename"), "chunks"))


def clear_sessions(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    return chunks.join(sessions.select("session_id"), "session_id", "left_anti")


def existing_sessions(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    return sessions.join(chunks.select("session_id"), "session_id", "left_semi")


def keep_recent_sessions(chunks: DataFrame, cap: int | None = fv.MAX_SESSIONS) -> DataFrame:
    """Chunks of the most recently used sessions (of all with cap=None). The ranking sees one row per
    session and takes an ordered top-cap, which is pruned in every partition."""
    if cap is None:
        return chunks
    recent = (
        chunks.groupBy("session_id").agg(F.max("ts").alias("last_used"))
        .orderBy(F.col("last_used").desc(), F.col("session_id").asc()).limit(cap)
    )
    return chunks.join(recent.select("session_id"), "session_id", "left_semi")
