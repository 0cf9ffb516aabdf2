"""Incremental jobs: uploads, answer audits, first greetings.

Each is a checkpointed stream. What it has to remember lives in the state store
(answers seen, smallest greeting) or in a narrow table of uploads; no batch
reads the rows it stored before. A batch writes the folder of its stream and
number and overwrites it when it runs again after a failure, so a repeated
batch adds nothing. Streams, state and tables live in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspark.functions.chunking import chunk_fixed
from lexspark.functions.messages import intent
from lexspark.functions.text import clean_context, scrub_marks
from lexspark.operators.verify import audit_citations
from lexspark.operators.rows import posexplode_rows
from lexspark.operators.session_chunks import append_chunks

_PLACE = "stream string, batch_id long"


def _folder(path: str, stream: str, batch_id: int) -> str:
    return f"{path}/stream={stream}/batch_id={batch_id}"


def run_batches(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, str, int], None], mode: str = "append", continuous: bool = False):
    """Runs write(batch, stream, batch_id) over a stream, until it is caught up or
    continuously. A stream is known by its checkpoint."""
    stream = "s" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    writer = rows.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(lambda batch, n: write(batch, stream, n))
    query = (writer if continuous else writer.trigger(availableNow=True)).start()
    if not continuous:
        query.awaitTermination()
    return query


def upload_chunks(uploads: DataFrame, chunker=chunk_fixed) -> DataFrame:
    """(session_id, filename, upload, seq, text) of uploaded files (session_id,
    filename, text and, where deliveries are numbered, upload_id): scrubbed,
    cleaned, chunked. upload is the id, if there is one, and a hash of the text."""
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    if "upload_id" in uploads.columns:
        content = F.concat_ws(":", F.col("upload_id").cast("string"), content)
    cleaned = uploads.withColumn("upload", content).withColumn("text", clean_context(scrub_marks(F.col("text"))))
    return posexplode_rows(cleaned, ["session_id", "filename", "upload"], chunker(F.col("text")), "seq", "chunk").withColumnRenamed("chunk", "text").where("text <> ''")


_CHUNK_COLUMNS = ["chunk_key", "session_id", "filename", "upload", "chunk_no", "text"]


def _same(a: str, b: str, names: list[str]):
    """Null-safe equality of columns of two aliased tables."""
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    return same


def _store_uploads(batch: DataFrame, path: str, ledger: str, stream: str, batch_id: int) -> None:
    """Writes the chunks of uploads that the ledger does not hold, then their ledger rows.

    The ledger has a row an upload (session_id, filename, upload, chunks) and no
    text; its sums say where a name's numbers go on. This batch's own rows of an
    earlier attempt are left out.
    """
    spark = batch.sparkSession
    known = spark.read.schema(f"{_ledger_schema(batch)}, {_PLACE}").parquet(ledger)
    known = known.where((F.col("stream") != stream) | (F.col("batch_id") != batch_id))
    fresh = batch.dropDuplicates(["session_id", "filename", "upload", "seq"]).alias("b")
    fresh = fresh.join(known.alias("k"), _same("b", "k", ["session_id", "filename", "upload"]), "left_anti")
    counts = known.groupBy("session_id", "filename").agg(F.sum("chunks").alias("offset"))
    numbered = append_chunks(fresh.withColumn("seq", F.struct("upload", "seq")), counts=counts).withColumnRenamed("n", "chunk_no")
    chunks = numbered.select(*_CHUNK_COLUMNS)
    own = _folder(path, stream, batch_id)
    chunks.write.mode("overwrite").parquet(own)
    stored = spark.read.schema(chunks.schema).parquet(own)
    stored.groupBy("session_id", "filename", "upload").agg(F.count("*").alias("chunks")).write.mode("overwrite").parquet(_folder(ledger, stream, batch_id))


def _ledger_schema(uploads: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in uploads.schema}
    return f"session_id {kinds['session_id']}, filename {kinds['filename']}, upload string, chunks long"


def stream_uploads(uploads: DataFrame, path: str, checkpoint: str, continuous: bool = False, chunker=chunk_fixed):
    """Stores the chunks of uploaded files, numbered on per session and name.

    A delivery is known by session, name, upload id (if uploads have one) and
    text: the same delivery again adds nothing, also under another checkpoint;
    another text, or the same text under another upload id, adds its chunks
    after those stored. One stream at a time writes a table; its ledger of
    uploads lies at path + "-ledger".
    """
    ledger = f"{path}-ledger"
    none = uploads.sparkSession.createDataFrame([], _ledger_schema(uploads))
    none.write.mode("ignore").parquet(_folder(ledger, "s", -1))
    return run_batches(upload_chunks(uploads, chunker), checkpoint, lambda b, stream, n: _store_uploads(b, path, ledger, stream, n), continuous=continuous)


def stream_audits(answers: DataFrame, provisions: DataFrame, path: str, checkpoint: str, continuous: bool = False):
    """Audits each batch of answers against the static provisions. Ids seen are
    kept in the state store, so an answer is audited once a stream."""
    audit = lambda b, stream, n: audit_citations(b, provisions).write.mode("overwrite").parquet(_folder(path, stream, n))
    return run_batches(answers.dropDuplicates(["answer_id"]), checkpoint, audit, continuous=continuous)


def stored_audits(spark: SparkSession, path: str) -> DataFrame:
    """The audits of a table, one row an answer: the first batch's where several streams audited it."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in ("stream", "batch_id")]
    first = rows.groupBy("answer_id").agg(F.min_by(F.struct(*columns), F.struct("batch_id", "stream")).alias("audit"))
    return first.select("audit.*")


def first_greetings(messages: DataFrame) -> DataFrame:
    """(session_id, turn) of the first greeting per session."""
    greetings = messages.where(intent(F.col("text")) == "greeting")
    return greetings.groupBy("session_id").agg(F.min("turn").alias("turn"))


def stream_first_greetings(messages: DataFrame, path: str, checkpoint: str, continuous: bool = False):
    """The state store keeps every session's smallest greeting turn; a batch adds
    a row for each session it greeted in. See stored_first_greetings."""
    write = lambda b, stream, n: b.write.mode("overwrite").parquet(_folder(path, stream, n))
    return run_batches(first_greetings(messages), checkpoint, write, "update", continuous)


def stored_first_greetings(stored: DataFrame) -> DataFrame:
    """(session_id, turn): the smallest turn that any batch found, whatever order the turns came in."""
    return stored.groupBy("session_id").agg(F.min("turn").alias("turn"))
