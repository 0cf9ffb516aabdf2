"""Plug-in contracts for models, with deterministic offline defaults.

Embedder     texts -> vectors        (an Arrow-batched column function)
Generator    question + contexts -> answer text
Judge        record -> four nullable scores
Extractor    file bytes -> page texts

Each factory is called once per Python worker, so a model loads once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexspark.functions.text import word_tokens

EMBEDDING_DIM = 384


def hashing_embedder(rows: DataFrame, text: str = "text", out: str = "embedding", dim: int = EMBEDDING_DIM) -> DataFrame:
    """Default embedder: hashed token counts, L2-normalised, float32; JVM only."""
    tokens = rows.withColumn("_toks", word_tokens(F.col(text)))
    hashed = HashingTF(numFeatures=dim, inputCol="_toks", outputCol="_tf").transform(tokens)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(hashed)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_toks", "_tf", "_unit")


def model_embedder(factory: Callable[[], Callable[[Sequence[str]], np.ndarray]]):
    """An embedder from a model factory: unit-length float32 rows per text."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in batches:
            matrix = np.asarray(encode(texts.fillna("").tolist()), dtype="float32")
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield pd.Series(list(matrix / np.where(norms == 0, 1, norms)))

    return embed


def run_judge(records: DataFrame, factory: Callable[[], Callable[[dict], dict]], metrics: Sequence[str]) -> DataFrame:
    """Scores records (qid, question, answer, contexts, ground_truth, error).

    Rows with an error or without an answer are skipped, and a failing row gets
    nulls; neither affects the rest of the batch.
    """

    def finite(v):
        try:
            x = float(v)
        except (TypeError, ValueError):
            return None
        return x if np.isfinite(x) else None

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = factory()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                scores = {}
                if row["answer"] and not row["error"]:
                    try:
                        scores = judge(row)
                    except Exception:
                        scores = {}
                out.append([row["qid"], *(finite(scores.get(m)) for m in metrics)])
            yield pd.DataFrame(out, columns=["qid", *metrics]).astype({m: "float64" for m in metrics})

    schema = ", ".join(["qid string", *(f"{m} double" for m in metrics)])
    cols = ["qid", "question", "answer", "contexts", "ground_truth", F.coalesce("error", F.lit("")).alias("error")]
    scored = records.select(*cols).mapInPandas(score, schema)
    return scored.select("qid", *[F.when(~F.isnan(m), F.col(m)).alias(m) for m in metrics])


def run_generator(rows: DataFrame, factory: Callable[[], Callable[[str, Sequence[str]], str]]) -> DataFrame:
    """(query_id, answer, error) from rows (query_id, question, contexts); an
    exception becomes the row's error text."""

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            out = []
            for qid, question, contexts in zip(batch["query_id"], batch["question"], batch["contexts"]):
                try:
                    out.append((qid, str(model(question, list(contexts))).strip(), ""))
                except Exception as e:
                    out.append((qid, "", str(e)[:500]))
            yield pd.DataFrame(out, columns=["query_id", "answer", "error"])

    return rows.select("query_id", "question", "contexts").mapInPandas(generate, "query_id string, answer string, error string")


def extract_pages(files: DataFrame, factory: Callable[[], Callable[[str, bytes], Sequence[str]]] | None = None) -> DataFrame:
    """(path, page_no, text) from binary files (path, content). The default
    extractor reads UTF-8 text with form feeds between pages. A file that fails
    yields one row with page_no -1 and no text instead of failing the job."""
    schema = "path string, page_no int, text string"

    def plain(path: str, content: bytes) -> list[str]:
        return bytes(content).decode("utf-8", errors="ignore").split("\f")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = factory() if factory else plain
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out.extend((path, i, page) for i, page in enumerate(extractor(path, content)))
                except Exception:
                    out.append((path, -1, None))
            yield pd.DataFrame(out, columns=["path", "page_no", "text"]).astype({"page_no": "int32"})

    return files.select("path", "content").mapInPandas(read, schema)


