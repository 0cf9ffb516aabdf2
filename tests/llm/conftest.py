import random

import pytest

from tests.llm import brute  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sample(spark):
    """(doc_id, text) of the smallest documents table, and the table."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], df


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeats."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "Gamma", "d\u00e9lta", "\u0130x", "7"]) for _ in range(30_000))
    shared = " ".join(f"w{i}" for i in range(60))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, long), (5, long), (6, shared), (7, "x " + shared + " y"), (8, shared + " " + shared), (9, "a " * 400),
        (10, "a " * 300), (11, "\u00c9T\u00c9 \U0001d4d0 \x1c\x85\xa0 z"), (12, "a" * 5000), (13, "a" * 6000), (14, "word"), (15, "word"),
    ]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with clashing extra columns."""

    def make(rows):
        names = ["doc_id", "text", "word", "slot", "fp", "n", "root", "host", "text_key", "start", "lang", "size", "ids", "key"]
        return spark.createDataFrame([(k, t, *["x"] * 12) for k, t in rows], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))

    return make
