import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexspark.session import local_session

    session = local_session("tests", 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def one(spark):
    """Evaluates an expression builder on one literal text."""
    from pyspark.sql import functions as F

    def run(build, text, **more):
        row = {"text": text, **more}
        schema = ", ".join(f"{k} string" for k in row)
        return spark.createDataFrame([tuple(row.values())], schema).select(build(F.col("text")).alias("x")).first()["x"]

    return run
