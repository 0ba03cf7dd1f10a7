import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gapwright.session import local_session

    work = tmp_path_factory.mktemp("spark")
    session = local_session(
        cores=4,
        memory="4g",
        settings={
            "spark.sql.warehouse.dir": str(work / "warehouse"),
            "spark.checkpoint.dir": str(work / "checkpoints"),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Values of a column function over a list of inputs, in order."""

    def run(fn, values, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [row["y"] for row in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
