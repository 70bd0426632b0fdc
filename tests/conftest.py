import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pactlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[8]", app_name="tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture()
def evaluate(spark):
    """Values of an expression over a list of inputs in column ``x``."""
    def run(values, build, kind="string"):
        from pyspark.sql import functions as F
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r["y"] for r in rows.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
