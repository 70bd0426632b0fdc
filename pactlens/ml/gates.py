"""Label checks of a trained classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens import domain as D


def label_difference(actual: DataFrame, expected=D.CLAUSE_TYPES) -> DataFrame:
    """Labels that are extra or missing against the expected set: (label, side)."""
    wanted = actual.sparkSession.createDataFrame([(name,) for name in expected], "label string")
    found = actual.select("label").distinct()
    return found.exceptAll(wanted).withColumn("side", F.lit("extra")).unionByName(
        wanted.exceptAll(found).withColumn("side", F.lit("missing")))
