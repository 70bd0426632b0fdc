"""Session and shared-storage helpers."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "pactlens", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC timestamps.

    Row work follows the splits of the scan: lower
    ``spark.sql.files.maxPartitionBytes`` where few large files would leave
    cores idle, raise it where tables have very many small splits.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def built_once(build: Callable):
    """Keep the columns that ``build`` makes for as long as the application runs.

    Long expressions take a second to put together, which a stream would
    otherwise spend on each of its batches. Columns don't belong to a frame.
    """
    made: dict = {}

    @functools.wraps(build)
    def run(*args):
        key = (SparkContext._active_spark_context.applicationId, *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where none is set, a temporary folder serves a session in one process;
    on a cluster the setting is required, as executors don't share local disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or None
    current = spark.sparkContext.getCheckpointDir()
    if configured is None and current:
        return current
    if configured is None and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = configured or tempfile.mkdtemp(prefix="pactlens-")
    if current is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
