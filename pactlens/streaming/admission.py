"""Sliding-log admission: at most N admitted calls per client in any window.

A call is admitted when fewer than N *admitted* calls lie at most one window
back (a call exactly one window old still counts); rejected calls leave no
trace. Each decision depends on the ones before it, so calls of one client
are settled in time order; everything else is distributed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pactlens import domain as D

MICROS = 1_000_000


def settle(stamps, log: deque, window: int, limit: int) -> list[bool]:
    """Admission of time-ordered stamps; ``log`` is the admitted history and is updated."""
    verdicts = []
    for stamp in stamps:
        while log and stamp - log[0] > window:
            log.popleft()
        verdicts.append(len(log) < limit)
        if verdicts[-1]:
            log.append(stamp)
    return verdicts


def admit(
    attempts: DataFrame, limit: int, window_seconds: int = D.ADMISSION_WINDOW_SECONDS
) -> DataFrame:
    """Batch form: (bucket, client, event_id, ts_micros) plus ``admitted``.

    A gap of more than a window clears a client's log, so its calls fall into
    independent stretches. Those are found on the first and last call of each
    window-wide cell, then each stretch is read in time order with only the
    admitted log in memory.
    """
    window = window_seconds * MICROS
    key = ["bucket", "client"]
    celled = attempts.withColumn("cell", F.floor(F.col("ts_micros") / window))
    order = Window.partitionBy(*key).orderBy("cell")
    gap = F.col("first") - F.lag("last").over(order) > window
    cells = celled.groupBy(*key, "cell").agg(F.min("ts_micros").alias("first"), F.max("ts_micros").alias("last"))
    stretches = cells.withColumn("opens", F.coalesce(gap, F.lit(True)).cast("int")).withColumn(
        "stretch", F.sum("opens").over(order)).drop("opens", "first", "last")
    placed = celled.join(stretches, [*key, "cell"]).drop("cell")
    group = [*key, "stretch"]
    ready = placed.repartition(*group).sortWithinPartitions(*group, "ts_micros", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for frame in frames:
            verdicts: list[bool] = []
            for name, part in frame.groupby(group, sort=False):
                if name != current:
                    current, log = name, deque()
                verdicts += settle(part["ts_micros"], log, window, limit)
            yield frame.assign(admitted=verdicts).drop(columns="stretch")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in attempts.schema.fields)
    names = [*attempts.columns, "stretch"]
    return ready.select(names).mapInPandas(run, f"{fields}, admitted boolean")


def admit_stream(
    attempts: DataFrame, limit: int, window_seconds: int = D.ADMISSION_WINDOW_SECONDS,
    delay: str = "1 minute",
) -> DataFrame:
    """Streaming form over (bucket, client, event_id, ts); state is the admitted log."""
    window = window_seconds * MICROS

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0]) if state.exists else deque()
        calls = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        stamps = (calls["ts"].astype("datetime64[us]").astype("int64")).tolist()
        verdicts = settle(stamps, log, window, limit)
        state.update((list(log),))
        due = (stamps[-1] + window) // 1000 + 1
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({
            "bucket": key[0], "client": key[1], "event_id": calls["event_id"],
            "ts_micros": stamps, "admitted": verdicts})

    return attempts.withWatermark("ts", delay).groupBy("bucket", "client").applyInPandasWithState(
        run, "bucket string, client long, event_id long, ts_micros long, admitted boolean",
        "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)
