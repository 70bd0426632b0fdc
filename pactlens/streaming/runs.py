"""Run progress, disclaimer audit and stale-run timers on event streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pactlens import domain as D
from pactlens.sources.stores import last_write
from pactlens.streaming import commits

PAGE_CHARS = 256
RUN_BUCKETS = 512  # hash buckets whose runs share one state
RUN_STATE = {"run_id": "int64", "started": "int64", "settled": "bool", "due": "int64"}  # of the runs of a bucket
NEVER = 1 << 62  # milliseconds that no event has


PROGRESS_SCHEMA = "run_id long, since timestamp, done long, succeeded long, failed long"


def run_progress(outcomes: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(run_id, ts, error) events -> finished and failed clauses per run and window, in update mode.

    The watermark evicts the counts of past windows, so state holds the runs
    of the last ``width`` and ``delay``; ``total_progress`` adds the windows up.
    """
    return outcomes.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "run_id").agg(
        F.count("*").alias("done"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed")).select(
        "run_id", F.col("w.start").alias("since"), "done", "succeeded", "failed")


def total_progress(stored: DataFrame) -> DataFrame:
    """Newest counts of every window of a run, added up."""
    newest = last_write(stored, ("run_id", "since"), "version")
    return newest.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("done", "succeeded", "failed")])


def with_status(progress: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the status a run has given its number of clauses: (run_id, clause_count)."""
    done = F.col("done") >= F.col("clause_count")
    return progress.join(totals, "run_id").withColumn(
        "status", F.when(~done, "running").when(F.col("succeeded") > 0, "completed")
        .otherwise("failed"))


def progress_store(spark: SparkSession, folder: str) -> commits.Store:
    return commits.Store(spark, folder, PROGRESS_SCHEMA, "run_id")


def stored_progress(spark: SparkSession, folder: str) -> DataFrame:
    """All committed counts of every run and window, for ``total_progress``."""
    return progress_store(spark, folder).read()


def store_updates(updates: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Commit every micro-batch of changed rows (see ``commits``)."""
    run = commits.run_name(checkpoint)
    store = progress_store(updates.sparkSession, folder).create()

    def write(df: DataFrame, batch_id: int) -> None:
        if not store.has(run, batch_id):
            store.commit(df, run, batch_id)

    return (
        updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start())


def audit_views(
    views: DataFrame, contracts: DataFrame, delay: str = "1 hour", width: str = "1 hour"
) -> DataFrame:
    """Hourly views per page: (ts, page, contract_id, owner_id) -> counts.

    A contract id is only believed when the viewer owns the contract. Events
    later than ``delay`` are dropped by the watermark.
    """
    owned = contracts.select(
        "contract_id", "owner_id", F.lit(True).alias("_owned"))
    kept = views.withColumn("page", F.substring("page", 1, PAGE_CHARS)).withWatermark("ts", delay)
    joined = kept.join(owned, ["contract_id", "owner_id"], "left")
    return joined.groupBy(F.window("ts", width), "page").agg(
        F.count("*").alias("views"), F.count("_owned").alias("owned_views")).select(
        F.col("window.start").alias("hour"), "page", "views", "owned_views")


def _seen(frame: pd.DataFrame) -> pd.DataFrame:
    """First, last and first final event of every run in a frame, in milliseconds."""
    ms = frame["ts"].astype("datetime64[us]").astype("int64") // 1000
    ends = ~frame["status"].isin(D.ACTIVE_STATUSES)
    return pd.DataFrame({"run_id": frame["run_id"], "first": ms, "last": ms, "over": ms.where(ends, NEVER)}).groupby("run_id").agg(
        {"first": "min", "last": "max", "over": "min"})


def stale_run_alerts(events: DataFrame, timeout_seconds: int, delay: str = "10 minutes", buckets: int = RUN_BUCKETS) -> DataFrame:
    """(run_id, ts, status) stream -> one failed row for each run that isn't over in time.

    A run is over when an event with a final status lies within the timeout of
    its first event. A settled run stays in state until it has been silent for
    another timeout, so late events neither start it again nor alert twice.
    The runs of a hash bucket share one state and are handled together, as a
    call per run costs far more than its few events; the bucket's timer is its
    next run's. Events without a time are left out; those without a run are one.
    """
    limit = timeout_seconds * 1000

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = pd.DataFrame(dict(zip(RUN_STATE, state.get if state.exists else ([],) * len(RUN_STATE)))).astype(RUN_STATE).set_index("run_id")
        seen = [_seen(frame) for frame in frames if len(frame)]
        new = pd.concat(seen).groupby(level=0).agg({"first": "min", "last": "max", "over": "min"}) if seen else None
        changed, late = held.iloc[:0], held.iloc[:0]
        if new is not None:
            started = np.minimum(new["first"], held["started"].reindex(new.index, fill_value=NEVER))
            settled = held["settled"].reindex(new.index, fill_value=False)
            ended = (new["over"] < NEVER) & ~settled
            due = np.maximum(new["last"].where(settled | ended, started) + limit, now + 1)
            changed = pd.DataFrame({"started": started, "settled": settled | ended, "due": due})
            late = changed[ended & (new["over"] > started + limit)]
        # timers of the runs without an event in this batch
        silent = held[~held.index.isin(changed.index)]
        fired = silent["due"] < now
        stale = silent[fired & ~silent["settled"]]
        kept = pd.concat([changed, silent[~fired], stale.assign(settled=True, due=now + limit)]).reset_index()
        alerts = pd.concat([late, stale]).reset_index()
        if len(alerts):
            named = alerts["run_id"] if key[0] >= 0 else pd.array([None] * len(alerts), dtype="Int64")
            yield pd.DataFrame({"run_id": named, "started_ms": alerts["started"], "status": "failed",
                                "error_message": D.STALE_RUN_MESSAGE})
        if len(kept):
            state.update(tuple(kept[name].tolist() for name in RUN_STATE))
            state.setTimeoutTimestamp(int(kept["due"].min()))
        else:
            state.remove()

    run = F.col("run_id")
    dealt = events.filter(F.col("ts").isNotNull()).select(
        F.when(run.isNull(), -1).otherwise(F.pmod(F.xxhash64(run), F.lit(buckets))).cast("int").alias("bucket"),
        F.coalesce(run, F.lit(0)).cast("long").alias("run_id"), "ts", "status")
    return dealt.withWatermark("ts", delay).groupBy("bucket").applyInPandasWithState(
        watch, "run_id long, started_ms long, status string, error_message string",
        "run_id array<long>, started array<long>, settled array<boolean>, due array<long>", "append", GroupStateTimeout.EventTimeTimeout)
