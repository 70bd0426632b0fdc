"""Analysis runs: status, latency, staleness, invariants and tuning history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens import domain as D


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isin(*D.ACTIVE_STATUSES))


def status_counts(runs: DataFrame) -> DataFrame:
    status = F.col("status")
    return runs.agg(
        F.count("*").alias("total"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status.isin(*D.ACTIVE_STATUSES)).alias("active"),
    )


def nearest_rank_percentiles(
    runs: DataFrame, value: str = "processing_time_ms", quantiles=(0.50, 0.95, 0.99)
) -> DataFrame:
    """Values at index ``round_half_even(q * (n - 1))`` of the sorted column.

    Counts per value come first; the values are then located in two steps, by
    their upper and lower 16 bits, so the sorted windows hold at most 65 536
    rows however many runs there are. One row; NULLs when there is no value.
    """
    per_value = runs.filter(F.col(value).isNotNull()).groupBy(value).agg(
        F.count("*").alias("n")).select(
        F.shiftright(value, 16).alias("upper"), F.col(value).alias("value"), "n")
    upper = per_value.groupBy("upper").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("upper")
    everything = Window.partitionBy()
    coarse = upper.select(
        "upper",
        (F.sum("n").over(upto) - F.col("n")).alias("before"),
        F.sum("n").over(upto).alias("upto"),
        F.sum("n").over(everything).alias("total"),
    ).select(
        "*",
        F.explode(F.array(*[
            F.struct(F.lit(f"p{round(q * 100)}").alias("name"), F.lit(q).alias("q"))
            for q in quantiles])).alias("target"),
    ).withColumn(
        "rank", F.rint(F.col("target.q") * (F.col("total") - 1)).cast("long")
    ).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))
    fine = per_value.join(coarse.select("upper", "before", "rank", "target.name"), "upper")
    within = Window.partitionBy("name").orderBy("value")
    hit = fine.withColumn("upto", F.col("before") + F.sum("n").over(within)).filter(
        F.col("upto") > F.col("rank"))
    return hit.agg(*[
        F.min(F.when(F.col("name") == f"p{round(q * 100)}", F.col("value")))
        .alias(f"p{round(q * 100)}_ms") for q in quantiles])


def latest_run(runs: DataFrame, key: str = "contract_id") -> DataFrame:
    """Newest run per contract, by partial aggregation instead of a sort."""
    rest = [c for c in runs.columns if c != key]
    order = F.struct("started_at", "run_id")
    newest = runs.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("run"))
    return newest.select(key, "run.*")


def recover_stale(runs: DataFrame, now, timeout: str) -> DataFrame:
    """Active runs older than ``timeout`` become failed, with the reason recorded; others stay as they are."""
    stale = (
        F.col("status").isin(*D.ACTIVE_STATUSES)
        & (F.col("started_at") < now - F.expr(f"INTERVAL {timeout}"))
    )
    return runs.withColumns({
        "error_message": F.when(stale, F.lit(D.STALE_RUN_MESSAGE)).otherwise(F.col("error_message")),
        "completed_at": F.when(stale, now).otherwise(F.col("completed_at")),
        "status": F.when(stale, F.lit("failed")).otherwise(F.col("status")),
    })


def active_run_conflicts(runs: DataFrame) -> DataFrame:
    """Contracts that break the rule of one active run at a time."""
    return active_runs(runs).groupBy("contract_id").agg(
        F.count("*").alias("active_runs")).filter("active_runs > 1")


def run_outcomes(outcomes: DataFrame) -> DataFrame:
    """Succeeded and failed totals per run, with the failed clauses and reasons.

    A run fails only when nothing succeeded. Failures are listed as rows of
    ``failed_clauses`` so a run with many of them stays distributed.
    """
    ok = F.col("error").isNull()
    return outcomes.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.when(F.count_if(ok) > 0, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
    )


def failed_clauses(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("error").isNotNull()).select("run_id", "clause_id", "error")


def progress_percent(done, total):
    """Rounded percent (half up); five percent while the total is unknown."""
    return F.when(total > 0, F.floor(done / total * 100 + F.lit(0.5)).cast("int")).otherwise(5)


def tuning_history(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Last ``limit`` tuning runs, oldest first, with resolved score and trial count.

    The attached score wins, else the best trial; NaN is no score.
    """
    real = lambda col: F.when(~F.isnan(col), col)
    scores = F.filter(
        F.transform("trials", lambda t: F.when(~F.isnan(t["score"]), t["score"])),
        lambda s: s.isNotNull())
    summary = runs.select(
        "run_id", "started_at",
        F.coalesce(real(F.col("best_score")), F.array_max(scores)).alias("best_score"),
        F.coalesce(
            F.col("trial_count"), F.size(F.coalesce("trials", F.array()))).alias("trial_count"),
    )
    recent = summary.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)
    return recent.orderBy("started_at", "run_id")


def latest_per_user(views: DataFrame, keep: int = 100) -> DataFrame:
    """Audit trail: the newest ``keep`` rows per user (limited before the shuffle)."""
    newest = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return views.withColumn("recency", F.row_number().over(newest)).filter(
        F.col("recency") <= keep)


def latest_tuning_run(runs: DataFrame) -> DataFrame:
    """The newest full record with its trials (an empty list when it has none)."""
    newest = runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1)
    return newest.withColumn("trials", F.coalesce("trials", F.array().cast(runs.schema["trials"].dataType)))
