"""T rows: streams over the given tables and their batch twins."""

from __future__ import annotations

from pactlens.functions import scoring as S
from pactlens.operators import runs as R
from pactlens.plans import analyze as A
from pactlens.session import fresh_path
from pactlens.streaming import admission, runs as SR, scoring as SS
from registry.base import D, F, HYBRID_SQL, LEVEL_SQL, Tables, query, quoted, with_ctes
from registry.documents import _DOC_CTES
from registry.relations import _OUTCOME_SQL
from registry.texts import CTE_TYPED


BATCHES = 6


def stream_of(t: Tables, name: str, order: str = "ts", batches: int = BATCHES):
    """The whole table as a stream of several micro-batches in the order of a column.

    The table is written in ``batches`` parts, one after the other, as the
    source takes files by the time they were written. Every part has the same
    number of files, which grows with the table and of which none is empty.
    """
    static = getattr(t, name)
    if order == "ts":
        static = static.withColumn("ts", F.col("ts").cast("timestamp"))
    place = F.col(order).cast("double")
    cuts = static.select(F.percentile_approx(place, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True)
        if low is not None:
            inside = place > low
        if high is not None:
            inside = inside & (place <= high) if low is not None else (place <= high) | place.isNull()
        parts.append(inside)
    folder = fresh_path(t.spark, f"stream-{name}")
    files = files_of(static, parts)
    for inside in parts:
        static.filter(inside).repartition(files).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files).parquet(folder)


def files_of(static, parts) -> int:
    """Files of each part: as many as the table's splits make of it, but so few that none stays empty.

    Rows are dealt out in turn, so a split with as many rows as there are
    files fills all of them, and a part of ``files * splits`` rows has such a split.
    """
    splits = max(1, static.rdd.getNumPartitions())
    rows = static.agg(*[F.count_if(inside).alias(f"p{i}") for i, inside in enumerate(parts)]).first()
    return max(1, min(-(-splits // len(parts)), min(rows) // splits))


@query("t1_incremental_scoring", with_ctes(
    f"SELECT doc_id, clause_index, clause_type, {LEVEL_SQL} AS risk_level, 1::BIGINT AS times_scored FROM h", "doc_clauses", **_DOC_CTES))
def t1(t: Tables):
    """Even documents, odd documents, then all of them again, which finds every clause cached.

    Each pass is a stream with a checkpoint of its own over one store;
    ``times_scored`` counts the rows that all passes stored for a clause.
    """
    folder = fresh_path(t.spark, "scores")
    SS.open_store(t.spark, folder)
    texts = _contract_stream(t)
    for name, rows in (("even", texts.filter("doc_id % 2 = 0")), ("odd", texts.filter("doc_id % 2 = 1")), ("again", texts)):
        SS.start_scoring(rows, folder, fresh_path(t.spark, f"scores-{name}")).awaitTermination()
    times = SS.all_scores(t.spark, folder).groupBy(*SS.KEY).agg(F.count("*").alias("times_scored"))
    stored = SS.stored_scores(t.spark, folder).join(times, list(SS.KEY))
    return stored.select("doc_id", "clause_index", "clause_type", "risk_level", "times_scored")


def _contract_stream(t: Tables):
    from registry.base import phrase
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        line, F.lit(" "), phrase(F.col("doc_id"), i)))
    return stream_of(t, "documents", "doc_id", batches=2).select("doc_id", F.array_join(lines, "\n\n").alias("text"))


@query("t2_run_progress", with_ctes(
    "SELECT run_id, count(*) AS done, count(*) FILTER (error IS NULL) AS succeeded, count(error) AS failed, CASE WHEN count(*) < "
    "count(*) + run_id % 2 THEN 'running' WHEN count(*) FILTER (error IS NULL) > 0 THEN 'completed' ELSE 'failed' END AS status "
    "FROM o GROUP BY 1", o=_OUTCOME_SQL))
def t2(t: Tables):
    events = stream_of(t, "events").select(
        F.col("user_id").alias("run_id"), "ts",
        F.when(F.col("event_type") == "error", "Timeout").when(F.col("user_id") % 9 == 0, "No result").alias("error"))
    folder = fresh_path(t.spark, "progress")
    SR.store_updates(SR.run_progress(events), folder, fresh_path(t.spark, "progress-cp")).awaitTermination()
    progress = SR.total_progress(SR.stored_progress(t.spark, folder))
    totals = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("n")).select(
        "run_id", (F.col("n") + F.col("run_id") % 2).alias("clause_count"))
    return SR.with_status(progress, totals).select("run_id", "done", "succeeded", "failed", "status")


_LIMIT, _SECONDS = 2, 7200
_ATTEMPT_SQL = (
    "SELECT CASE WHEN event_type = 'error' THEN 'auth' ELSE 'disclaimer' END AS bucket, user_id % 20 AS client, event_id, epoch_us(ts) AS us "
    "FROM events")
_ADMIT_SQL = with_ctes(
    "SELECT bucket, client, unnest(a) AS ts_micros FROM (SELECT bucket, client, list_reduce(list([us] ORDER BY us, event_id), lambda a, x: "
    f"CASE WHEN len(list_filter(a, lambda s: x[1] - s <= {_SECONDS}000000)) < {_LIMIT} THEN list_append(a, x[1]) ELSE a END) AS a FROM t "
    "GROUP BY 1, 2)", t=_ATTEMPT_SQL)


def _attempts(rows):
    bucket = F.when(F.col("event_type") == "error", "auth").otherwise("disclaimer")
    return rows.select(bucket.alias("bucket"), (F.col("user_id") % 20).alias("client"), "event_id", "ts")


@query("t3_admission_batch", _ADMIT_SQL)
def t3(t: Tables):
    rows = _attempts(t.events.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn(
        "ts_micros", F.unix_micros("ts")).drop("ts")
    return admission.admit(rows, _LIMIT, _SECONDS).filter("admitted").select("bucket", "client", "ts_micros")


@query("t3_admission_stream", _ADMIT_SQL)
def t3_stream(t: Tables):
    folder = fresh_path(t.spark, "admitted")
    decided = admission.admit_stream(_attempts(stream_of(t, "events")), _LIMIT, _SECONDS)
    (decided.writeStream.format("parquet").option("path", folder)
     .option("checkpointLocation", fresh_path(t.spark, "admitted-cp"))
     .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.parquet(folder).filter("admitted").select("bucket", "client", "ts_micros")


@query("t4_disclaimer_audit", """SELECT date_trunc('hour', ts) AS hour, event_type AS page, count(*) AS views,
    count(o.o_orderkey) AS owned_views FROM events LEFT JOIN orders o ON o.o_orderkey = event_id AND o.o_custkey % 100 = user_id % 100
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def t4(t: Tables):
    views = stream_of(t, "events").select(
        "ts", F.col("event_type").alias("page"), F.col("event_id").alias("contract_id"),
        (F.col("user_id") % 100).alias("owner_id"))
    contracts = t.contracts().select("contract_id", (F.col("owner_id") % 100).alias("owner_id"))
    folder = fresh_path(t.spark, "views")
    (SR.audit_views(views, contracts).writeStream.format("parquet").option("path", folder)
     .option("checkpointLocation", fresh_path(t.spark, "views-cp"))
     .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.parquet(folder).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("t5_stale_runs", with_ctes(
    f"SELECT run_id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN {quoted(D.STALE_RUN_MESSAGE)} "
    f"WHEN status = 'failed' THEN 'cause ' || run_id END AS error_message FROM (SELECT *, status IN ('pending','running') AND started_at < {_NOW} - INTERVAL 10 DAY AS stale FROM runs)", "runs"))
def t5(t: Tables):
    cause = F.when(F.col("status") == "failed", F.concat(F.lit("cause "), F.col("run_id").cast("string")))
    runs = t.runs().withColumns({"completed_at": F.lit(None).cast("timestamp_ntz"), "error_message": cause})
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return R.recover_stale(runs, now, "10 DAYS").select("run_id", "status", "error_message")


@query("t5_stale_run_alerts", """SELECT run_id, started_ms FROM (SELECT user_id AS run_id, min(epoch_us(ts)) // 1000 AS started_ms,
    min(epoch_us(ts)) FILTER (event_type IN ('purchase', 'view') AND event_id % 40 = 0) // 1000 AS over_ms FROM events GROUP BY 1)
    WHERE CASE WHEN over_ms IS NULL THEN started_ms + 864000000 < (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)
    ELSE over_ms > started_ms + 864000000 END""")
def t5_stream(t: Tables):
    """Runs that never report completion within ten days of their first event."""
    done = F.col("event_type").isin("purchase", "view") & (F.col("event_id") % 40 == 0)
    events = stream_of(t, "events").select(
        F.col("user_id").alias("run_id"), "ts", F.when(done, "completed").otherwise("running").alias("status"))
    folder = fresh_path(t.spark, "stale")
    (SR.stale_run_alerts(events, 10 * 86400).writeStream.format("parquet").option("path", folder)
     .option("checkpointLocation", fresh_path(t.spark, "stale-cp"))
     .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.schema("run_id long, started_ms long, status string, error_message string").parquet(
        folder).select("run_id", "started_ms")


@query("t6_failure_isolation", with_ctes(
    "SELECT doc_id, clause_index, CASE WHEN length(raw_text) % 13 = 0 THEN 2 ELSE 1 END::INTEGER AS attempts, CASE WHEN length(raw_text) % 13 = 0 "
    "THEN 'RuntimeError: provider unavailable' END AS error FROM typed", "doc_clauses", typed=CTE_TYPED))
def t6(t: Tables):
    def scorer(text: str, kind: str) -> tuple[str, str, str]:
        if len(text) % 13 == 0:
            raise RuntimeError("provider unavailable")
        return text, "None", "0.5"

    typed = A.classify_clauses(t.doc_clauses())
    return A.score_clauses(typed, scorer, retries=2, pause=0.0).select(
        "doc_id", "clause_index", "attempts", "error")


@query("t7_active_run_conflicts", with_ctes(
    "SELECT contract_id, count(*) AS active_runs FROM runs WHERE status IN ('pending','running') GROUP BY 1 HAVING count(*) > 1", "runs"))
def t7(t: Tables):
    return R.active_run_conflicts(t.runs())
