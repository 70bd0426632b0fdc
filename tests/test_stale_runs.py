"""Stale-run alerts keep the runs of a bucket in one state."""

import random

from pyspark.sql import functions as F

from pactlens.streaming import runs as SR

DAY = 86_400_000
SCHEMA = "run_id long, ms long, status string"


def alerts(spark, tmp_path, batches, days, **options):
    """Alerts of a stream whose micro-batches are given, and the most rows that its state held."""
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).select("run_id", F.timestamp_millis("ms").alias("ts"), "status").coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("run_id long, ts timestamp, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (SR.stale_run_alerts(stream, days * 86400, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    return sorted((r["run_id"] is None, r["run_id"] or 0, r["started_ms"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()), held


def test_state_holds_buckets_not_runs(spark, tmp_path):
    draw = random.Random(3)
    runs = [None, 0, (1 << 60) + 1, *range(1, 900)]
    events = sorted(((r, draw.randrange(30 * DAY), draw.choice(["running"] * 6 + ["completed"])) for r in runs for _ in range(draw.randrange(1, 7))),
                    key=lambda e: e[1])
    cuts = [len(events) * i // 4 for i in range(5)]
    got, held = alerts(spark, tmp_path, [events[a:b] for a, b in zip(cuts, cuts[1:])], 6, buckets=16)
    want, end = [], events[-1][1] - 600_000
    for r in runs:
        own = [e for e in events if e[0] == r]
        over = [e[1] for e in own if e[2] == "completed"]
        if (over[0] > own[0][1] + 6 * DAY) if over else own[0][1] + 6 * DAY < end:
            want.append((r is None, r or 0, own[0][1]))
    # a run that had settled in time and came back after a silence longer than the timeout is a new one
    assert held <= 17
    assert set(want) <= set(got) and len(got) == len(set(got))
    known = {(r is None, r or 0): [e for e in events if e[0] == r] for r in runs}
    for null, run, start in set(got) - set(want):
        own = known[null, run]
        at = [e[1] for e in own].index(start)
        assert at > 0 and start - own[at - 1][1] > 6 * DAY


def test_events_without_a_time_are_left_out(spark, tmp_path):
    batches = [[(1, None, "running"), (1, 5 * DAY, "running"), (2, 5 * DAY, "completed"), (3, None, "running")], [(9, 20 * DAY, "running")]]
    assert alerts(spark, tmp_path, batches, 6)[0] == [(False, 1, 5 * DAY)]
