"""Shingle sets move by id once and their tokens by token once."""

import random
import re

from pyspark.sql import functions as F

from pactlens.operators import dedup


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"(Reused)?Exchange.*?hashpartitioning\((\w+)#", plan)


def test_sets_and_tokens_are_shuffled_once(spark, monkeypatch):
    rng = random.Random(2)
    passages = [" ".join(f"p{k}w{i}" for i in range(8)) for k in range(12)]
    rows = spark.createDataFrame([(i, " ".join(rng.sample(passages, 9))) for i in range(60)], "id long, text string")
    written, cut = [], dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: written.append(df) or cut(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dedup.near_duplicates(rows, "id").collect()
        held = next(df for df in written if {"prefix", "shingles"} <= set(df.columns))
        held.collect()
        moved = [name for reused, name in exchanges(held) if not reused]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert moved.count("token") == 1
    sets = re.findall(r"(?<!Reused)Exchange hashpartitioning\(id#\d+L, \d+\)[^\n]*\n[^\n]*(?:\n[^\n]*){0,3}?Scan ExistingRDD\[id#\d+L,shingles#\d+\]",
                      held._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
    assert len(sets) == 1


def test_rows_without_shingles_share_nothing(spark):
    sets = spark.createDataFrame([(1, []), (2, []), (3, [5, 6]), (4, [6])], "id long, shingles array<long>").withColumn("n", F.size("shingles"))
    assert sorted(map(tuple, dedup.rare_first(sets).select("id", "shared").collect())) == [(3, [6]), (4, [6])]
