"""The store of committed micro-batches: pruning, replays, several streams, compaction."""

import re

import pytest
from pyspark.sql import functions as F

from pactlens.sources.stores import with_cache_flag
from pactlens.streaming import commits
from pactlens.streaming import scoring as SS

FINGERPRINT = "fake/demo|spark|v4|opt:none"


@pytest.fixture()
def store(spark, tmp_path):
    return commits.Store(spark, f"{tmp_path}/store", "id long, value string", "id", buckets=8).create()


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, value string")


def content(store, **kw):
    return sorted((r["id"], r["value"], r["version"]) for r in store.read(**kw).collect())


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_an_empty_store_is_read(store):
    assert content(store) == [] and not store.has("a", 0)
    store.create()
    store.compact()
    assert content(store) == []


def test_versions_come_from_the_manifest(spark, store):
    store.commit(rows(spark, (1, "x"), (2, "y")), "a", 0)
    store.commit(rows(spark), "a", 1)
    store.commit(rows(spark, (1, "z")), "b", 0)
    assert content(store) == [(1, "x", 1), (1, "z", 3), (2, "y", 1)]
    assert store.has("a", 1) and store.has("b", 0) and not store.has("b", 1)


def test_a_reader_lists_only_its_buckets(spark, store):
    store.commit(rows(spark, *[(i, "v") for i in range(100)]), "a", 0)
    asked = store.asked(rows(spark, (7, ""), (7, "")))
    assert len(asked) == 1
    found = store.read(asked)
    assert re.search(rf"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = {asked[0]}\)\]", plan_of(found))
    ids = {r["id"] for r in found.collect()}
    assert 7 in ids and len(ids) < 100
    assert len(found.inputFiles()) == 1  # of eight
    assert {r["id"] for r in store.read(range(8)).collect()} == set(range(100))


def test_rows_without_a_manifest_entry_are_not_seen(spark, store):
    """A batch whose data were written when its writer died is written anew."""
    store.commit(rows(spark, (1, "x")), "a", 0)
    lost = rows(spark, (1, "half"), (2, "half")).withColumn("version", F.lit(2).cast("long")).withColumn("bucket", store.bucket())
    lost.write.partitionBy("bucket").parquet(f"{store.folder}/data/generation=0/run=a/batch=1")
    assert content(store) == [(1, "x", 1)] and not store.has("a", 1)
    store.commit(rows(spark, (3, "whole")), "a", 1)
    assert content(store) == [(1, "x", 1), (3, "whole", 2)]


def test_compaction_keeps_what_replays_need(spark, store):
    for batch in range(4):
        store.commit(rows(spark, (1, f"v{batch}"), (batch + 10, "own")), "a", batch)
    store.commit(rows(spark, (1, "b")), "b", 7)
    newest = lambda df: df.groupBy("id").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))
    before = content(store)
    store.compact(newest)
    assert content(store) == [(1, "b", 5), *[(b + 10, "own", b + 1) for b in range(4)]] and len(before) == 9
    assert len(store.read().inputFiles()) <= 8
    assert store.has("a", 3) and store.has("b", 7) and not store.has("a", 4)
    store.commit(rows(spark, (1, "after")), "a", 4)
    assert (1, "after", 6) in content(store)
    store.compact(newest)
    store.drop_old_generations()
    assert len(content(store)) == 5 and store.has("a", 4) and store.has("b", 7)


def test_a_replayed_batch_scores_nothing_twice(spark, tmp_path):
    folder = f"{tmp_path}/scores"
    SS.open_store(spark, folder)
    batch = spark.createDataFrame([(1, "The Client shall pay.\n\nEither party may terminate."), (2, "One clause")], "doc_id long, text string")
    calls = spark.sparkContext.accumulator(0)

    def scorer(text, kind):
        calls.add(1)
        return text, "None", "0.5"

    for number in (0, 0, 1):
        SS.score_batch(batch, number, folder, "r", FINGERPRINT, scorer)
    assert calls.value == SS.all_scores(spark, folder).count() == 3
    SS.compact_scores(spark, folder)
    SS.score_batch(batch, 1, folder, "r", FINGERPRINT, scorer)
    SS.score_batch(batch, 2, folder, "r", "another program", scorer)
    assert calls.value == 6 and SS.stored_scores(spark, folder).count() == 3


def test_a_batch_reads_only_the_buckets_of_its_documents(spark, tmp_path):
    folder = f"{tmp_path}/scores"
    SS.open_store(spark, folder)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("The Client shall pay "), "id").alias("text"))
    SS.score_batch(docs, 0, folder, "r", FINGERPRINT)
    store = SS.score_store(spark, folder)
    fresh = SS.open_clauses(store, docs.filter("doc_id IN (5, 6)").withColumn("text", F.concat("text", F.when(F.col("doc_id") == 6, "!").otherwise(""))), FINGERPRINT)
    assert [r["doc_id"] for r in fresh.collect()] == [6]
    assert re.search(r"PartitionFilters: \[(isnotnull\()?bucket", plan_of(fresh))
    assert len(store.read(store.asked(docs.filter("doc_id IN (5, 6)"))).inputFiles()) <= 2


def test_a_scored_clause_is_retried_after_a_failure(spark, tmp_path):
    folder = f"{tmp_path}/scores"
    SS.open_store(spark, folder)
    batch = spark.createDataFrame([(1, "The Client shall pay."), (2, "Broken")], "doc_id long, text string")

    def scorer(text, kind):
        if "Broken" in text:
            raise RuntimeError("no answer")
        return text, "None", "0.5"

    SS.score_batch(batch, 0, folder, "r", FINGERPRINT, scorer)
    assert {r["doc_id"]: r["error"] is None for r in SS.stored_scores(spark, folder).collect()} == {1: True, 2: False}
    SS.score_batch(batch, 1, folder, "r", FINGERPRINT)
    assert {r["doc_id"]: r["error"] is None for r in SS.stored_scores(spark, folder).collect()} == {1: True, 2: True}
    assert SS.all_scores(spark, folder).count() == 3


def test_cache_flag_is_an_existence_join(spark):
    clauses = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None), (3, 1, "c"), (None, 1, "d")], "contract_id long, clause_index int, content_hash string")
    stored = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "x"), (2, 1, None), (None, 1, "d")], "contract_id long, clause_index int, content_hash string")
    flagged = with_cache_flag(clauses, stored)
    assert sorted((r["contract_id"] or 0, r["clause_index"], r["is_cached"]) for r in flagged.collect()) == \
        [(0, 1, False), (1, 1, True), (1, 2, False), (2, 1, False), (3, 1, False)]
    assert "ExistenceJoin" in plan_of(flagged)
