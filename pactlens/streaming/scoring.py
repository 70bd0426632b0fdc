"""Incremental scoring: new documents are segmented, cached clauses skipped, results stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactlens.functions import scoring
from pactlens.plans import analyze
from pactlens.sources.pages import clauses_of
from pactlens.sources.stores import last_write
from pactlens.streaming import commits

KEY = ("doc_id", "clause_index")
STORE_SCHEMA = (
    "doc_id long, clause_index int, content_hash string, clause_type string, conf double, "
    "model_score double, n_factors int, risk_level string, summary string, rewrites int, "
    "error string")
COLUMNS = [part.split()[0] for part in STORE_SCHEMA.split(", ")]


def score_store(spark: SparkSession, folder: str) -> commits.Store:
    return commits.Store(spark, folder, STORE_SCHEMA, "doc_id")


def open_store(spark: SparkSession, folder: str) -> None:
    """Make sure the store exists, so that reading it never depends on the first batch."""
    score_store(spark, folder).create()


def all_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored row with its version."""
    return score_store(spark, folder).read()


def newest_scores(rows: DataFrame) -> DataFrame:
    """Newest good row per clause; the newest failed one only where none is good."""
    return last_write(rows.withColumn("_order", F.struct(F.col("error").isNull().alias("good"), "version")), KEY, "_order").drop("_order")


def stored_scores(spark: SparkSession, folder: str) -> DataFrame:
    return newest_scores(all_scores(spark, folder))


def compact_scores(spark: SparkSession, folder: str) -> None:
    """Keep one row per clause, in one commit; for the time between two runs of a stream."""
    store = score_store(spark, folder)
    store.compact(newest_scores)
    store.drop_old_generations()


def open_clauses(store: commits.Store, batch: DataFrame, fingerprint: str) -> DataFrame:
    """Clauses of ``batch`` whose newest good row has another content hash, or that have none.

    Only the buckets of the batch's documents are read.
    """
    asked = store.asked(batch)
    hashed = clauses_of(batch).withColumn("content_hash", scoring.content_hash(F.col("raw_text"), fingerprint))
    good = store.read(asked).filter(F.col("error").isNull())
    known = good.groupBy(*KEY).agg(F.max_by("content_hash", "version").alias("content_hash"))
    return hashed.join(known, [*KEY, "content_hash"], "left_anti")


def dealt_out(batch: DataFrame) -> DataFrame:
    """The batch in at least as many partitions as there are cores, as its few files are small but long to score."""
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return batch if batch.rdd.getNumPartitions() >= cores else batch.repartition(cores)


def score_batch(
    batch: DataFrame, batch_id: int, folder: str, run: str, fingerprint: str,
    scorer: analyze.Scorer | None = None,
) -> None:
    """Score the clauses of one micro-batch that the store doesn't have; a committed batch is left alone."""
    store = score_store(batch.sparkSession, folder)
    if store.has(run, batch_id):
        return
    fresh = open_clauses(store, dealt_out(batch), fingerprint)
    scored = analyze.finalize(analyze.score_clauses(analyze.classify_clauses(fresh), scorer))
    store.commit(scored.select(*COLUMNS), run, batch_id)


def start_scoring(
    documents: DataFrame, folder: str, checkpoint: str,
    fingerprint: str = "fake/demo|spark|v4|opt:none", scorer: analyze.Scorer | None = None,
) -> StreamingQuery:
    """Score a stream of (doc_id, text) into ``folder`` until it is caught up."""
    run = commits.run_name(checkpoint)
    return (
        documents.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, i: score_batch(df, i, folder, run, fingerprint, scorer))
        .start()
    )
