"""Stored results: keyed upserts, cascades, answer cache and gated reports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens import domain as D
from pactlens.functions.text import strip

TABLE_KEYS = ("contract_id", "clause_index")


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def last_write(updates: DataFrame, keys, order: str) -> DataFrame:
    """Newest row per key, by partial aggregation."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def upsert(target: DataFrame, updates: DataFrame, keys=TABLE_KEYS, order: str | None = None) -> DataFrame:
    """Insert or replace rows by key; the last write per key by ``order`` wins.

    Without ``order`` no write is the last one, so repeated keys fail the job.
    """
    if order:
        fresh = last_write(updates, keys, order).select(target.columns)
    else:
        rest = [c for c in updates.columns if c not in keys]
        single = F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.lit("repeated keys need an order")))
        fresh = updates.groupBy(*keys).agg(F.count("*").alias("n"), F.first(F.struct(*rest)).alias("row")).withColumn(
            "row", single).select(*keys, "row.*").select(target.columns)
    kept = target.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh)


def replace_by_contract(target: DataFrame, fresh: DataFrame, contracts: DataFrame) -> DataFrame:
    """Delete the rows of every re-run contract and insert its new rows."""
    return target.join(contracts.select("contract_id"), "contract_id", "left_anti").unionByName(fresh)


def cascade_delete(
    contracts: DataFrame, children: dict[str, DataFrame], doomed: DataFrame
) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Delete contracts that both match (contract_id, owner_id) and their child rows.

    Returns the remaining contracts, remaining children, and affected rows
    per table. Tables not passed as children (audit logs) are not touched.
    """
    targets = contracts.join(doomed, ["contract_id", "owner_id"], "left_semi").select("contract_id")
    left = contracts.join(targets, "contract_id", "left_anti")
    left_children = {
        name: df.join(targets, "contract_id", "left_anti") for name, df in children.items()}
    tagged = [targets.select(F.lit("contracts").alias("table_name"))] + [
        df.join(targets, "contract_id", "left_semi").select(F.lit(name).alias("table_name"))
        for name, df in children.items()]
    affected = tagged[0]
    for part in tagged[1:]:
        affected = affected.unionByName(part)
    return left, left_children, affected.groupBy("table_name").agg(
        F.count("*").alias("deleted_rows"))


def split_cached(
    clauses: DataFrame, stored: DataFrame, keys=TABLE_KEYS, force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(cached, to_run): a hit needs the same hash stored for the same clause."""
    if force:
        return clauses.limit(0), clauses
    on = [*keys, "content_hash"]
    known = stored.filter(F.col("content_hash").isNotNull()).select(*on)
    return clauses.join(known, on, "left_semi"), clauses.join(known, on, "left_anti")


def with_cache_flag(clauses: DataFrame, stored: DataFrame, keys=TABLE_KEYS) -> DataFrame:
    """Both sides of :func:`split_cached` from one existence join, as a boolean column.

    Repeated rows of the store neither multiply clauses nor need a pass of their own.
    """
    on = [*keys, "content_hash"]
    known = stored.select(*on).alias("stored")
    same = [F.col(f"stored.{c}") == F.col(f"clauses.{c}").outer() for c in on]
    return clauses.alias("clauses").select("*", known.where(reduce(and_, same)).exists().alias("is_cached"))


ANSWER_SCHEMA = (
    "key string, plain_language_summary string, risk_factors array<string>, dspy_risk_score double")


def read_answer_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw cache lines with an order that follows append time, file and position."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_modification_time").alias("written"),
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line")).alias("line_no"))


def latest_answers(lines: DataFrame) -> DataFrame:
    """(value, line_no) -> newest answer per key; blank and damaged lines are skipped."""
    parsed = lines.filter(strip(F.col("value")) != "").select(
        "line_no", F.try_parse_json("value").alias("doc"), "value").filter(
        F.schema_of_variant(F.try_variant_get("doc", "$.key", "variant")) == "STRING")
    rows = parsed.select("line_no", F.from_json("value", ANSWER_SCHEMA).alias("a")).select(
        "line_no", "a.*")
    return last_write(rows, ["key"], "line_no").drop("line_no")


def append_answers(answers: DataFrame, path: str) -> None:
    answers.select(F.to_json(F.struct(*answers.columns)).alias("value")).write.mode(
        "append").text(path)


def write_training_set(rows: DataFrame, path: str) -> None:
    """Training rows (text, source_label, mapped_label) as Parquet."""
    rows.select("text", "source_label", "mapped_label").write.mode("overwrite").parquet(path)


REPORT_SCHEMA = (
    "measured boolean, provider string, n bigint, precision_high double, recall_high double, "
    "f1_high double, targets struct<precision double, recall double>, _damaged string")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The published risk report, or one ``measured=false`` row with the reason.

    A missing path is not measured; a damaged report and a folder with several
    reports are errors of their own; any other failure to read is raised.
    """
    targets = F.struct(
        F.lit(D.TARGET_PRECISION).alias("precision"), F.lit(D.TARGET_RECALL).alias("recall"))
    try:
        stored = spark.read.schema(REPORT_SCHEMA).json(
            path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_damaged")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], REPORT_SCHEMA)
    # one row in any case; of several reports none is chosen
    row = stored.agg(F.count("*").alias("_reports"), F.first(F.struct(*stored.columns)).alias("r")).select("_reports", "r.*")
    ok = (F.col("_reports") == 1) & F.col("_damaged").isNull() & F.col("n").isNotNull()
    return row.select(
        ok.alias("measured"),
        F.when(ok, F.col("n")).alias("n"),
        F.when(ok, F.col("precision_high")).alias("precision_high"),
        F.when(ok, F.col("recall_high")).alias("recall_high"),
        F.when(ok, F.coalesce("targets", targets)).otherwise(targets).alias("targets"),
        F.when(~ok, F.lit(D.NOT_MEASURED_REASON)).alias("reason"),
        F.when(F.col("_reports") > 1, F.lit("several reports"))
        .when(F.col("_damaged").isNotNull(), F.lit("malformed report")).alias("error"))


HISTORY_SCHEMA = ("run_id string, started_at string, best_score double, trial_count int, artifact_sha string, "
                  "trials array<struct<index: int, score: double>>")


def read_tuning_history(spark: SparkSession, path: str) -> DataFrame:
    """Tuning runs of a history file, for ``runs.tuning_history``.

    A missing, damaged or wrongly shaped file is an empty history; entries
    that are no objects are skipped. A trial without an index takes its
    position from 1, and an artifact tag is stored bare.
    """
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HISTORY_SCHEMA)

    def is_object(value):
        return F.coalesce(F.schema_of_variant(value), F.lit("VOID")).startswith("OBJECT")

    runs = files.select(F.explode(F.try_variant_get(
        F.try_parse_json("value"), "$.runs", "array<variant>")).alias("run")).filter(is_object(F.col("run")))
    get = lambda path, kind: F.try_variant_get(F.col("run"), path, kind)
    trials = F.filter(F.coalesce(get("$.trials", "array<variant>"), F.array().cast("array<variant>")), is_object)
    bare = F.regexp_replace(get("$.artifact_sha", "string"), "^opt:", "")
    return runs.select(
        get("$.run_id", "string").alias("run_id"), get("$.started_at", "string").alias("started_at"),
        get("$.best_score", "double").alias("best_score"), get("$.trial_count", "int").alias("trial_count"),
        F.when(~bare.isin("", "none"), bare).alias("artifact_sha"),
        F.transform(trials, lambda t, i: F.struct(
            F.coalesce(F.try_variant_get(t, "$.index", "int"), i + 1).alias("index"),
            F.try_variant_get(t, "$.score", "double").alias("score"))).alias("trials"))


def report_gate(report: DataFrame, problems: DataFrame, provider: str) -> DataFrame:
    """Report row plus where it may go: ``provisional``, ``published`` or ``refused``.

    One unresolved label refuses the whole report; the demo scorer only ever
    earns a provisional one.
    """
    n_problems = problems.agg(F.count("*").alias("n_problems"))
    gated = report.withColumn("_k", F.lit(1)).join(
        n_problems.withColumn("_k", F.lit(1)), "_k").drop("_k")
    measured = provider != "fake"
    return gated.withColumns({
        "route": F.when(F.col("n_problems") > 0, "refused")
        .otherwise("published" if measured else "provisional"),
        "measured": F.lit(measured),
        "provider": F.lit(provider),
    })


TEXT_COLUMNS = ("text", "raw_text", "span", "span_text", "summary", "plain_language_summary")


def write_report(gated: DataFrame, folder: str) -> None:
    """Write the report to the folder its route has earned; never any text column."""
    shown = gated.drop(*TEXT_COLUMNS)
    for route in ("published", "provisional"):
        part = shown.filter(F.col("route") == route)
        if not part.isEmpty():
            part.write.mode("overwrite").json(f"{folder}/{route}")
