"""Annotated contracts: JSON ingest with validation, spans, drafts and QA files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens import domain as D
from pactlens.functions import scoring
from pactlens.functions import text as T

# --- fixed values ---------------------------------------------------------------
ANCHOR_START_CHARS = 40
ANCHOR_END_CHARS = 30
DRAFT_NOTE = (
    "DRAFT generated from the current segmentation — it agrees with the segmenter by "
    "construction. Merge/split clauses, correct clause_type, and set high_risk before using it "
    "as ground truth.")


def read_annotation_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (source, raw). A byte-order mark is tolerated."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split("_metadata.file_name", "/"), -1).alias("source"),
        F.regexp_replace("value", "^﻿", "").alias("raw"))


def _get(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def parse_annotations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, raw JSON) -> (clauses, problems); nothing is dropped silently.

    ``clauses`` only holds files without any problem. ``problems`` has
    (source, position, problem); position 0 is the file itself.
    """
    docs = files.select("source", F.try_parse_json("raw").alias("doc"))
    clauses = _get(F.col("doc"), "$.clauses", "array<variant>")
    shaped = docs.select(
        "source", "doc", clauses.alias("clauses"),
        _get(F.col("doc"), "$.missing_protections", "variant").alias("missing"))
    is_object = _kind(F.col("doc")).startswith("OBJECT")
    # absent and null mean an empty list; every entry must be a known name
    bad_missing = ~_kind(F.col("missing")).isin("VOID") & (
        ~_kind(F.col("missing")).startswith("ARRAY") | F.exists(
            _get(F.col("missing"), "$", "array<variant>"),
            lambda m: (_kind(m) != "STRING")
            | ~F.coalesce(F.lower(T.strip(F.try_variant_get(m, "$", "string"))).isin(*D.PAIN_POINTS), F.lit(False))))
    file_problem = (
        F.when(F.col("doc").isNull(), "is not valid JSON")
        .when(~is_object, "the top level must be a JSON object")
        .when(F.coalesce(F.size("clauses"), F.lit(0)) <= 0, "'clauses' must be a non-empty list")
        .when(bad_missing, "unknown missing_protections entry")
    )
    file_problems = shaped.select(
        "source", F.lit(0).alias("position"), file_problem.alias("problem"))
    items = shaped.select("source", F.posexplode("clauses").alias("pos", "item")).select(
        "source", (F.col("pos") + 1).alias("position"), "item")
    item = F.col("item")
    id_raw = _get(item, "$.id", "variant")
    label_raw = _get(item, "$.clause_type", "variant")
    risk_raw = _get(item, "$.high_risk", "variant")
    fields = items.select(
        "source", "position",
        F.coalesce(_get(item, "$.id", "int"), F.col("position")).alias("id"),
        _kind(id_raw).alias("id_kind"), _get(item, "$.id", "int").alias("id_value"),
        T.strip(F.coalesce(_get(item, "$.anchor_start", "string"), F.lit("")))
        .alias("anchor_start"),
        F.coalesce(_get(item, "$.anchor_end", "string"), F.lit("")).alias("anchor_end"),
        scoring.annotation_label(_get(item, "$.clause_type", "string")).alias("clause_type"),
        _kind(label_raw).alias("label_kind"),
        _get(item, "$.high_risk", "boolean").alias("high_risk"),
        _kind(risk_raw).alias("risk_kind"),
        _kind(item).startswith("OBJECT").alias("is_object"))
    clause_problem = (
        F.when(~F.col("is_object"), "each clause must be a JSON object")
        .when((F.col("id_kind") != "VOID") & (~F.col("id_kind").isin("BIGINT") | F.col("id_value").isNull()),
              "id must be an integer")
        .when(F.col("anchor_start") == "", "anchor_start is required")
        .when(~F.col("label_kind").isin("STRING", "VOID"), "clause_type must be a string or null")
        .when(F.col("clause_type").isNotNull() & ~F.col("clause_type").isin(*D.CLAUSE_TYPES),
              "unknown clause_type")
        .when(~F.col("risk_kind").isin("BOOLEAN", "VOID"), "high_risk must be true, false or null")
    )
    checked = fields.withColumn("problem", clause_problem)
    problems = file_problems.unionByName(
        checked.select("source", "position", "problem")).filter(F.col("problem").isNotNull())
    valid = checked.join(problems.select("source").distinct(), "source", "left_anti").select(
        "source", "position", "id", "anchor_start", "anchor_end", "clause_type", "high_risk")
    return valid, problems


def resolve_spans(documents: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bind annotated clauses to their documents: (spans, problems).

    ``documents`` is (doc_id, text), ``clauses`` (doc_id, position, id,
    anchor_start, anchor_end). An open end runs to the next clause's start.
    """
    ordered = clauses.groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("position", "id", "anchor_start", "anchor_end"))).alias("clauses"))
    bound = documents.select(
        "doc_id", T.normalise_whitespace(F.col("text")).alias("text")).join(ordered, "doc_id")
    rows = bound.withColumn("spans", T.resolve_anchors(F.col("text"), F.col("clauses"))).select(
        "doc_id", "text", F.transform("spans", lambda s, i: F.struct(i.alias("position"), s["id"].alias("id"), s["start"].alias("start"), s[
            "end"].alias("end"), s["start_problem"].alias("start_problem"), s["end_problem"].alias("end_problem"))).alias("spans"))
    problems = rows.select("doc_id", F.inline("spans")).select(
        "doc_id", "id", F.explode(F.array_compact(F.array(
            F.when(F.col("start_problem").isNotNull(), F.struct(
                F.lit("anchor_start").alias("anchor"), F.col("start_problem").alias("problem"))),
            F.when(F.col("end_problem").isNotNull(), F.struct(
                F.lit("anchor_end").alias("anchor"), F.col("end_problem").alias("problem"))),
        ))).alias("p")).select("doc_id", "id", "p.anchor", "p.problem")
    return close_open_ends(rows), problems


def close_open_ends(bound: DataFrame) -> DataFrame:
    """Spans without an end run to the next span's start, or to the text's end.

    ``bound`` has one row per document with its ordered ``spans``. They are
    closed inside the row, so that no text is shuffled once per span.
    """
    def close(starts: Column) -> Column:
        return F.transform(starts, lambda s, i: F.struct(
            s["position"].alias("position"), s["id"].alias("id"), s["start"].alias("start"),
            F.coalesce(s["end"], F.greatest(s["start"], F.coalesce(F.get(starts, i + 1)["start"], F.col("length")))).alias("end")))

    started = F.filter("spans", lambda s: s["start"].isNotNull())
    closed = bound.withColumn("length", F.length("text")).withColumn("spans", T.bind(started, close))
    return closed.select("doc_id", "text", F.inline("spans")).select(
        "doc_id", "position", "id", "start", "end",
        F.expr("substring(text, start + 1, greatest(end - start, 0))").alias("span_text"))


def draft_annotations(clauses: DataFrame) -> DataFrame:
    """Draft annotation JSON per document from its current clauses."""
    def anchor(quote: Column) -> Column:
        return F.when(F.col("raw_text").isNotNull(), quote)

    rows = clauses.select(
        "doc_id", F.struct(
            F.col("clause_index").alias("id"),
            anchor(T.preview(F.col("raw_text"), ANCHOR_START_CHARS)).alias("anchor_start"),
            anchor(T.preview_end(F.col("raw_text"), ANCHOR_END_CHARS)).alias("anchor_end"),
            F.col("clause_type"),
            F.lit(None).cast("boolean").alias("high_risk"),
            F.lit("").alias("risk_note")).alias("clause"))
    document = F.struct(
        F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file"),
        F.lit("").alias("annotator"), F.lit("").alias("annotated_at"),
        F.lit(DRAFT_NOTE).alias("notes"), F.col("clauses"),
        F.array().cast("array<string>").alias("missing_protections"))
    return rows.groupBy("doc_id").agg(
        F.sort_array(F.collect_list("clause")).alias("clauses")).select(
        "doc_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("draft"))


QA_SCHEMA = "question string, answers struct<text: array<string>>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QA_SCHEMA).json(path)


def answer_spans(questions: DataFrame, min_chars: int = 1) -> DataFrame:
    """Question rows -> one row per non-empty, whitespace-normalised answer span."""
    return questions.select("question", F.explode("answers.text").alias("raw")).select(
        "question", T.normalise_whitespace(F.coalesce("raw", F.lit(""))).alias("span")
    ).filter(F.length("span") >= min_chars)


def risk_labeled_spans(questions: DataFrame) -> DataFrame:
    """Spans with a signer-perspective label; unmatched questions are dropped."""
    categories = {**dict.fromkeys(D.QUESTION_HIGH_RISK, True), **dict.fromkeys(D.QUESTION_LOW_RISK, False)}
    spans = answer_spans(questions, D.MIN_SPAN_CHARS).withColumn(
        "category", scoring.question_category(F.col("question"), categories))
    return spans.filter(F.col("category").isNotNull()).select(
        "category", "span",
        F.col("category").isin(*D.QUESTION_HIGH_RISK).alias("gold_high")).distinct()
