"""Segmentation and risk evaluation jobs."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pactlens import domain as D
from pactlens.functions import text as T
from pactlens.operators import evaluation as E
from pactlens.plans.analyze import Scorer, classify_clauses, finalize, score_clauses
from pactlens.session import cut_lineage
from pactlens.sources.annotations import resolve_spans


Transform = Callable[[DataFrame], DataFrame]


SEARCHED = 64  # documents whose texts are Python objects at a time


def _to_locate(documents: DataFrame) -> DataFrame:
    """(doc_id, text, parts, lengths): what the search needs of each document.

    A text that is its parts with a space between them has them at the sums of
    their lengths, as a part starts with no space and the search goes on
    behind the part before; of such a text only the lengths leave the JVM.
    """
    rows = documents.select("doc_id", T.normalise_whitespace(F.col("text")).alias("text"),
                            F.transform(T.segment_text(F.col("text")), T.normalise_whitespace).alias("parts"))
    plain = F.coalesce((F.array_join("parts", " ") == F.col("text")) & ~F.array_contains("parts", ""), F.lit(False))
    return rows.withColumn("plain", plain).select(
        "doc_id", *[F.when(~F.col("plain"), F.col(c)).alias(c) for c in ("text", "parts")],
        F.when(F.col("plain"), F.transform("parts", F.length)).alias("lengths"))


def _located(documents: DataFrame) -> DataFrame:
    """(doc_id, found): where each document's own segments lie in its text."""
    rows = _to_locate(documents)

    def find(text: str | None, parts: list | None, lengths: list | None) -> dict | None:
        if lengths is None:
            return T.search_parts(text, parts)
        return {"offsets": list(itertools.accumulate((n + 1 for n in lengths[:-1]), initial=0)) if lengths else [], "missing": None}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SEARCHED):
                some = batch.slice(at, SEARCHED)
                found = [find(*row) for row in zip(*[some.column(c).to_pylist() for c in ("text", "parts", "lengths")], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(found, to_arrow_type(T.LOCATED))], ["doc_id", "found"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, found {T.LOCATED.simpleString()}")


def predicted_starts(documents: DataFrame) -> DataFrame:
    """Clause starts of each document's own segmentation: (doc_id, idx, offset)."""
    return _located(documents).filter("found.missing IS NULL").select("doc_id", F.posexplode("found.offsets").alias("idx", "offset"))


def unlocated_documents(documents: DataFrame) -> DataFrame:
    """Documents whose segments are no substrings of their text; never silently skipped."""
    return _located(documents).select("doc_id", F.col("found.missing").alias("segment")).filter("segment IS NOT NULL")


def evaluate_segmentation(
    documents: DataFrame, annotations: DataFrame, tolerance: int = D.BOUNDARY_TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """(scores per document and micro, problems) of the segmenter against annotations."""
    spans, problems = resolve_spans(documents, annotations)
    # offsets are small and used several times; the text work runs once
    gold = cut_lineage(spans.select(
        "doc_id", F.col("position").alias("idx"), F.col("start").alias("offset")))
    predicted = cut_lineage(predicted_starts(documents))
    matches = E.match_boundaries(predicted, gold, tolerance)
    return E.boundary_scores(predicted, gold, matches), problems


def evaluate_types(spans: DataFrame, classify: Transform = classify_clauses) -> DataFrame:
    """Accuracy of a classifier on (raw_text, gold_type) spans; unlabeled ones are left out.

    ``classify`` is any DataFrame -> DataFrame step that adds ``clause_type``.
    """
    typed = classify(spans.filter(F.col("gold_type").isNotNull()))
    return E.type_accuracy(typed.withColumnRenamed("clause_type", "predicted_type"))


def evaluate_risk(
    labeled: DataFrame, classify: Transform = classify_clauses, scorer: Scorer | None = None
) -> DataFrame:
    """(source, raw_text, gold_high) -> rows with the production verdict next to the label."""
    typed = classify(E.labeled(labeled, text="raw_text"))
    scored = finalize(score_clauses(typed, scorer))
    return scored.withColumn("predicted_high", F.col("risk_level") == "high")
