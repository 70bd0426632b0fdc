"""Documents -> scored clauses -> contract-level results, as one lazy plan."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions import language, scoring
from pactlens.functions.text import bind
from pactlens.operators import contracts as C
from pactlens.session import built_once
from pactlens.sources.pages import clauses_of

Scorer = Callable[[str, str], tuple[str, str, str]]
RETRIES = 3
RETRY_PAUSE_SECONDS = 0.8


@built_once
def _typed() -> Column:
    return scoring.classify_keywords(F.col("raw_text"))


@built_once
def _answer() -> Column:
    return scoring.demo_answer(F.col("raw_text"), F.col("clause_type"))


def classify_clauses(clauses: DataFrame) -> DataFrame:
    """Add clause_type and conf (four decimals, as stored) by keyword rules."""
    return clauses.withColumn("_c", _typed()).select(
        *clauses.columns, F.col("_c.clause_type").alias("clause_type"),
        F.round("_c.confidence", 4).alias("conf"))


def score_clauses(
    clauses: DataFrame, scorer: Scorer | None = None, retries: int = RETRIES,
    pause: float = RETRY_PAUSE_SECONDS,
) -> DataFrame:
    """Add summary, factors_raw, score_raw, attempts and error to typed clauses.

    The default scorer is a native expression. A custom one is a Python
    callable ``(text, clause_type) -> (summary, factors, score)`` that runs in
    Arrow batches on the executors; a clause that keeps failing gets its last
    error as a value and does not disturb the others.
    """
    if scorer is None:
        answered = clauses.withColumn("_a", _answer())
        return answered.select(
            *clauses.columns, "_a.summary", "_a.factors_raw", "_a.score_raw",
            F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"))

    def ask(text: str, kind: str) -> tuple:
        error = None
        for attempt in range(1, retries + 1):
            try:
                return (*scorer(text, kind), attempt, None)
            except Exception as failure:  # reported per clause
                error = f"{type(failure).__name__}: {failure}"
                if attempt < retries:
                    time.sleep(pause * 2 ** (attempt - 1))
        return (None, None, None, retries, error)

    names = ["summary", "factors_raw", "score_raw", "attempts", "error"]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [ask(x, k) for x, k in zip(frame["raw_text"], frame["clause_type"])]
            yield frame.assign(**{
                n: [a[i] for a in answers] for i, n in enumerate(names)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clauses.schema.fields)
    return clauses.mapInPandas(
        batches,
        f"{fields}, summary string, factors_raw string, score_raw string, attempts int, error string")


@built_once
def _parsed() -> dict[str, Column]:
    def cleaned(items: Column) -> Column:
        return F.struct(
            F.transform(items, lambda f: f["text"]).alias("factors"),
            F.aggregate(items, F.lit(0), lambda n, f: n + f["rewrites"]).alias("rewrites"))

    factors = bind(F.transform(
        scoring.parse_factors(F.col("factors_raw")), lambda f: language.sanitize(f)), cleaned)
    return {
        "model_score": F.round(scoring.parse_score(F.col("score_raw")), 4),  # scores are stored with four decimals
        "_summary": language.sanitize(scoring.strip(F.col("summary"))),
        "_factors": factors,
    }


def finalize(answers: DataFrame) -> DataFrame:
    """Parse answers, filter prescriptive language and blend the hybrid level."""
    parsed = answers.withColumns(_parsed())
    finished = parsed.withColumns({
        "summary": F.col("_summary.text"),
        "risk_factors": F.col("_factors.factors"),
        "rewrites": F.col("_summary.rewrites") + F.col("_factors.rewrites"),
        "n_factors": F.size("_factors.factors"),
    }).drop("_summary", "_factors", "factors_raw", "score_raw")
    return C.with_hybrid(finished)


def analyze_documents(
    documents: DataFrame, text: str = "text", scorer: Scorer | None = None,
    fingerprint: str = "fake/demo|spark|v4|opt:none",
) -> DataFrame:
    """(doc_id, text) -> one scored row per clause; failed clauses keep their error."""
    typed = classify_clauses(clauses_of(documents, text)).withColumn(
        "content_hash", scoring.content_hash(F.col("raw_text"), fingerprint))
    return finalize(score_clauses(typed, scorer))


def document_distribution(scored: DataFrame) -> DataFrame:
    counts = [col.alias(name) for name, col in C.level_counts(F.col("risk_level")).items()]
    return scored.groupBy("doc_id").agg(
        *counts, F.count("*").alias("n_clauses"), F.sum("rewrites").alias("rewrites"))
