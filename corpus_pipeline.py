"""Corpus pipeline: quality, line dedup, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``. Null texts count as empty, repeated rows are
treated alike, further columns are left out, and empty tables give empty
results; the operators' docstrings say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm import line_spread, mixing, near_duplicates, packing, quality
from pactlens.llm.language_id import held_out
from pactlens.session import fresh_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the classifier learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels, ~held_out())
    scored = quality.score_texts(docs, model, {c: F.col(c) for c in COLUMNS})
    return scored.filter(F.col("score") >= quality.ACCEPT).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their boilerplate lines; one that loses all its text this way goes, as others keep it."""
    cleaned = line_spread.drop_boilerplate(docs, keep=("lang", "source", "n_chars"))
    touched = F.col("n_removed") > 0
    return cleaned.filter(~touched | (F.length(F.btrim("cleaned", F.lit(" \t\r\n"))) > 0)).select(
        "doc_id", F.col("cleaned").alias("text"), "lang", "source",
        F.when(touched, F.length("cleaned").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    return near_duplicates.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources; repeats are rows of their own, and the last text of a source may be cut."""
    mixed, _ = mixing.mix_sources(docs, keep=("lang", "n_chars"))
    cut = F.col("words") < F.col("size")
    text = F.when(cut, mixing.first_words(F.col("text"), F.col("words"))).otherwise(F.col("text"))
    return mixing.shuffled(mixed.withColumn("text", text)).select(
        "doc_id", "text", "lang", "source", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed texts with their batches."""
    return packing.pack(docs, keep_text=True)


STAGES = [("quality", accept), ("lines", drop_lines), ("near_duplicates", keep_one), ("mix", mix), ("pack", pack)]

# trained trees, signatures and the random tree have no SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
