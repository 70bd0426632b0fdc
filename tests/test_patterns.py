"""Patterns with cheap first conditions against the plain ones they stand for."""

import random
import time

from pyspark.sql import functions as F

from pactlens.functions import readability as R
from pactlens.functions import text as T

PLAIN_END = (
    rf"(?<!{T.NON_WS})(?!{R._ABBREVIATED})({T.NON_WS}*?[.!?]+{R.CLOSERS}*)(?={T.WS_NOT_NEWLINE}+{R.OPENERS}?[A-Z0-9])")
PIECES = [*"aZé9.!?…,'’\"”()[]-•ßǅ", "\U00010400", "😀", " ", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "　",
          "e.g.", "No.", "Mr.", "U.S.", "end. Then", "made", "little", "queue"]


def odd_texts(n):
    deal = random.Random(7)
    return ["", " ", "　 \n", *("".join(deal.choices(PIECES, k=deal.randint(1, 60))) for _ in range(n))]


def test_sentence_ends_and_whitespace_as_by_the_plain_patterns(evaluate):
    texts = odd_texts(3000)
    assert evaluate(texts, lambda x: F.regexp_replace(x, R.SENTENCE_END, "$1\n")) == evaluate(
        texts, lambda x: F.regexp_replace(x, PLAIN_END, "$1\n"))
    assert evaluate(texts, T.normalise_whitespace) == evaluate(
        texts, lambda x: F.btrim(F.regexp_replace(x, T.WS + "+", " "), F.lit(" ")))


def test_spoken_words_as_by_the_plain_patterns(evaluate):
    def plain(x):
        text = F.lower(F.regexp_replace(x, rf"(?<={R.ALNUM})['’.,\-](?={R.ALNUM})", ""))
        text = F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")
        text = F.regexp_replace(text, "(?<![^ ])[^a-z ]+(?![^ ])", "x")
        return F.regexp_replace(text, "[^a-z ]+", "")

    texts = odd_texts(3000)
    assert evaluate(texts, R._spoken_words) == evaluate(texts, plain)


def test_most_places_cost_a_sentence_end_no_search_for_abbreviations(spark):
    words = " ".join(["reasonable", "(parties)", "shall", "agree", "upon", "terms"] * 400) + ". Next"
    rows = spark.range(0, 400, 1, 8).select(F.concat(F.lit(words), F.col("id").cast("string")).alias("x")).cache()
    rows.count()

    def seconds(pattern):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            rows.select(F.length(F.regexp_replace("x", pattern, "$1\n")).alias("n")).agg(F.sum("n")).first()
            took.append(time.perf_counter() - start)
        return min(took)

    try:
        assert seconds(R.SENTENCE_END) < seconds(PLAIN_END) * 0.6
    finally:
        rows.unpersist()


def test_preview_of_a_long_text_reads_its_head(evaluate, spark):
    texts = odd_texts(2000)
    for limit in (1, 7, 40):
        assert evaluate(texts, lambda x: T.preview(x, limit)) == evaluate(
            texts, lambda x: F.substring(F.btrim(F.regexp_replace(x, T.WS + "+", " "), F.lit(" ")), 1, limit))
    rows = spark.range(0, 200, 1, 8).select(F.repeat(F.lit("a few  words "), 40_000).alias("x")).cache()
    rows.count()

    def seconds(build):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            rows.select(F.length(build(F.col("x"))).alias("n")).agg(F.sum("n")).first()
            took.append(time.perf_counter() - start)
        return min(took)

    try:
        assert seconds(lambda x: T.preview(x, 40)) < seconds(lambda x: F.substring(T.normalise_whitespace(x), 1, 40)) * 0.6
    finally:
        rows.unpersist()
