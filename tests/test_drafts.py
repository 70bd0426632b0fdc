"""Clauses cut once, and draft anchors read from the ends of a clause."""

import json
import time

from pyspark.sql import functions as F

from pactlens import domain as D
from pactlens.functions import scoring as S
from pactlens.functions import text as T
from pactlens.sources import annotations as N
from pactlens.sources import pages as P
from test_patterns import odd_texts


def _plain(col):
    return F.btrim(F.regexp_replace(col, T.WS + "+", " "), F.lit(" "))


def test_a_text_is_cut_into_clauses_once(spark):
    documents = spark.range(4).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("the first paragraph\n\nanother paragraph "), F.col("id").cast("string")).alias("text"))
    for segments in (None, T.split_headings(F.col("text"))):
        plan = P.clauses_of(documents, segments=segments)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate posexplode" in plan and "Filter" not in plan
    assert [tuple(r) for r in P.clauses_of(documents).orderBy("doc_id", "clause_index").limit(2).collect()] == [
        (0, 1, "the first paragraph"), (0, 2, "another paragraph 0")]
    assert P.clauses_of(documents.select("doc_id", F.lit(" \n ").alias("text"))).count() == 0


def test_ends_of_a_text_as_by_the_whole(evaluate):
    texts = [None, *odd_texts(2000), *(f"{gap}{'x' * n}{gap}{'y' * n}{gap}" for n in (1, 29, 30, 31, 60) for gap in (" ", "\t" * 70, " " * 200))]
    for limit in (1, 7, 30):
        assert evaluate(texts, lambda x: T.preview(x, limit)) == evaluate(
            texts, lambda x: F.substring(_plain(F.coalesce(x, F.lit(""))), 1, limit))
        assert evaluate(texts, lambda x: T.preview_end(x, limit)) == evaluate(
            texts, lambda x: F.right(_plain(F.coalesce(x, F.lit(""))), F.lit(limit)))


def test_draft_anchors_as_by_the_whole_clause(spark):
    rows = spark.createDataFrame(
        [(i % 3, i, t, "general") for i, t in enumerate([None, *odd_texts(400), "a" * 41, " a" * 300])],
        "doc_id int, clause_index int, raw_text string, clause_type string")
    got = {(r["doc_id"], c["id"]): (c["anchor_start"], c["anchor_end"])
           for r in N.draft_annotations(rows).collect() for c in json.loads(r["draft"])["clauses"]}
    span = _plain(F.col("raw_text"))
    want = rows.select("doc_id", "clause_index", F.substring(span, 1, 40).alias("a"), F.right(span, F.lit(30)).alias("b")).collect()
    assert got == {(r["doc_id"], r["clause_index"]): (r["a"], r["b"]) for r in want}


def test_the_end_of_a_long_text_is_read_alone(spark):
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
        whole = seconds(lambda x: F.substring(T.normalise_whitespace(x), -30, 30))
        assert seconds(lambda x: T.preview_end(x, 30)) < whole * 0.6
    finally:
        rows.unpersist()


def test_parts_are_stripped_as_by_the_plain_strip(evaluate):
    texts = [None, *("\n\n".join(pair) for pair in zip(odd_texts(1500), reversed(odd_texts(1500)))), "a\n\n 　\n\n\xa0b\x1c\n\n~\n\n!"]
    plain = lambda x: F.filter(F.transform(F.split(x, rf"\n{T.WS}*\n"), T.strip), lambda part: part != "")
    assert evaluate(texts, T.split_blank_lines) == evaluate(texts, plain)


def test_keywords_as_found_in_the_string(evaluate):
    words = [word for rule in D.KEYWORD_RULES for word in rule[2]]
    texts = [None, "", "É fée", "İP ", *words, *(word.upper() for word in words), *(word[:-1] for word in words),
             *("ß" + a[1:] + "😀" + b for a, b in zip(words, reversed(words))), *odd_texts(300)]
    hits = [any(w in t for w in words) for t in evaluate(texts[1:], F.lower)]
    found = evaluate(texts, S.classify_keywords)
    assert [r["confidence"] != D.KEYWORD_DEFAULT[1] for r in found] == [False, *hits]
    firsts = [next((r[0] for r in D.KEYWORD_RULES if any(w in word for w in r[2])), None) for word in words]
    assert [r["clause_type"] for r in found[4:4 + len(words)]] == firsts


def test_keywords_are_sought_in_bytes(spark):
    rows = spark.range(1).select(F.col("id").cast("string").alias("x")).select(S.classify_keywords(F.col("x")).alias("c"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") == 0 and "contains(" in plan
