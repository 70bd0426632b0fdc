"""Spans are closed in their document's row, and plain texts are located by lengths."""

from pyspark.sql import functions as F

from pactlens.functions import text as T
from pactlens.plans import evaluate as V
from pactlens.sources import annotations as N


def test_open_ends_shuffle_no_text_per_span(spark):
    docs = spark.createDataFrame([(1, "one  two three\nfour five six"), (2, "alpha beta"), (3, None)], "doc_id long, text string")
    clauses = spark.createDataFrame([
        (1, 4, 40, "five", None), (1, 1, 10, "one", "two"), (1, 2, 20, "absent", ""), (1, 3, 30, "three", ""), (2, 1, 7, "gone", ""),
        (2, 2, 8, "beta", "alpha"), (3, 1, 9, "x", "")], "doc_id long, position int, id int, anchor_start string, anchor_end string")
    spans, problems = N.resolve_spans(docs, clauses)
    assert sorted(tuple(r) for r in spans.collect()) == [
        (1, 0, 10, 0, 7, "one two"), (1, 2, 30, 8, 19, "three four "), (1, 3, 40, 19, 27, "five six"), (2, 1, 8, 6, 10, "beta")]
    assert sorted(tuple(r) for r in problems.collect()) == [
        (1, 20, "anchor_start", "absent"), (2, 7, "anchor_start", "absent"), (2, 8, "anchor_end", "earlier")]
    plan = spans.select("doc_id", "id", "start", "end")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_plain_texts_are_located_by_the_lengths_of_their_parts(spark):
    texts = ["", " ", "one line only", "First paragraph of it.\n\nSecond  paragraph 😀 here.\n \nThird one, é and all.\n\nThird one, é and all.",
             "a\n\nb\n\nlong enough to stand alone", "1. Heading Of The First\ntext text text\n2. Heading Of The Second\nmore", None,
             "x ﷐ marked paragraph one\n\ny\n\nmarked paragraph two ﷑"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = docs.select("doc_id", T.normalise_whitespace(F.col("text")).alias("text"),
                       F.transform(T.segment_text(F.col("text")), T.normalise_whitespace).alias("parts")).collect()
    want = {r["doc_id"]: T.search_parts(r["text"], r["parts"]) for r in rows}
    got = {r["doc_id"]: r["found"] and r["found"].asDict() for r in V._located(docs).collect()}
    assert got == want
    sent = {r["doc_id"]: r for r in V._to_locate(docs).collect()}
    assert sent[3]["text"] is None and sent[3]["parts"] is None and len(sent[3]["lengths"]) == 4
