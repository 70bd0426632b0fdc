"""Packing into optimal length buckets with a token budget for every batch.

A dynamic program over the global histogram of lengths chooses the bucket
boundaries that minimise padding. Batches of one bucket hold as many pieces as
the token budget allows at the bucket's boundary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.functions.text import bind
from pactlens.llm.mixing import word_count

MAX_LENGTH = 2048  # words of a piece; longer documents are cut into several
BUCKETS = 12
BATCH_TOKENS = 16384  # boundary times rows of a batch
GROUP_BATCHES = 16  # batches that one group forms; groups keep every task small


def boundaries(histogram: np.ndarray, buckets: int) -> list[int]:
    """Ascending boundaries, at most ``buckets``, with the least padding in all.

    ``histogram[n]`` counts pieces of length n. Each piece is padded to the
    least boundary that is not below its length. Ties go to the smaller boundary.
    """
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    count = np.concatenate([[0], np.cumsum(histogram[lengths], dtype=np.float64)])
    # padded size of the lengths i..j-1 in one bucket is lengths[j-1] * (count[j] - count[i])
    n = len(lengths)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    choices = []
    for _ in range(min(buckets, n)):
        new, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            total = cost[:j] + lengths[j - 1] * (count[j] - count[:j])
            choice[j] = int(np.argmin(total))
            new[j] = total[choice[j]]
        choices.append(choice)
        if new[n] >= cost[n]:
            choices.pop()
            break
        cost = new
    out, j = [], n
    for choice in reversed(choices):
        out.append(int(lengths[j - 1]))
        j = int(choice[j])
        if not j:
            break
    return sorted(out)


def pieces(docs: DataFrame, id_col: str, text_col: str, max_length: int, keep_text: bool) -> DataFrame:
    """(doc_id, piece, first_word, length[, text]): every document cut into pieces of ``max_length`` words at most."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), word_count(F.col(text_col)).alias("n"))
    spans = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / max_length).cast("int") - 1))
    if keep_text:
        whole = F.coalesce("text", F.lit(""))
        words = F.split(F.btrim(whole, F.lit(" \t\n\x0b\f\r")), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
        # a text is split once, and its pieces are slices of that
        cut = bind(words, lambda w: F.transform(spans, lambda i: F.array_join(F.slice(w, i * max_length + 1, F.lit(max_length)), "")))
        out = rows.select("doc_id", "n", F.posexplode(F.when(F.col("n") <= max_length, F.array(whole)).otherwise(cut)).alias("piece", "text"))
    else:
        out = rows.select("doc_id", "n", F.explode(spans).alias("piece"))
    first = F.col("piece").cast("long") * max_length
    columns = ["doc_id", "piece", first.alias("first_word"), F.least(F.lit(max_length), F.col("n") - first).cast("int").alias("length")]
    return out.select(*columns, *(["text"] if keep_text else []))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH,
         buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, keep_text: bool = False) -> DataFrame:
    """(doc_id, piece, first_word, length, boundary, batch, slot[, text]), a row for every piece.

    Batches form inside groups of a bucket that are dealt by hash, as many as
    the histogram asks for, so that a bucket with a third of all rows is spread
    over many tasks; the last batch of a group may be short. Empty and null
    texts give one piece of length 0 without boundary and batch. Repeated rows
    are packed each; other columns are left out.
    """
    made = pieces(docs, id_col, text_col, max_length, keep_text)
    # at most max_length + 1 rows
    counted = pieces(docs, id_col, text_col, max_length, False).groupBy("length").count().collect()
    histogram = np.zeros(max_length + 1, np.int64)
    for r in counted:
        histogram[r["length"]] = r["count"]
    bounds = boundaries(histogram, buckets)
    if not bounds:
        return made.select("*", F.lit(None).cast("int").alias("boundary"), F.lit(None).cast("string").alias("batch"),
                           F.lit(None).cast("int").alias("slot"))
    rows_of = [max(1, batch_tokens // b) for b in bounds]
    total = np.add.reduceat(histogram, [0, *[b + 1 for b in bounds[:-1]]])
    groups = [max(1, round(t / (r * GROUP_BATCHES))) for t, r in zip(total.tolist(), rows_of, strict=True)]

    def of_bucket(values):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)

    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("length")))
    placed = made.withColumn("bucket", F.when(F.col("length") > 0, bucket)).withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "piece"), of_bucket(groups)))
    order = Window.partitionBy("bucket", "group").orderBy(F.xxhash64(F.lit(1), "doc_id", "piece"), "doc_id", "piece")
    fed = placed.filter("bucket IS NOT NULL").withColumn("at", F.row_number().over(order) - 1)
    text = ["text"] if keep_text else []
    batched = fed.select(
        "doc_id", "piece", "first_word", "length", *text, of_bucket(bounds).alias("boundary"),
        F.concat_ws("-", of_bucket(bounds), "group", F.floor(F.col("at") / of_bucket(rows_of))).alias("batch"),
        (F.col("at") % of_bucket(rows_of)).alias("slot"))
    empty = placed.filter("bucket IS NULL").select(
        "doc_id", "piece", "first_word", "length", *text, F.lit(None).cast("int").alias("boundary"),
        F.lit(None).cast("string").alias("batch"), F.lit(None).cast("int").alias("slot"))
    return batched.unionByName(empty)


def padding(packed: pd.DataFrame) -> int:
    """Words of padding in packed rows."""
    used = packed[packed["boundary"].notna()]
    return int((used["boundary"] - used["length"]).sum())


def op9_packing(docs: DataFrame) -> DataFrame:
    """A row for every piece of every document, with its boundary, batch and slot."""
    return pack(docs)
