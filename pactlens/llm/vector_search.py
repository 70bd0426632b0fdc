"""Exact top-k search by inner product with MaxScore pruning.

Every dimension of a query is a term whose contribution has an upper bound in
a shard of vectors. The dimensions of the smallest bounds that together can't
lift a vector to the score to beat are not essential: they are probed only for
vectors that are still competitive. Postings of the essential ones are
traversed for all vectors of the shard. The score to beat is passed on from
shard to shard, and the best of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 1 << 13  # vectors of a shard, about
QUERY_ROWS = 1 << 12  # queries of a block, about
GROUP = 64  # queries whose essential dimensions are chosen together
SEED_ROWS = 256  # vectors of a shard whose full scores give a first score to beat


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int, *more: str) -> DataFrame:
    """(id, v) and more columns, with floor(scale * x) of each component as double; unusable vectors are left out."""
    x = F.col(vector_col)
    usable = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(usable).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"), *more)


def blocks(rows: DataFrame, per_block: int, name: str) -> tuple[DataFrame, int]:
    """(name, rows), packed into blocks of about ``per_block`` by their hash and sorted; and the number of blocks."""
    count = max(1, -(-rows.count() // per_block))
    keyed = rows.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int"))
    return keyed.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("rows")), count


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of integers; shorter ones are filled with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def number_type(queries: np.ndarray, vectors: np.ndarray):
    """The fastest type that holds every inner product exactly; beyond it, 64-bit integers that wrap."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def best(queries: np.ndarray, vectors: np.ndarray, k: int, beat: np.ndarray):
    """(query position, positions of its vectors, scores) of the k best of the shard for every query of a block.

    ``beat`` holds a score for each query that k vectors are known to reach,
    and is raised. A shard gives no vector below it, so it may give fewer than
    k. Vectors come in the order in which ties are settled.
    """
    kind = number_type(queries, vectors)
    exact = kind is not np.int64  # integers that wrap have no bounds
    vectors, queries = vectors.astype(kind), queries.astype(kind)
    low, high = vectors.min(0), vectors.max(0)
    seed = vectors[:max(k, SEED_ROWS)].T
    for begin in range(0, len(queries), GROUP):
        group, known = queries[begin:begin + GROUP], beat[begin:begin + GROUP]
        if exact and len(vectors) >= k:
            np.maximum(known, np.partition(group @ seed, seed.shape[1] - k, axis=1)[:, seed.shape[1] - k], out=known)
        most = np.maximum(group * low, group * high).astype(np.float64)
        least = np.minimum(group * low, group * high).astype(np.float64)
        spread = most - least
        terms = np.argsort(-spread.sum(0), kind="stable")
        # what the terms from here on can add to the least score of all
        tail = np.cumsum(spread[:, terms[::-1]], axis=1)[:, ::-1]
        needless = (tail < (known - least.sum(1))[:, None]).all(0) & exact
        cut = int(np.argmax(needless)) if needless.any() else len(terms)
        first, rest = terms[:cut], terms[cut:]
        partial = group[:, first] @ np.ascontiguousarray(vectors[:, first]).T
        others = np.ascontiguousarray(vectors[:, rest])
        norms = np.sqrt(np.square(others, dtype=np.float64).sum(1))
        for i, q in enumerate(group[:, rest]):
            alive, score = np.arange(len(vectors)), partial[i]
            if len(rest) and len(alive) > k:
                # full scores of the k most promising vectors raise the score to beat
                top = np.argpartition(score, len(score) - k)[-k:]
                known[i] = max(known[i], (score[top] + others[top] @ q).min())
                reach = np.minimum(norms * np.sqrt(np.square(q, dtype=np.float64).sum()) * (1 + 1e-9), most[i, rest].sum())
                alive = np.flatnonzero(score + reach >= known[i])
                score = score[alive]
            if len(rest):
                score = score + others[alive] @ q
            if exact:
                near = score >= known[i]
                alive, score = alive[near], score[near]
            if len(alive) > k:
                last = np.partition(score, len(score) - k)[len(score) - k]
                near = score >= last
                alive, score = alive[near], score[near]
                if exact:
                    known[i] = max(known[i], last)
            chosen = np.argsort(-score, kind="stable")[:k]
            yield begin + i, alive[chosen], score[chosen].astype(np.int64)


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query row, ties to the smaller id.

    ``is_query`` chooses the queries among the rows. Queries come in blocks of
    bounded size, vectors in shards of bounded size, and each block meets each
    shard once; a shard gives k + 1 rows for each query at most. The shards
    that a block meets in one task pass on the score to beat. Null vectors and
    those with a null or non-finite component take no part; missing components
    count as 0; an empty table gives an empty result. Every row but the
    query's own is a candidate: rows with repeated ids are candidates each,
    also of each other, and each query row has a ranking of its own. A row
    without an id ranks before others of its score.
    """
    rows = quantised(vectors.withColumn("_query", F.coalesce(is_query, F.lit(False))), id_col, vector_col, scale, "_query")
    # equal query rows have equal rankings: each of them lacks one row of these values
    asked = rows.filter("_query").groupBy("id", "v").agg(F.count("*").alias("copies"))
    queries, n_blocks = blocks(asked, QUERY_ROWS, "block")
    shards, n_shards = blocks(rows.select("id", "v"), SHARD_ROWS, "shard")
    # enough tasks for the cluster; beyond that, shards share a task and its scores to beat
    lanes = min(n_shards, -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // n_blocks))
    dealt = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("lane", F.col("shard") % lanes)
    meets = queries.select("block", F.col("rows").alias("queries")).join(dealt, "block")
    spread = meets.repartition(n_blocks * lanes, "block", "lane").select("block", "queries", "rows")

    def run(batches):
        beat: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, asked, part = batch.column("block")[i].as_py(), batch.column("queries")[i].values, batch.column("rows")[i].values
                width = max(np.diff(p.field("v").offsets.to_numpy()).max(initial=0) for p in (asked, part))
                wanted, given = matrix(asked.field("v"), width), matrix(part.field("v"), width)
                known = beat.setdefault(block, np.full(len(asked), -np.inf))
                results = list(best(wanted, given, k + 1, known))
                at = np.repeat([r[0] for r in results], [len(r[1]) for r in results])
                found = np.concatenate([r[1] for r in results])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), block, np.int32)), pa.array(at.astype(np.int32)), asked.field("id").take(pa.array(at)),
                     asked.field("copies").take(pa.array(at)), pa.array(np.square(wanted).sum(1)[at]), part.field("id").take(pa.array(found)),
                     pa.array(np.concatenate([r[2] for r in results]))],
                    ["block", "at", "query_id", "copies", "own", "vec_id", "score"])

    found = spread.mapInArrow(run, "block int, at int, query_id long, copies long, own long, vec_id long, score long")
    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    # the query's own row is told by its values; where it is not among these rows, the last one is too many
    is_own = F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("own"))
    own = F.min(F.when(is_own, F.col("place"))).over(Window.partitionBy("block", "at"))
    placed = ranked.withColumn("_own", F.coalesce(own, F.lit(k + 1))).filter(F.col("place") != F.col("_own"))
    return placed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "query_id", (F.col("place") - (F.col("place") > F.col("_own")).cast("int")).alias("rank"), "vec_id", "score")


def op7_vector_search(vectors: DataFrame) -> DataFrame:
    """The contract's columns: 20 best rows of each row whose vec_id is divisible by 20."""
    return search(vectors, F.col("vec_id") % 20 == 0, 20)
