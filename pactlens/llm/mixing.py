"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source are permuted by a hash and cut into blocks. Targets
give each source an exact quota of blocks, counting repeats. A tree splits the
quotas recursively among the output shards; every node draws its left part
from a multivariate hypergeometric distribution, so each shard gets its exact
number of blocks and no block is given twice. Only counts for each block pass
through the driver; the documents are joined with their block's copies and
sorted inside their shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.session import cut_lineage, fresh_path

SOURCE_BLOCKS = 1024  # blocks of a source; a source of any size has at most as many
FINE_BLOCKS = 1024  # parts of a block, in one of which the last document of a source is cut
MAX_REPEATS = 3
SEED = 17
CYCLE = (5.0, 2.0, 1.0)  # weights of the sources in code-point order, repeating
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII blanks; null has none."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.coalesce(F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]++"))), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, most: float = MAX_REPEATS) -> dict:
    """Words to take of each source: shares of all words by weight, none over ``most`` times its size.

    What a full source can't take is shared again by weight among the others;
    a source without words is full from the start.
    """
    left, open_ = float(sum(sizes.values())), {s for s, n in sizes.items() if n}
    out = {s: 0.0 for s in sizes if s not in open_}
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * weights[s] / total for s in open_}
        out |= {s: most * float(sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def cycled(sources) -> dict:
    """Weights 5, 2, 1, repeating, over the sources by code point with null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: CYCLE[i % len(CYCLE)] for i, s in enumerate(ordered)}


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) blocks of each source in each shard.

    Every shard gets its share of all blocks, give or take one, and the columns
    sum to the quotas exactly.
    """
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    taken = np.zeros(len(quotas), np.int64)
    need, rest = total * left // shards, total
    for i, quota in enumerate(quotas.tolist()):  # the margins of the multivariate distribution, one by one
        rest -= quota
        taken[i] = rng.hypergeometric(quota, rest, need) if need and quota else 0
        need -= int(taken[i])
    return np.concatenate([split_quotas(taken, left, rng), split_quotas(quotas - taken, shards - left, rng)])


@dataclass
class Plan:
    """Sizes and targets of the sources, and the copies of every block."""

    sizes: dict
    targets: dict
    copies: list  # (source, block, copy, fine block of the cut, words wanted of that, shard); no cut where all of the block is taken


def permuted(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, keep: tuple = ()) -> DataFrame:
    """(doc_id, text, source, size, place, fine, block, kept): the row's place in its source's permutation and its blocks."""
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"), place.alias("place"),
                       F.struct(F.lit(0), *keep).alias("kept"))
    # the upper bits of the place: blocks are runs of the permutation, and fine blocks are runs of a block
    bits = (SOURCE_BLOCKS * FINE_BLOCKS).bit_length() - 1
    return rows.withColumn("fine", F.shiftrightunsigned("place", 64 - bits).cast("int")).withColumn(
        "block", F.floor(F.col("fine") / FINE_BLOCKS).cast("int"))


def plan_mix(rows: DataFrame, shards: int, seed: int, weights: dict | None = None) -> Plan:
    """Read the size of every block (``SOURCE_BLOCKS`` numbers a source at most) and deal out the copies.

    A source's whole passes come first; the rest of its target is the first
    blocks of its permutation, the last of which is cut so that the words meet
    the target. The cut is found from the sizes of that block's fine blocks
    (``FINE_BLOCKS`` numbers a source at most).
    """
    fine = cut_lineage(rows.groupBy("source", "block", "fine").agg(F.sum("size").alias("words")))
    sized = fine.groupBy("source", "block").agg(F.sum("words").alias("words")).collect()
    by_source: dict = {}
    for r in sorted(sized, key=lambda r: r["block"]):
        by_source.setdefault(r["source"], []).append((r["block"], r["words"]))
    sizes = {s: sum(w for _, w in blocks) for s, blocks in by_source.items()}
    goal = targets(sizes, weights or cycled(sizes))
    ordered = sorted(by_source, key=lambda s: (s is None, s or ""))
    drawn, cuts = [], {}
    for s in ordered:
        blocks = [(block, words) for block, words in by_source[s] if words]  # none where a source has no words
        whole, rest = divmod(round(goal[s]), max(1, sizes[s]))
        copies = [(block, c) for c in range(whole) for block, _ in blocks]
        for block, words in blocks:
            if rest > 0:
                copies.append((block, whole))
                if words > rest:
                    cuts[s] = (block, whole, rest)
                rest -= words
        drawn.append(copies)
    places = cut_places(fine, cuts)
    rng = np.random.default_rng(seed)
    dealt = split_quotas(np.array([len(d) for d in drawn], np.int64), shards, rng) if ordered else []
    copies = []
    for i, s in enumerate(ordered):
        order, at = rng.permutation(len(drawn[i])), 0
        for shard, count in enumerate(dealt[:, i].tolist()):
            for block, copy in (drawn[i][k] for k in order[at:at + count].tolist()):
                cut = places[s] if s in cuts and cuts[s][:2] == (block, copy) else (None, None)
                copies.append((s, block, copy, *cut, shard))
            at += count
    return Plan(sizes, goal, copies)


def cut_places(fine: DataFrame, cuts: dict) -> dict:
    """(fine block, words wanted of it) of each source in ``cuts``, whose values are (block, copy, words wanted of the block)."""
    if not cuts:
        return {}
    kind = fine.schema["source"].dataType.simpleString()
    asked = fine.sparkSession.createDataFrame([(s, block) for s, (block, _, _) in cuts.items()], f"c_source {kind}, c_block int")
    # one row for each source
    found = fine.join(F.broadcast(asked), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block"))).select(
        "source", "fine", "words").collect()
    places = {}
    for r in sorted(found, key=lambda r: r["fine"]):
        left = cuts[r["source"]][2] if r["source"] not in places else places[r["source"]][2]
        if left > 0:
            places[r["source"]] = (r["fine"], left, left - r["words"])
    return {s: place[:2] for s, place in places.items()}


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                shards: int | None = None, seed: int = SEED, weights: dict | None = None, keep: tuple = ()) -> tuple[DataFrame, Plan]:
    """The mix and its plan. The mix has (doc_id, text, source, size, copy, words, shard, place) and the columns in ``keep``.

    There are as many shards as shuffle partitions where no number is given.

    Each row is a copy of a document of which the mix takes the first ``words``
    words: all of them but in the last block of a source. Reruns agree, as the
    permutation is a hash of id and text; repeated rows are taken alike. Null
    sources are a source of their own, texts without words are never taken,
    other columns are left out, and an empty table gives an empty mix.
    """
    rows = permuted(docs, id_col, text_col, source_col, seed, keep)
    plan = plan_mix(rows, shards or partitions(docs), seed, weights)
    spark = docs.sparkSession
    kind = rows.schema["source"].dataType.simpleString()
    copies = spark.createDataFrame(plan.copies, f"c_source {kind}, c_block int, copy int, cut int, wanted long, shard int")
    # at most SOURCE_BLOCKS * MAX_REPEATS rows a source
    near = rows.filter("size > 0").join(F.broadcast(copies), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block")))
    full = near.filter("cut IS NULL OR fine < cut").withColumn("words", F.col("size"))
    before = F.coalesce(F.sum("size").over(
        Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one fine block of each source
    cut = near.filter("fine = cut").withColumn(
        "words", F.greatest(F.lit(0), F.least("size", F.col("wanted") - before))).filter("words > 0")
    columns = ("doc_id", "text", "source", "size", "copy", "words", "shard", "place", *[F.col("kept")[c].alias(c) for c in keep])
    return full.select(*columns).unionByName(cut.select(*columns)), plan


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word."""
    bare = F.split(F.ltrim(text, F.lit(" \t\n\x0b\f\r")), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.array_join(F.slice(bare, 1, words.cast("int")), "")


def partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shuffled(mix: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix with one partition for each shard, in random but repeatable order inside it."""
    return mix.repartitionById(shards or partitions(mix), "shard").sortWithinPartitions(
        F.xxhash64("shard", "place", "copy", "doc_id"))


def written_mix(docs: DataFrame) -> tuple[DataFrame, Plan]:
    """The shuffled mix with its cut texts, written to the shared folder, and its plan."""
    mix, plan = mix_sources(docs)
    cut = F.when(F.col("words") < F.col("size"), first_words(F.col("text"), F.col("words"))).otherwise(F.col("text"))
    path = fresh_path(docs.sparkSession, "mix")
    shuffled(mix.withColumn("text", cut)).drop("words").write.parquet(path)
    return docs.sparkSession.read.parquet(path), plan


def op4_mix_sources(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document; ``taken`` counts the words of the document's texts in the written mix.

    A document outside the mix has 0 words taken; its sizes are those of its source.
    """
    mix, plan = written_mix(docs)
    rows = permuted(docs, "doc_id", "text", "source", SEED).select("doc_id", "source", "size", "place")
    spark = docs.sparkSession
    kind = rows.schema["source"].dataType.simpleString()
    sources = spark.createDataFrame(
        [(s, plan.sizes[s], plan.targets[s]) for s in plan.sizes], f"c_source {kind}, source_size long, target double")
    # one row for each source
    known = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    same = ("place", "doc_id", "source", "size")  # of repeated rows
    drawn = mix.groupBy(*same).agg(F.sum(word_count(F.col("text"))).alias("drawn")).withColumnsRenamed({c: f"d_{c}" for c in same})
    known = known.join(drawn, [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in same], "left")
    # repeated rows share what was drawn of them: whole passes alike, then the cut one from the first row on
    repeats = Window.partitionBy(*same)
    counted = known.withColumns({
        "all": F.count("*").over(repeats) * F.col("size"), "turn": F.row_number().over(repeats.orderBy("place")) - 1})
    rest = F.expr("drawn % all") - F.col("turn") * F.col("size")
    taken = F.expr("drawn div all") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return counted.select(
        "doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), F.when(F.col("drawn") > 0, taken).otherwise(0).cast("long").alias("taken"))
