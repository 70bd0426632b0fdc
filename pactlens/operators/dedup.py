"""Near-duplicate removal that keeps the first of each family.

Similarity is the exact Jaccard index of word shingles. Candidate rows meet in
buckets of shared rare shingles (prefix filter). A fixed number of rounds first
compares rows with the ones that lead all their buckets, which settles families
of copies in linear work. The rest is joined inside its buckets under a bound
on the symmetric difference that only truly similar rows pass, and the keep-first
rounds then run over verified links, so that rows which merely share text
never wait for each other. A bucket of very many rows is cut into tiles by
their size, and tile meets tile in tasks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens import domain as D
from pactlens.functions.text import is_blank, shingle_hashes
from pactlens.session import cut_lineage


def shingle_sets(rows: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, shingles) with sorted 64-bit shingle hashes; rows without words are dropped."""
    worded = rows.select(id_col, text).filter(~is_blank(F.col(text)))
    return worded.select(
        F.col(id_col).alias("id"), shingle_hashes(F.col(text)).alias("shingles"))


def collapse_copies(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with equal shingle sets -> (first row of each set, id -> first_id of the rest)."""
    keyed = cut_lineage(sets)
    keys = keyed.select(
        "id", F.sha2(F.array_join(F.col("shingles"), ","), 256).alias("set_key"))
    first = keys.groupBy("set_key").agg(F.min("id").alias("first_id"))
    copies = keys.join(first, "set_key").filter("id <> first_id").select("id", "first_id")
    firsts = keyed.join(first.select(F.col("first_id").alias("id")), "id", "left_semi")
    return firsts.withColumn("n", F.size("shingles")), copies


def rare_first(sets: DataFrame) -> DataFrame:
    """Shared shingles of each row, rarest first: (id, n, skipped, shared).

    ``skipped`` counts the shingles no other row has; they come first in the
    global order and can never produce a candidate.
    """
    # a row holds a token once, so no token has more rows than there are sets; they move by token a single time.
    # explode() would filter the sets below their shuffle, which then served no one else
    frequency = F.count("*").over(Window.partitionBy("token"))
    tokens = sets.select("id", F.explode_outer("shingles").alias("token")).withColumn("df", frequency).filter(
        "df > 1 AND token IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct("df", "token")))
    shared = tokens.groupBy("id").agg(ordered.alias("pairs")).select(
        "id", F.transform("pairs", lambda p: p["token"]).alias("shared"))
    return sets.select("id", "n").join(shared, "id").withColumn("skipped", F.col("n") - F.size("shared"))


def prefixes_of(ordered: DataFrame, threshold: float) -> DataFrame:
    """(id, n, skipped, indexing, prefix): the rows with a shared token in their rare prefix."""
    slack = 1e-9
    probing = F.col("n") - F.ceil(F.col("n") * threshold - slack).cast("int") + 1
    indexing = F.col("n") - F.ceil(
        F.col("n") * (2 * threshold / (1 + threshold)) - slack).cast("int") + 1
    kept = F.greatest(probing - F.col("skipped"), F.lit(0))
    return ordered.select(
        "id", "n", "skipped", indexing.alias("indexing"), F.slice("shared", F.lit(1), kept).alias("prefix")).filter(F.size("prefix") > 0)


def prefix_members(prefixes: DataFrame) -> DataFrame:
    """(token, id, n, place, indexes): the rare prefix of each row.

    Two rows at or above the threshold share a token in the longer probing
    prefix of the larger row and the shorter indexing prefix of the smaller.
    """
    return (
        prefixes.select("id", "n", "skipped", "indexing", F.posexplode("prefix").alias("pos", "token"))
        .select("token", "id", "n", (F.col("skipped") + F.col("pos")).alias("place"), "indexing")
        .withColumn("indexes", F.col("place") < F.col("indexing"))
        .drop("indexing")
    )


def _jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _can_match(threshold: float) -> Column:
    """Size, role and position bounds between ``left`` and ``right`` members."""
    left, right = F.col("left.n"), F.col("right.n")
    small, large = F.least(left, right), F.greatest(left, right)
    small_indexes = F.when(left < right, F.col("left.indexes")).when(
        right < left, F.col("right.indexes")).otherwise(
        F.col("left.indexes") | F.col("right.indexes"))
    room = F.least(left - F.col("left.place"), right - F.col("right.place"))
    needed = (left + right) * (threshold / (1 + threshold)) - 1e-9
    return (small >= large * threshold - 1e-9) & small_indexes & (room >= needed)


def _live_members(members: DataFrame) -> DataFrame:
    """Members of buckets in which at least one other row could match."""
    buckets = members.groupBy("token").agg(
        F.count("*").alias("size"), F.count_if("indexes").alias("indexed"))
    live = buckets.filter("size > 1 AND indexed > 0").select("token")
    return members.join(live, "token", "left_semi")


LEADER_ROUNDS = 2
TILE_ROWS = 4096  # members of a bucket that one task compares with as many others
BITMAP_WORDS = 4


def _bitmap(shingles: Column) -> Column:
    """Parity of the shingles that fall on each of 256 bits."""
    def word(k: int) -> Column:
        return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, x: F.when(
            F.shiftright(x, 6).bitwiseAND(BITMAP_WORDS - 1) == k,
            acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int")))).otherwise(acc))

    return F.struct(*[word(k).alias(f"w{k}") for k in range(BITMAP_WORDS)])


def _near_bitmaps(threshold: float) -> Column:
    """Bits in which two bitmaps differ are a lower bound of the symmetric difference."""
    differ = sum((F.bit_count(F.col(f"left.bits.w{k}").bitwiseXOR(F.col(f"right.bits.w{k}"))) for k in range(BITMAP_WORDS)), F.lit(0))
    return differ <= (F.col("left.n") + F.col("right.n")) * ((1 - threshold) / (1 + threshold)) + 1e-9


def _verify(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """(id, keeper_id) candidates -> those that reach the threshold, with their ``jaccard``."""
    return (
        pairs.join(shingles.withColumnRenamed("shingles", "own"), "id")
        .join(shingles.select(F.col("id").alias("keeper_id"), F.col("shingles").alias("other")), "keeper_id")
        .select("id", "keeper_id", _jaccard(F.col("own"), F.col("other")).alias("jaccard"))
        .filter(F.col("jaccard") >= threshold))


def _first_hits(scored: DataFrame) -> DataFrame:
    return scored.groupBy("id").agg(
        F.min_by(F.struct("keeper_id", "jaccard"), "keeper_id").alias("hit")).select("id", "hit.*")


def _passing(threshold: float) -> Column:
    return _can_match(threshold) & _near_bitmaps(threshold)


def _meet(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(id, keeper_id) of members that share a bucket and pass all bounds."""
    return left.alias("left").join(
        right.alias("right"),
        (F.col("left.token") == F.col("right.token")) & (F.col("right.id") < F.col("left.id")) & _passing(threshold)
    ).select(F.col("left.id").alias("id"), F.col("right.id").alias("keeper_id")).distinct()


def tiles_of(members: DataFrame, tile_rows: int) -> DataFrame:
    """``members`` with ``tile``: the members of each bucket in runs of rising size, about ``tile_rows`` each.

    Runs are found from the number of members of each size, so a bucket is
    never ranked in one task; members of one size are dealt out by their id.
    """
    sizes = members.groupBy("token", "n").agg(F.count("*").alias("c"))
    before = Window.partitionBy("token").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.select("token", "n", F.floor(F.coalesce(F.sum("c").over(before), F.lit(0)) / tile_rows).alias("base"),
                        F.ceil(F.col("c") / tile_rows).alias("span"))
    return members.join(runs, ["token", "n"]).withColumn(
        "tile", (F.col("base") + F.pmod(F.xxhash64("id"), F.col("span"))).cast("int")).drop("base", "span")


def _meet_in_tiles(members: DataFrame, threshold: float, tile_rows: int) -> DataFrame:
    """``_meet`` of a set of members with itself, for buckets too large for one task.

    Tile meets tile, each pair of tiles once and in a task of its own; pairs
    whose sizes are too far apart don't meet at all.
    """
    tiled = tiles_of(members, tile_rows)
    edges = tiled.groupBy("token", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    small, large = edges.alias("small"), edges.alias("large")
    pairs = small.join(large, (F.col("small.token") == F.col("large.token")) & (F.col("small.tile") <= F.col("large.tile"))
                       & (F.col("small.high") >= F.col("large.low") * threshold - 1e-9)).select(
        F.col("small.token").alias("token"), F.col("small.tile").alias("a"), F.col("large.tile").alias("b"))
    left = tiled.withColumnRenamed("tile", "a").join(pairs, ["token", "a"])
    right = tiled.withColumnRenamed("tile", "b").join(pairs, ["token", "b"])
    same = (F.col("left.token") == F.col("right.token")) & (F.col("left.a") == F.col("right.a")) & (F.col("left.b") == F.col("right.b"))
    once = (F.col("left.a") < F.col("left.b")) | (F.col("left.id") > F.col("right.id"))
    return left.alias("left").join(right.alias("right"), same & once & (F.col("left.id") != F.col("right.id")) & _passing(threshold)).select(
        F.greatest("left.id", "right.id").alias("id"), F.least("left.id", "right.id").alias("keeper_id")).distinct()


def _links(members: DataFrame, shingles: DataFrame, threshold: float, tile_rows: int) -> DataFrame:
    """Verified pairs (id, keeper_id, jaccard) of all members."""
    hot = members.groupBy("token").agg(F.count("*").alias("size")).filter(F.col("size") > tile_rows).select("token")
    hot = cut_lineage(hot)
    if hot.isEmpty():
        met = _meet(members, members, threshold)
    else:
        cold = members.join(hot, "token", "left_anti")
        met = _meet(cold, cold, threshold).unionByName(
            _meet_in_tiles(members.join(hot, "token", "left_semi"), threshold, tile_rows)).distinct()
    return cut_lineage(_verify(met, shingles, threshold))


def _leader_round(members: DataFrame, shingles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(hits, open members) after the rows that lead all of their buckets are kept."""
    # the first row a member has to wait for: an indexing one, or any if it indexes itself
    bucket = members.groupBy("token").agg(
        F.min("id").alias("first_any"),
        F.min(F.when(F.col("indexes"), F.col("id"))).alias("first_indexed"))
    waits = members.join(bucket, "token").groupBy("id").agg(F.every(
        F.col("id") <= F.when(F.col("indexes"), F.col("first_any"))
        .otherwise(F.coalesce("first_indexed", F.col("id")))).alias("is_first"))
    kept = waits.filter("is_first").select("id")
    open_members = members.join(kept, "id", "left_anti")
    found = _meet(open_members, members.join(kept, "id", "left_semi"), threshold)
    hits = cut_lineage(_first_hits(_verify(found, shingles, threshold)))
    return hits, cut_lineage(_live_members(open_members.join(hits.select("id"), "id", "left_anti")))


def _settle_links(links: DataFrame) -> DataFrame:
    """Hits of the keep-first scan over verified links (id, keeper_id, jaccard), ``keeper_id`` being the earlier row.

    A round keeps the rows without an open earlier neighbour and drops their
    neighbours; rounds follow the longest chain of similar rows.
    """
    hits = links.limit(0)
    while not links.isEmpty():
        later = links.select(F.col("id").alias("keeper_id"))
        gone = cut_lineage(_first_hits(links.join(later, "keeper_id", "left_anti")))
        hits = hits.unionByName(gone)
        dropped = gone.select("id")
        links = cut_lineage(links.join(dropped, "id", "left_anti").join(
            dropped.withColumnRenamed("id", "keeper_id"), "keeper_id", "left_anti"))
    return hits


def near_duplicates(
    rows: DataFrame, id_col: str = "id", text: str = "text",
    threshold: float = D.NEAR_DUPLICATE_JACCARD,
) -> DataFrame:
    """Greedy keep-first scan in id order: (id, keeper_id, jaccard).

    One row per dropped row, with a kept earlier row it is similar to. Only
    emptiness checks reach the driver; lineage is cut by reliable checkpoints.
    """
    sets = shingle_sets(rows, id_col, text)
    firsts, copies = collapse_copies(sets)
    # of a row's shared shingles only the prefix is written; its set is written with it, which moves all sets by id once
    held = cut_lineage(prefixes_of(rare_first(firsts), threshold).join(firsts.select("id", "shingles"), "id"))
    prefixes = cut_lineage(_live_members(prefix_members(held)))
    shingles = cut_lineage(held.select("id", "shingles").join(prefixes.select("id").distinct(), "id", "left_semi"))
    members = cut_lineage(prefixes.join(shingles.select("id", _bitmap(F.col("shingles")).alias("bits")), "id"))
    dropped = rows.sparkSession.createDataFrame([], "id long, keeper_id long, jaccard double")
    for _ in range(LEADER_ROUNDS):
        hits, members = _leader_round(members, shingles, threshold)
        dropped = dropped.unionByName(hits)
    dropped = dropped.unionByName(_settle_links(_links(members, shingles, threshold, TILE_ROWS)))
    fate = copies.join(dropped.withColumnRenamed("id", "first_id"), "first_id", "left")
    return dropped.unionByName(fate.select(
        "id", F.coalesce("keeper_id", "first_id").alias("keeper_id"),
        F.coalesce("jaccard", F.lit(1.0)).alias("jaccard")))


def keep_first(
    rows: DataFrame, id_col: str = "id", text: str = "text",
    threshold: float = D.NEAR_DUPLICATE_JACCARD,
) -> DataFrame:
    """Rows that survive the near-duplicate scan; rows without words are dropped."""
    worded = rows.filter(~is_blank(F.col(text)))
    gone = near_duplicates(rows, id_col, text, threshold).select(F.col("id").alias(id_col))
    return worded.join(gone, id_col, "left_anti")
