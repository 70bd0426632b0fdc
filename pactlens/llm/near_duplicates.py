"""Near-duplicate classes with DartMinHash signatures and banded joining.

The weight of a five-word shingle is its count. Every unit of weight is a
region into which hashed darts are thrown, interval after interval of rising
rank; each dart hits one coordinate, and a coordinate keeps its earliest dart.
The share of equal coordinates estimates the generalised Jaccard similarity.
Texts meet where all coordinates of a band agree; links are verified exactly.

A bucket never emits its pairs. Its members are compared with one hub first;
only members that no link has joined to the hub's component meet the members
of other components, and of these pairs only those come out whose bitmaps
allow the threshold: the bits in which two parity bitmaps differ never exceed
the symmetric difference, so no link is lost. Components are found by label
propagation with pointer jumping over written tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.texts import code_points, counted, mix, seeds, shingles, slices, words
from pactlens.session import cut_lineage, fresh_path

WORDS = 5  # of a shingle
THRESHOLD = 0.8  # generalised Jaccard similarity of a link
BANDS, ROWS = 32, 7  # a pair at the threshold meets in some band with probability 0.9994
BITMAP = 16  # 64-bit words of the parity bitmap
COORDINATES = BANDS * ROWS
DARTS = int(COORDINATES * (np.log(COORDINATES) + 3))  # regions thrown at first; few texts need more
GROUP = 1 << 18  # regions that are thrown at together

# number of darts in a region: Poisson with mean 1, from 16 bits
_POISSON = np.searchsorted(
    np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
_PHI = np.uint64(0x9E3779B97F4A7C15)


def regions(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every unit of weight of every text in ascending order of shingles, and each text's offset.

    As a set, the regions of a text hold its weighted shingles: the similarity
    of two sets is the generalised Jaccard similarity of the weights.
    """
    value, count, at = counted(*shingles(*words(points, offsets), WORDS))
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    ends = np.concatenate([[0], np.cumsum(count)])
    return mix(np.repeat(value, count) + level.astype(np.uint64) * _PHI), ends[at]


def throw(region: np.ndarray, interval: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of (region, interval) pairs: position of the pair, rank, hash."""
    pair = mix(region ^ (interval.astype(np.uint64) + np.uint64(1)) * _PHI)
    number = _POISSON[pair & np.uint64(0xFFFF)]
    at = np.repeat(np.arange(len(pair)), number)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(number, dtype=np.int64) - number, number)
    dart = mix(pair[at] + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
    rank = (interval[at].astype(np.uint64) << np.uint64(32)) | (dart >> np.uint64(32))
    return at, rank, dart


def signatures(region: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) hash of the earliest dart of each coordinate; 0 where a text has no region."""
    n = len(offsets) - 1
    weight = np.diff(offsets)
    least = np.full(n * COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    kept = np.zeros(n * COORDINATES, np.uint64)
    begin = np.zeros(n, np.int64)  # the next interval of each text
    active = np.flatnonzero(weight)
    while len(active):
        steps = -(-DARTS // weight[active])
        load = np.cumsum(weight[active] * steps)
        for part in np.split(active, np.searchsorted(load, np.arange(GROUP, load[-1], GROUP))):
            if not len(part):
                continue
            steps = -(-DARTS // weight[part])
            text = np.repeat(part, weight[part])
            at = np.arange(len(text)) - np.repeat(np.cumsum(weight[part]) - weight[part], weight[part]) + offsets[text]
            each = np.repeat(steps, weight[part])
            which = np.repeat(np.arange(len(text)), each)
            interval = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each) + begin[text[which]]
            hit, rank, dart = throw(region[at[which]], interval)
            cell = text[which[hit]] * COORDINATES + (((dart & np.uint64(0xFFFFFFFF)) * np.uint64(COORDINATES)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(least, cell, rank)
            first = least[cell] == rank
            kept[cell[first]] = dart[first]
            begin[part] += steps
        # coordinates that no dart has hit need later intervals, whose ranks are higher
        active = active[(kept.reshape(n, COORDINATES)[active] == 0).any(1)]
    return kept.reshape(n, COORDINATES)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys; equal where all coordinates of the band agree."""
    parts = signature.reshape(len(signature), BANDS, ROWS) * (seeds(ROWS, 11) | np.uint64(1))
    return mix(parts.sum(2, dtype=np.uint64) + seeds(BANDS, 12))


def bitmaps(region: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BITMAP) parity of the regions that fall on each bit."""
    n, bits = len(offsets) - 1, BITMAP * 64
    text = np.repeat(np.arange(n), np.diff(offsets))
    cell = text * bits + (region >> np.uint64(32)).astype(np.int64) % bits
    odd = (np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(content hash, band keys, regions, offsets) of whole texts; texts without words have no band keys."""
    points, offsets = code_points(texts)
    region, at = regions(points, offsets)
    sizes = np.diff(offsets)
    place = np.arange(len(points)) - np.repeat(offsets[:-1], sizes)
    content = np.zeros(len(sizes), np.uint64)
    for values, ends, worded in ((mix((points.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1)), offsets, False), (mix(region), at, True)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        chosen = (np.diff(at) > 0) == worded
        content[chosen] = mix(sums[ends[1:]] - sums[ends[:-1]] + np.diff(ends).astype(np.uint64) * _PHI + np.uint64(worded))[chosen]
    return content, band_keys(signatures(region, at)), region, at


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, node, bands, bits, regions) of every row, written to the shared folder once.

    ``node`` is a 64-bit hash of the weighted shingles, or of the text where it
    has no words; rows with one node are copies.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=1 << 18):
                node, bands, region, at = sketch(part.column("text"))
                worded = np.diff(at) > 0
                ends = np.concatenate([[0], np.cumsum(worded * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_key"), pa.array(node.view(np.int64)),
                    pa.ListArray.from_arrays(ends, bands[worded].view(np.int64).ravel()),
                    pa.ListArray.from_arrays(np.arange(len(node) + 1, dtype=np.int32) * BITMAP, bitmaps(region, at).ravel()),
                    pa.ListArray.from_arrays(at.astype(np.int32), region.astype(np.uint32).view(np.int32))],
                    ["doc_id", "text_key", "node", "bands", "bits", "regions"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    path = fresh_path(docs.sparkSession, "sketches")
    rows.mapInArrow(run, f"doc_id {kind}, text_key long, node long, bands array<long>, bits array<long>, regions array<int>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def shared_bands(rows: DataFrame) -> DataFrame:
    """(key, node, hub): distinct members of the buckets with several nodes, and each bucket's hub.

    The hub is the member that meets most others over all buckets, ties to the
    smaller node: in a group of copies of one text it is the text they all resemble.
    """
    members = rows.select("node", F.explode("bands").alias("key"))
    several = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).filter(
        "low < high").select("key", "size")
    open_ = cut_lineage(members.join(several, "key").groupBy("key", "node").agg(F.max("size").alias("size")))
    met = cut_lineage(open_.groupBy("node").agg(F.sum("size").alias("met")))
    best = open_.join(met, "node").groupBy("key").agg(
        F.max(F.struct("met", (-F.col("node").cast("decimal(20,0)")).alias("order"), "node")).alias("best"))
    hubs = cut_lineage(best.select("key", F.col("best.node").alias("hub")))
    return cut_lineage(open_.select("key", "node").join(hubs, "key"))


def member_sets(rows: DataFrame, met: DataFrame) -> DataFrame:
    """(node, bits, regions) of every node that shares a bucket, written once for all comparisons."""
    asked = cut_lineage(met.groupBy("node").agg(F.count("*").alias("n")).select("node"))
    return cut_lineage(rows.select("node", "bits", "regions").join(asked, "node").groupBy("node").agg(
        F.first(F.struct("bits", "regions")).alias("s")).select("node", "s.bits", "s.regions"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold; ``pairs`` is a written table."""
    left = sets.select(F.col("node").alias("a"), F.col("regions").alias("ra"))
    right = sets.select(F.col("node").alias("b"), F.col("regions").alias("rb"))
    both = pairs.join(left, "a").join(right, "b")
    total = F.size("ra") + F.size("rb")
    # the sizes alone bound the similarity
    able = F.least(F.size("ra"), F.size("rb")) >= threshold * F.greatest(F.size("ra"), F.size("rb"))
    common = F.size(F.array_intersect("ra", "rb"))
    return both.filter(able).filter(common * (1 + threshold) >= total * threshold - 1e-9).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component of every linked node.

    A round takes the smallest label of the neighbours and then follows the
    label's own label, so rounds grow with the logarithm of a component's width.
    """
    edges = cut_lineage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("label")))
    while True:
        heard = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("heard"))
        near = cut_lineage(labels.join(heard, labels["node"] == heard["u"]).select("node", F.least("label", "heard").alias("near"), "label"))
        jump = near.select(F.col("node").alias("near"), F.col("near").alias("far"))
        new = cut_lineage(near.join(jump, "near", "left").select("node", F.least("near", "far").alias("new"), "label"))
        moved = new.filter("new <> label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not moved:
            return labels


def may_link(threshold: float) -> Column:
    """Whether sizes and bitmaps of rows ``x`` and ``y`` allow the threshold."""
    low, high = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    differ = sum((F.bit_count(F.get("x.bits", F.lit(k)).bitwiseXOR(F.get("y.bits", F.lit(k)))) for k in range(BITMAP)), F.lit(0))
    return (low >= threshold * high) & (differ <= (low + high) * ((1 - threshold) / (1 + threshold)) + 1e-9)


def links_of(rows: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b), enough to join every pair of linked nodes that met in a band."""
    met = shared_bands(rows)
    sets = member_sets(rows, met)
    first = cut_lineage(met.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    links = cut_lineage(verified(first, sets, threshold))
    labels = components(links)
    placed = cut_lineage(met.join(labels, "node", "left").select("key", "node", "hub", F.coalesce("label", "node").alias("label")))
    hubs = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    facts = sets.select("node", "bits", F.size("regions").alias("n"))
    lone = placed.join(hubs, "hub", "left").filter(F.col("label") != F.coalesce("hub_label", "hub")).select(
        "key", F.col("node").alias("a"), F.col("label").alias("label_a"))
    x = cut_lineage(lone.join(facts.withColumnRenamed("node", "a"), "a"))
    # bitmaps for the members of the buckets that still hold a lone member
    left = placed.filter("node <> hub").join(cut_lineage(x.select("key").distinct()), "key").select(
        "key", F.col("node").alias("b"), F.col("label").alias("label_b"))
    y = cut_lineage(left.join(facts.withColumnRenamed("node", "b"), "b"))
    more = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("label_a") != F.col("label_b")) & may_link(threshold)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.union(verified(cut_lineage(more), sets, threshold))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, class_id, class_size, keeper), one row for each row of ``docs``.

    A class holds the rows that links of at least ``threshold`` join; its id is
    its smallest document id, which is null only if no member has one.
    ``keeper`` marks the row that stays: the smallest id, then the smallest text hash, for
    repeated rows all of them. Texts with fewer than five words are one
    shingle; null texts count as empty; texts without words are copies where
    they are equal; other columns are left out; an empty table gives an empty
    result.
    """
    rows = sketched(docs, id_col, text_col)
    links = cut_lineage(links_of(rows, threshold))
    labels = components(links)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = cut_lineage(rows.groupBy("node").agg(F.min(first).alias("first"), F.count("*").alias("copies")))
    known = cut_lineage(nodes.join(labels, "node", "left").select(
        "node", "first", "copies", F.coalesce("label", "node").alias("label")))
    classes = cut_lineage(known.groupBy("label").agg(F.min("first").alias("best"), F.sum("copies").alias("class_size")))
    of_node = cut_lineage(known.join(classes, "label").select("node", "best", "class_size"))
    out = rows.select("doc_id", "text_key", "node").join(of_node, "node")
    return out.select(
        "doc_id", "text_key", F.col("best.doc_id").alias("class_id"), "class_size",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))).alias("keeper"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one of each class does."""
    found = near_duplicates(docs, id_col, text_col, threshold).filter("keeper").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text_key").alias("_text")).distinct()
    keyed = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).withColumn("_text", F.xxhash64(F.col(text_col)))
    return keyed.join(found, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).drop("_id", "_text")


def op3_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size, one row per document."""
    return near_duplicates(docs).select("doc_id", "class_id", "class_size")
