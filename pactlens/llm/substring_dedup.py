"""Substring dedup by relative Lempel-Ziv parsing.

A window is a run of ``WINDOW`` words. Every window belongs to the anchor with
the least hash among its runs of ``ANCHOR`` words, so equal windows have equal
anchors, and the windows of a text fall into short segments of one anchor each.
Segments whose anchor occurs once in the corpus hold nothing that repeats.

The different segments of all other anchors are the reference. It is dealt
into blocks by anchor: whatever a segment may repeat lies in its own block,
so that parsing it against that block is parsing it against every block. A
block is indexed by a suffix array, and its segments are factored greedily:
a factor is the longest match that starts elsewhere in the block. Factors of a
window's length at least become duplicate spans; parsing goes on at the first
window that crosses the factor's end.

An anchor that very many different segments share (a passage in very many
contexts) would make a block of unbounded size. Its windows are dealt out by
their own hashes instead and counted, which is exact as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.texts import mix, seeds, slices
from pactlens.session import cut_lineage, fresh_path

WINDOW = 35  # words that must repeat
ANCHOR = 12  # words of an anchor
SEGMENT = 64  # windows of a segment at most, bits of a mask
HOT = 4096  # different segments of one anchor from which on its windows are dealt out one by one
BLOCK_WORDS = 1 << 20  # words of a block of the reference, about
SLICE = 1 << 20  # bytes of text that are parsed together

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTE = seeds(256, 21)
_LOW, _HIGH = seeds(1 << 16, 22), seeds(1 << 16, 23)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of many texts, and each text's offset in them; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = ~_BLANK[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(raw)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    offsets = np.searchsorted(starts, ends)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), offsets
    turn = np.cumsum(begins[at]) - 1
    place = at - starts[turn]
    value = _BYTE[raw[at]] * (_LOW[place & 0xFFFF] + _HIGH[(place >> 16) & 0xFFFF])
    lengths = np.bincount(turn).astype(np.uint64)
    return mix(np.add.reduceat(value, np.flatnonzero(begins[at])) + lengths), offsets


def prefix_sums(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``word * base ** place`` before every place, and the inverse powers."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(word), _BASE, np.uint64))
        back = np.cumprod(np.full(len(word), _BACK, np.uint64))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * powers, dtype=np.uint64)]), back


def run_hash(sums: np.ndarray, back: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hash of the ``size`` words from ``start`` on."""
    return mix((sums[start + size] - sums[start]) * back[start] + np.asarray(size).astype(np.uint64))


def segments(word: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """(text, first window, windows, anchor, segment hash, inner) of all segments, in order of texts.

    ``inner`` tells whether the anchor stands in its segment more than once.
    """
    count = np.maximum(np.diff(offsets) - window + 1, 0)
    if not count.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    sums, back = prefix_sums(word)
    grams = least = run_hash(sums, back, np.arange(len(word) - anchor + 1), anchor)
    # sliding minimum over the anchors of a window
    span, have = window - anchor + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    value = least[offsets[text] + place]
    new = np.ones(len(text), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    runs = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    new |= (np.arange(len(text)) - runs[run]) % SEGMENT == 0
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(text)))
    start = offsets[text[at]] + place[at]
    each = size + window - anchor
    held = np.cumsum(each) - each
    inside = np.arange(held[-1] + each[-1]) - np.repeat(held - start, each)
    inner = np.add.reduceat(grams[inside] == np.repeat(value[at], each), held, dtype=np.int64) > 1
    return text[at], place[at], size, value[at], run_hash(sums, back, start, size + window - 1), inner


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, k1, k2); the keys tell rows apart by id and whole text."""
    identity = [F.col(id_col).cast("string"), F.col(id_col).isNull(), F.col(text_col)]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(*identity).alias("k1"), F.xxhash64(F.lit(1), *identity).alias("k2"))


def occurrences(rows: DataFrame, window: int, anchor: int, placed: bool) -> DataFrame:
    """(anchor, segment) of all segments, with (k1, k2, first, size) where ``placed``, else with ``inner``."""
    names = ["anchor", "segment"] + (["k1", "k2", "first", "size"] if placed else ["inner"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=SLICE):
                text, first, size, value, hashed, inner = segments(*word_hashes(part.column("text")), window, anchor)
                columns = [pa.array(value.view(np.int64)), pa.array(hashed.view(np.int64))]
                if placed:
                    at = pa.array(text)
                    columns += [part.column("k1").take(at), part.column("k2").take(at), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))]
                else:
                    columns.append(pa.array(inner))
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "anchor long, segment long" + (", k1 long, k2 long, first int, size int" if placed else ", inner boolean")
    return rows.select("text", *(["k1", "k2"] if placed else [])).mapInArrow(run, kinds)


def shared_segments(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """Segments of the anchors that occur more than once: (k1, k2, first, size, anchor, segment, several).

    ``several`` tells whether the anchor has different segments, or stands in
    one of them more than once; if not, all its segments repeat as a whole.
    """
    counted = occurrences(rows, window, anchor, False).groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"),
        F.max("inner").alias("inner"))
    shared = cut_lineage(counted.filter("n > 1 OR inner").select("anchor", (F.col("inner") | (F.col("low") != F.col("high"))).alias("several")))
    path = fresh_path(rows.sparkSession, "segments")
    occurrences(rows, window, anchor, True).join(shared, "anchor").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def suffix_ranks(word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes by their first 128 words, and the ranks of their runs of 1, 2, 4 .. 64 words."""
    n = len(word)
    ranks = [np.unique(word, return_inverse=True)[1].astype(np.int64)]
    for level in range(7):
        step = 1 << level
        follow = np.zeros(n, np.int64)
        follow[:-step or n] = ranks[-1][step:] + 1 if step < n else 0
        pair = ranks[-1] * (n + 1) + follow
        if level == 6:
            return np.argsort(pair, kind="stable"), ranks
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
    raise AssertionError


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words (127 at most) that the suffixes at ``a`` and ``b`` share."""
    n = len(ranks[0])
    length = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[level][x[inside]] == ranks[level][y[inside]]
        length += same << level
    return length


def factor_lengths(word: np.ndarray) -> np.ndarray:
    """For every place of a block the length of the longest match that starts at another place."""
    order, ranks = suffix_ranks(word)
    near = common_prefix(ranks, order[:-1], order[1:])
    out = np.zeros(len(word), np.int64)
    out[order[1:]] = near
    out[order[:-1]] = np.maximum(out[order[:-1]], near)
    return out


def parse_block(word: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A mask for every segment of a block: bit i is set where its window i starts elsewhere in the block too.

    ``word`` holds all segments one after the other, ``ends`` their ends. All
    segments are parsed side by side, one factor of each at a time.
    """
    sizes = np.diff(ends, prepend=0)
    # a word of its own after every segment, so that no match leaves a segment
    separate = mix(np.arange(len(ends), dtype=np.uint64) ^ np.uint64(0x5EED << 40))
    length = factor_lengths(np.insert(word, ends, separate))
    begin = ends - sizes + np.arange(len(ends))
    windows = sizes - window + 1
    masks = np.zeros(len(ends), np.uint64)
    cursor = np.zeros(len(ends), np.int64)
    active = np.flatnonzero(windows > 0)
    while len(active):
        factor = length[begin[active] + cursor[active]]
        whole = np.maximum(factor - window + 1, 0)  # windows inside the factor
        low = cursor[active].astype(np.uint64)
        bits = np.where(whole >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(whole, 63).astype(np.uint64)) - np.uint64(1))
        masks[active] |= bits << low
        # the next window crosses the end of the factor, or starts after a word that no factor holds
        cursor[active] += np.maximum(whole, 1)
        active = active[cursor[active] < windows[active]]
    return masks


def all_windows(size: str) -> Column:
    """Mask with a bit for each window of a whole segment."""
    return F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(SEGMENT) - F.col(size))


def cut_out(rows: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(anchor, segment, word) of the segments in ``asked``, which holds (k1, k2, wanted); window hashes where one is hot."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=SLICE):
                word, offsets = word_hashes(part.column("text"))
                wanted = part.column("wanted")
                each = np.diff(wanted.offsets.to_numpy()) if len(wanted) else np.zeros(0, np.int64)
                flat = wanted.flatten()
                text = np.repeat(np.arange(len(each)), each)
                first, size = flat.field("first").to_numpy(), flat.field("size").to_numpy()
                hot = flat.field("hot").to_numpy(zero_copy_only=False)
                start = offsets[text] + first
                sums, back = prefix_sums(word)
                made = np.where(hot, size, size + window - 1)
                ends = np.cumsum(made)
                at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - made, made) + np.repeat(start, made)
                value = word[at]
                spread = np.repeat(hot, made)
                if spread.any():
                    value[spread] = run_hash(sums, back, at[spread], window)
                yield pa.RecordBatch.from_arrays([
                    flat.field("anchor"), flat.field("segment"), flat.field("hot"),
                    pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), value.view(np.int64))],
                    ["anchor", "segment", "hot", "word"])

    # doc_id goes along so that this reads the very exchange that the last step reads
    joined = rows.join(asked, ["k1", "k2"]).select("doc_id", "text", "wanted")
    return joined.mapInArrow(run, "anchor long, segment long, hot boolean, word array<long>")


def block_masks(reference: DataFrame, blocks: int, window: int) -> DataFrame:
    """(anchor, segment, mask) of the reference's segments, block by block."""
    def run(block: pa.Table) -> pa.Table:
        words = block.column("word").combine_chunks()
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)).astype(np.int64)
        masks = parse_block(words.flatten().to_numpy().view(np.uint64), ends, window)
        return pa.table({"anchor": block.column("anchor"), "segment": block.column("segment"), "mask": masks.view(np.int64)})

    dealt = reference.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, "anchor long, segment long, mask long")


def spread_masks(hot: DataFrame) -> DataFrame:
    """(anchor, segment, mask) of hot anchors' segments, their windows counted by hash; ``word`` holds those hashes."""
    windows = hot.select("anchor", "segment", F.posexplode("word").alias("i", "window"))
    twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "window")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))
    return windows.join(twice, ["anchor", "window"]).groupBy("anchor", "segment").agg(F.bit_or(bit).alias("mask"))


def duplicate_windows(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, spans): for each row with repeated windows an array of (first, mask)."""
    spark = rows.sparkSession
    met = shared_segments(rows, window, anchor)
    mixed = met.filter("several")
    reference = cut_lineage(mixed.groupBy("anchor", "segment").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "size")).alias("r")))
    hot = cut_lineage(reference.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot")))
    asked = reference.join(hot, "anchor", "left").groupBy("r.k1", "r.k2").agg(F.collect_list(F.struct(
        "anchor", "segment", F.col("r.first").alias("first"), F.col("r.size").alias("size"), F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    asked = cut_lineage(asked)
    total = reference.agg(F.sum(F.col("r.size") + (window - 1))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_WORDS))
    pieces = cut_out(rows, asked, window)
    masks = block_masks(pieces.filter("NOT hot"), blocks, window).unionByName(spread_masks(pieces.filter("hot")))
    known = reference.select("anchor", "segment", "n", F.col("r.size").alias("size")).join(masks, ["anchor", "segment"], "left").select(
        "anchor", "segment", F.when(F.col("n") > 1, all_windows("size")).otherwise(F.col("mask")).alias("mask")).filter("mask <> 0")
    repeated = mixed.join(known, ["anchor", "segment"]).select("k1", "k2", "first", "mask")
    whole = met.filter("NOT several").select("k1", "k2", "first", all_windows("size").alias("mask"))
    return whole.unionByName(repeated).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))


def covered(first: np.ndarray, mask: np.ndarray, words: int, window: int) -> np.ndarray:
    """Which of ``words`` words the marked windows cover."""
    bit = (mask.view(np.uint64)[:, None] >> np.arange(SEGMENT, dtype=np.uint64)[None, :]) & np.uint64(1)
    segment, place = np.nonzero(bit)
    start = first[segment] + place
    step = np.zeros(words + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + window, -1)
    return np.cumsum(step)[:words] > 0


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
                 keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_sha256[, kept]), one row for each row of ``docs``.

    Every word goes that a window covers whose words also start anywhere else,
    in the same text or another. ``spans`` are the removed runs of words, end
    exclusive; ``kept`` holds the other words joined by a blank. A null text
    has no words; a text shorter than a window keeps all; repeated rows repeat
    each other and lose every window; other columns are left out; an empty
    table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    joined = rows.join(duplicate_windows(rows, window, anchor), ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=SLICE):
                yield finish(part)

    def finish(part: pa.RecordBatch) -> pa.RecordBatch:
        spans = part.column("spans")
        flat = spans.flatten()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
        first, mask = flat.field("first").to_numpy(), flat.field("mask").to_numpy()
        n_words, n_removed, cuts, hashes, texts, low = [], [], [], [], [], 0
        for text, high in zip(part.column("text").cast(pa.binary()).to_pylist(), ends.tolist(), strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            removed = []
            if high > low:
                gone = covered(first[low:high].astype(np.int64), mask[low:high], len(words), window)
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                removed = list(zip(edges[::2], edges[1::2], strict=True))
                kept_edges = [0, *edges, len(words)]
                words = [w for a, b in zip(kept_edges[::2], kept_edges[1::2], strict=True) for w in words[a:b]]
            low = high
            n_removed.append(n_words[-1] - len(words))
            cuts.append([{"start": a, "end": b} for a, b in removed])
            kept = b" ".join(words)
            hashes.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if keep_text else None)
        columns = {
            "doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept_sha256": pa.array(hashes, pa.string())}
        if keep_text:
            columns["kept"] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_pydict(columns)

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept_sha256 string"
                             + (", kept string" if keep_text else ""))


def op11_substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, one row per document."""
    return drop_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
