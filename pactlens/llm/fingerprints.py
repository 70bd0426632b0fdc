"""Document fingerprints by consistent weighted sampling.

Terms are pairs of neighbouring words, weighted by how often they occur. For
each sample, gamma and uniform variates that are hashed from the term turn its
weight into a level and a rank; the term of the least rank is the sample. Two
texts share a sample with a probability equal to the generalised Jaccard
similarity of their weights.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.texts import code_points, counted, mix, seeds, slices, words

SAMPLES = 128
STEP = 1 << 15  # terms that are sampled together, to stay in the processor's cache
EMPTY = 0  # sample of a text without words


def terms(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of word pairs of every text, the first word paired with its start; weights; offsets."""
    word, at = words(points, offsets)
    before = np.zeros(len(word), np.uint64)
    before[1:] = word[:-1]
    first = at[:-1][np.diff(at) > 0]
    before[first] = 0
    return counted(mix(word * np.uint64(3) + before), at)


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2 in the middle of 2**16 equal parts of (0, 1)."""
    x = np.geomspace(1e-4, 40, 1 << 18)
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


GAMMA = _gamma_quantiles()
LOG_GAMMA = np.log(GAMMA)


def samples(term: np.ndarray, log_weight: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Rank and level of each weighted term in one sample."""
    bits = term ^ seed
    bits *= np.uint64(0xBF58476D1CE4E5B9)
    bits ^= bits >> np.uint64(32)
    bits *= np.uint64(0x94D049BB133111EB)
    bits ^= bits >> np.uint64(29)
    part = bits.view(np.uint16).reshape(-1, 4)
    r = GAMMA[part[:, 0]]
    beta = bits.view(np.uint32).reshape(-1, 2)[:, 1].astype(np.float32)
    beta *= np.float32(2.0**-32)
    level = log_weight / r
    level += beta
    np.floor(level, out=level)
    beta -= level
    beta -= np.float32(1)
    beta *= r
    beta += LOG_GAMMA[part[:, 1]]  # log of c, minus r * (level - beta + 1)
    return beta, level


def signatures(term: np.ndarray, weight: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) 16-bit samples."""
    out = np.full((len(offsets) - 1, SAMPLES), EMPTY, np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    # a weighted term of several texts is sampled once
    _, one, same = np.unique(mix(term + weight.astype(np.uint64)), return_index=True, return_inverse=True)
    of, log_weight = term[one], np.log(weight[one].astype(np.float32))
    begin = offsets[full]
    sizes = np.diff(np.append(begin, len(term)))
    rank, level = np.empty(len(of), np.float32), np.empty(len(of), np.float32)
    for k, seed in enumerate(seeds(SAMPLES, 7)):
        for a in range(0, len(of), STEP):
            rank[a:a + STEP], level[a:a + STEP] = samples(of[a:a + STEP], log_weight[a:a + STEP], seed)
        ranks = rank[same]
        hit = np.flatnonzero(ranks == np.repeat(np.minimum.reduceat(ranks, begin), sizes))
        # ties go to the smallest term; terms of a text are in ascending order
        first = hit[np.searchsorted(hit, begin)]
        value = mix(term[first] ^ seed ^ level[same[first]].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[full, k] = np.maximum(value >> np.uint64(48), np.uint64(1))
    return out


def fingerprint(texts: pa.Array) -> np.ndarray:
    """Signatures of whole texts; null counts as empty."""
    points, offsets = code_points(texts)
    return signatures(*terms(points, offsets))


def as_text(signature: np.ndarray) -> list[str]:
    """Four hexadecimal digits a sample."""
    width = signature.shape[1] * 4
    digits = signature.astype(">u2").tobytes().hex()
    return [digits[i:i + width] for i in range(0, len(digits), width)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint), one row for each row of ``docs``.

    Equal texts have equal fingerprints, in repeated rows too. Null texts count
    as empty; texts without words share a fingerprint of their own. Other
    columns are left out; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(as_text(fingerprint(part.column("text"))), pa.string())], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, guest) in partitions by descending id, each followed by the next one's first row as a guest.

    One shuffle of the texts. Quantiles of the ids bound the partitions; the
    first row of each is sent to the one before as well. Only bounds and first
    rows' keys come to the driver, one for each partition.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # null ids come last; equal ids are ordered by their text's hash
    low = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn(
        "key", F.struct((-F.coalesce(F.col("id").cast("decimal(20,0)"), low.cast("decimal(20,0)") - 1)).alias("down"), F.xxhash64("text").alias("tie")))
    bounds = sorted(set(rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []))
    root = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i:i + root] for i in range(0, len(bounds), root)]
    part = F.lit(0)
    if bounds:
        # binary-like search: the run of bounds, then the place in it
        heads = F.array(*[F.lit(r[0]) for r in runs])
        number = F.size(F.filter(heads, lambda h: h <= F.col("id")))
        inside = F.element_at(F.array(*[F.array(*[F.lit(b) for b in r]) for r in runs]), number)
        place = F.when(number == 0, 0).otherwise((number - 1) * root + F.size(F.filter(inside, lambda b: b <= F.col("id"))))
        part = F.lit(len(bounds)) - F.coalesce(place, F.lit(0))
    rows = rows.withColumn("part", part.cast("int"))
    firsts = rows.groupBy("part").agg(F.min("key").alias("key")).orderBy("part").collect()
    if not firsts:
        return rows.select("id", "text", "part", F.lit(False).alias("guest"))
    before = [firsts[i - 1]["part"] for i in range(len(firsts))]  # the first row of all follows the last
    hosts = spark.createDataFrame([(f["part"], b) for f, b in zip(firsts, before, strict=True)], "part int, host int")
    keys = spark.createDataFrame([(f["part"], f["key"]["down"], f["key"]["tie"]) for f in firsts], "part int, down decimal(21,0), tie long")
    known = rows.join(F.broadcast(keys.join(hosts, "part")), "part")
    is_first = (F.col("key.down") == F.col("down")) & (F.col("key.tie") == F.col("tie"))
    dealt = known.select("id", "text", "key", F.explode(F.when(is_first, F.array(
        F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("host").alias("part"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct("part", F.lit(False).alias("guest"))))).alias("to"))
    return dealt.select("id", "text", "key", "to.part", "to.guest").repartitionById(len(bounds) + 1, "part").sortWithinPartitions(
        "guest", "key").select("id", "text", "part", "guest")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first code points of the next one, or all it has."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of each text, of its edited text, and their likeness to each other and to the next document's.

    The next document is the one with the next smaller id, after the last the
    first; a single document follows itself. Equal ids are ordered by their
    text's hash, null ids come last, null texts count as empty, other columns
    are left out, and an empty table gives an empty result.
    """
    def run(batches):
        held = None  # the last row, which waits for its next one
        for batch in batches:
            for part in slices(batch, budget=1 << 18):
                table = pa.Table.from_batches([part] if held is None else [held, part]).combine_chunks().to_batches()[0]
                held = table.slice(table.num_rows - 1)
                if table.num_rows > 1:
                    out = compared(table)
                    if out is not None:
                        yield out

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return in_order(docs, id_col, text_col).mapInArrow(run, schema)


def compared(table: pa.RecordBatch) -> pa.RecordBatch | None:
    """Results of all rows but the last; a row and its next one are neighbours here. Guests get none."""
    texts = [t or "" for t in table.column("text").to_pylist()]
    guest = np.array(table.column("guest").to_pylist())
    own = np.flatnonzero(~guest[:-1])
    if not len(own):
        return None
    changed = [edited(texts[i], texts[i + 1]) for i in own.tolist()]
    both = fingerprint(pa.array(texts + changed, pa.large_string()))
    plain, after = both[:len(texts)], both[len(texts):]
    return pa.RecordBatch.from_arrays([
        table.column("id").take(pa.array(own)), pa.array([len(texts[i]) for i in own.tolist()], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(as_text(plain[own])), pa.array(as_text(after)),
        pa.array(likeness(plain[own], after)), pa.array(likeness(plain[own], plain[own + 1]))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op2_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    return compare_neighbours(docs)
