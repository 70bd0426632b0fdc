"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed for a batch at once. The trees are
grown on a bounded sample of labelled rows and flattened into arrays, which a
vectorised walk scores for all texts of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.texts import code_points, counted, mix, shingles, slices, words

# The fit is bounded by this number of labelled rows; scores cover all documents.
SAMPLE_ROWS = 20000
TREES, DEPTH, RATE = 80, 4, 0.12
BINS = 64
MIN_ROWS, PENALTY = 12, 2.0  # least rows and regularisation of a leaf
ACCEPT = 0.7  # score from which on a text is accepted

FEATURES = (
    "log_chars", "log_words", "letters", "upper", "digits", "blanks", "newlines", "punctuation", "symbols", "beyond_ascii",
    "bars", "exclamations", "word_length", "distinct_words", "top_word", "distinct_pairs", "top_pair", "distinct_lines",
    "line_length", "upper_words", "symbols_a_word", "char_entropy")


def _classes() -> np.ndarray:
    """0 other, 1 upper letter, 2 lower letter, 3 digit, 4 blank, 5 newline, 6 punctuation, 7 symbol, 8 bar, 9 exclamation."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        out[i] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 0
    out[0x3000:] = 2
    for group, chars in ((5, "\n"), (6, ".,;:?'\"()-"), (7, "#$%&*+/<=>@[\\]^_`{}~"), (8, "|"), (9, "!")):
        out[[ord(c) for c in chars]] = group
    return out


_TABLE: list = []


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def repetition(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values and share of the commonest one in each text."""
    _, counts, at = counted(values, offsets)
    n = np.diff(offsets)
    top = np.zeros(len(n))
    full = np.diff(at) > 0
    if full.any():
        top[full] = np.maximum.reduceat(counts, at[:-1][full])
    return ratio(np.diff(at), n), ratio(top, n)


def statistics(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, features) of whole texts."""
    if not _TABLE:
        _TABLE.append(_classes())
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    kinds = _TABLE[0][points]
    per = np.bincount(text * 10 + kinds, minlength=len(n) * 10).reshape(len(n), 10)
    letters = per[:, 1] + per[:, 2]
    word, at = words(points, offsets)
    n_words = np.diff(at)
    distinct_words, top_word = repetition(word, at)
    pair, pair_at = shingles(word, at, 3)
    distinct_pairs, top_pair = repetition(pair, pair_at)
    # lines as runs of code points between newlines, hashed by sums of mixed code points and places
    breaks = kinds == 5
    n_lines = per[:, 5] + (n > 0)
    number = np.cumsum(breaks) - breaks + text  # a new number after each newline and in each text
    line, first = np.unique(number, return_index=True) if len(number) else (number, number)
    value = mix((points.astype(np.uint64) << np.uint64(24)) + (np.arange(len(points)) - np.repeat(first, np.diff(np.append(first, len(points))))).astype(np.uint64)) if len(line) else np.zeros(0, np.uint64)
    value[breaks] = 0
    hashes = np.add.reduceat(value, first) if len(line) else value
    line_at = np.searchsorted(text[first], np.arange(len(n) + 1)) if len(line) else np.zeros(len(n) + 1, int)
    distinct_lines, _ = repetition(hashes, line_at)
    low = per.astype(float)
    share = low / np.maximum(n, 1)[:, None]
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(1)
    beyond = np.bincount(text[points > 127], minlength=len(n))
    return np.column_stack([
        np.log1p(n), np.log1p(n_words), ratio(letters, n), ratio(per[:, 1], letters), ratio(per[:, 3], n), ratio(per[:, 4], n),
        ratio(per[:, 5], n), ratio(per[:, 6], n), ratio(per[:, 7], n), ratio(beyond, n), ratio(per[:, 8], n), ratio(per[:, 9], n),
        ratio(letters, n_words), distinct_words, top_word, distinct_pairs, top_pair, distinct_lines, ratio(n, n_lines),
        ratio(per[:, 1], n_words), ratio(per[:, 7] + per[:, 8] + per[:, 9], n_words), entropy])


@dataclass
class Model:
    """Trees as arrays (tree, node): a node's children are 2n+1 and 2n+2; leaves lie in the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees on the logistic loss; every feature is cut into ``BINS`` bins at its quantiles."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature = np.zeros((TREES, inner), np.int32)
    threshold = np.full((TREES, inner), np.inf)
    value = np.zeros((TREES, leaves))
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = Model(feature, threshold, value, float(np.log(share / (1 - share))))
    if len(y) < 2 * MIN_ROWS or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    score = np.full(len(y), model.start)
    cells = (np.arange(x.shape[1]) * BINS)[None, :] + binned
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        gradient, curvature = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            base, width = 2**depth - 1, x.shape[1] * BINS
            at = ((node - base) * width)[:, None] + cells
            shape = (2**depth, x.shape[1], BINS)
            g, h, n = (np.bincount(at.ravel(), np.repeat(v, x.shape[1]), int(np.prod(shape))).reshape(shape).cumsum(2)
                       for v in (gradient, curvature, np.ones(len(y))))
            total = [v[:, :, -1:] for v in (g, h, n)]
            gain = g**2 / (h + PENALTY) + (total[0] - g)**2 / (total[1] - h + PENALTY) - total[0]**2 / (total[1] + PENALTY)
            gain[(n < MIN_ROWS) | (total[2] - n < MIN_ROWS)] = -1
            for k in range(2**depth):
                f, b = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[t, base + k], threshold[t, base + k] = f, cuts[f][b]
            right = x[np.arange(len(y)), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, curvature, leaves) + PENALTY)
        score += value[t, leaf]
    return model


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row; all rows walk down a tree together."""
    total = np.full(len(x), model.start)
    rows = np.arange(len(x))
    for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        total += value[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str, text_col: str,
                    label_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of their id.

    Of several labels of a document the largest counts; null labels don't.
    """
    known = labels.filter(learnable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rate = min(1.0, 1.5 * SAMPLE_ROWS / max(1, known.count()))
    place = F.xxhash64(F.lit(5), F.col(id_col))
    few = known.filter(F.pmod(place, F.lit(1 << 30)) < rate * (1 << 30)).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label_col).alias("label"))
    chosen = few.orderBy(F.xxhash64(F.lit(5), F.col("id"))).limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = statistics(*code_points(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    rows = texts.select("id", F.col("label").cast("double").alias("label"), "text").mapInArrow(
        run, f"id {texts.schema['id'].dataType.simpleString()}, label double, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(rows.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same rows in the same order, whatever the tasks did
    return x[order], y[order]


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    return fit(*labelled_sample(docs, labels, learnable, id_col, text_col, label_col))


def score_texts(docs: DataFrame, model: Model, columns: dict, text_col: str = "text") -> DataFrame:
    """The named columns with a score, one row for each row of ``docs``.

    ``columns`` maps output names to expressions. Null texts count as empty
    and are scored as such; repeated rows get equal scores; an empty table
    gives an empty result; other columns are left out. Without usable labels
    every score is the same.
    """
    names = [*columns, *([] if text_col in columns else ["_text"])]
    kept = docs.select(*[c.alias(k) for k, c in columns.items()], *([] if text_col in columns else [F.col(text_col).alias("_text")]))
    text_name = text_col if text_col in columns else "_text"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_name):
                score = scores(shared.value, statistics(*code_points(part.column(text_name))))
                out = dict(zip(names, part.columns, strict=True)) | {"score": pa.array(score)}
                out.pop("_text", None)
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("_text").schema)
    return kept.mapInArrow(run, f"{schema}, score double")


def op5_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs, labels, ~held)
    scored = score_texts(docs, model, {"doc_id": F.col("doc_id"), "held_out": held})
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
