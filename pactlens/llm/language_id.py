"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text gives longest matches. A
text is parsed greedily into phrases that occur in the sample; the language
whose automaton needs the fewest phrases a letter, normalised by the sample's
length, wins. All texts of a batch are parsed at once, in blocks of letters
that are joined exactly: a block is parsed again from the state in which the
one before it ends, until it meets its earlier parse.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.texts import code_points, slices

# The fit is bounded by these; prediction reads whole texts.
SAMPLE_TEXTS = 64  # labelled texts a language
SAMPLE_CHARS = 32768  # letters a language
ALPHABET = 96  # most frequent letters, whose transitions are looked up in a table; those of all others in sorted keys
BLOCK = 512  # letters that are parsed in a run
SHARPNESS = 6.0  # turns differences in bits a letter into a score
UNDECIDED = "und"

SPACE, UNKNOWN = 0, 1  # classes of letters; one for every letter of the samples follows


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point and letter flag of every code point."""
    chars = [chr(i) for i in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in chars), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        low = chars[i].lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return lower, letter


def plain(text: str) -> str:
    """Lower-case letters with single spaces between words, as the parser sees them."""
    lower, letter = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kept = np.where(letter[points], lower[points], 32)
    return " ".join(kept.astype("<u4").tobytes().decode("utf-32-le").split())


def suffix_automaton(codes: list[int]) -> list[dict]:
    """Transitions (class to state) of every state of the automaton of all substrings; state 0 is the root."""
    to, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        state = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at != -1 and c not in to[at]:
            to[at][c] = state
            at = link[at]
        if at != -1:
            target = to[at][c]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                clone = len(to)
                to.append(dict(to[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at != -1 and to[at].get(c) == target:
                    to[at][c] = clone
                    at = link[at]
                link[target] = link[state] = clone
        last = state
    return to


@dataclass
class Table:
    """Transitions of one language: a dense part for frequent classes, sorted keys for the others.

    States are row offsets of the dense part. Its last row is the state
    between phrases, and its last class pads blocks and leads there. 0 is no
    transition; from the root, the state between phrases stands for it.
    """

    dense: np.ndarray
    keys: np.ndarray
    targets: np.ndarray
    width: int
    others: int

    @classmethod
    def of(cls, automaton: list[dict], width: int, others: int) -> Table:
        dense = np.zeros((len(automaton) + 1, width), np.int32)
        dense[:, -1] = len(automaton) * width
        sparse = {}
        for state, edges in enumerate(automaton):
            for c, target in edges.items():
                if c < width:
                    dense[state, c] = target * width
                else:
                    sparse[state * others + c - width] = target * width
        keys = np.array(sorted(sparse), np.int64)
        return cls(dense.ravel(), keys, np.array([sparse[k] for k in keys.tolist()], np.int32), width, others)

    @property
    def between(self) -> int:
        return len(self.dense) - self.width

    def follow(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states, 0 where a phrase can't go on."""
        other = np.flatnonzero(letter >= self.width) if self.others else ()
        if not len(other):
            return self.dense.take(state + letter)
        out = self.dense.take(state + np.where(letter < self.width, letter, UNKNOWN))
        if len(self.keys):
            wanted = state[other].astype(np.int64) // self.width * self.others + letter[other] - self.width
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[other] = np.where(self.keys[at] == wanted, self.targets[at], 0)
        return out

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a new phrase begins with the letter."""
        following = self.follow(state, letter)
        begins = following == 0
        if begins.any():
            fresh = self.follow(np.zeros(int(begins.sum()), np.int32), letter[begins])
            following[begins] = np.where(fresh == 0, self.between, fresh)
        return following, begins


@dataclass
class Model:
    """Languages in code-point order, the class of every code point, and the transitions of each language."""

    languages: list
    classes: np.ndarray
    width: int
    tables: list
    bits: list


def fit(samples: dict) -> Model:
    """Model of language -> texts; each sample is cut to ``SAMPLE_CHARS`` letters."""
    texts = {k: " " + " ".join(plain(t) for t in v)[:SAMPLE_CHARS] + " " for k, v in sorted(samples.items())}
    texts = {k: t for k, t in texts.items() if t.strip()}
    points, counts = np.unique(np.frombuffer("".join(texts.values()).encode("utf-32-le"), np.uint32), return_counts=True)
    ordered = [p for p in points[np.argsort(-counts, kind="stable")].tolist() if p != 32]
    width = min(len(ordered), ALPHABET) + 3
    numbers = np.arange(2, len(ordered) + 2)
    numbers[ALPHABET:] += 1  # the class before these pads blocks
    lower, letter = _letters()
    known = np.full(0x110000, UNKNOWN, np.int32)
    known[ordered] = numbers
    of_point = np.where(letter, known[lower], SPACE).astype(np.int32)
    tables, bits = [], []
    for text in texts.values():
        codes = of_point[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        tables.append(Table.of(suffix_automaton(codes.tolist()), width, max(0, len(ordered) - ALPHABET)))
        bits.append(float(np.log2(len(text))))
    return Model(list(texts), of_point, width, tables, bits)


def begins_of_phrases(table: Table, grid: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin in blocks of letters, which are the columns of ``grid`` in the order of the text.

    ``first`` marks the blocks that open a text. Every block is parsed from
    the state between phrases, then again from the last state of the block
    before it, until it meets its earlier states or ends; blocks whose
    predecessor's last state changed by that are taken up once more.
    """
    states = np.empty(grid.shape, np.int32)
    begins = np.empty(grid.shape, bool)
    entry = state = np.full(grid.shape[1], table.between, np.int32)
    for i, row in enumerate(grid):
        state, begins[i] = table.step(state, row)
        states[i] = state
    while grid.shape[1]:
        before = np.where(first, table.between, np.roll(states[-1], 1))
        open_ = np.flatnonzero(before != entry)
        entry, state = before, before[open_]
        if not len(open_):
            break
        for i, row in enumerate(grid):
            state, begins[i, open_] = table.step(state, row[open_])
            differs = states[i, open_] != state
            states[i, open_] = state
            if not differs.all():
                open_, state = open_[differs], state[differs]
                if not len(open_):
                    break
    return begins


def phrases(model: Model, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, languages) numbers of phrases; classes parsed in each text; whether it has a letter."""
    classes = model.classes[points]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    repeat = np.zeros(len(classes), bool)
    repeat[1:] = (classes[1:] == SPACE) & (classes[:-1] == SPACE) & (text[1:] == text[:-1])
    letters = np.bincount(text[classes != SPACE], minlength=len(offsets) - 1)
    classes, text = classes[~repeat], text[~repeat]
    sizes = np.bincount(text, minlength=len(offsets) - 1)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(classes)) - begin[text]
    blocks = -(-sizes // BLOCK)
    block = (np.cumsum(blocks) - blocks)[text] + place // BLOCK
    of_block = np.repeat(np.arange(len(sizes)), blocks)
    first = np.ones(len(of_block), bool)
    first[1:] = of_block[1:] != of_block[:-1]
    grid = np.full((BLOCK, len(of_block)), model.width - 1, np.int32)
    grid[place % BLOCK, block] = classes
    out = np.zeros((len(sizes), len(model.languages)), np.int64)
    for at, table in enumerate(model.tables):
        counts = begins_of_phrases(table, grid, first).sum(0)
        out[:, at] = np.bincount(of_block, weights=counts, minlength=len(sizes))
    return out, sizes, letters > 0


def predict(model: Model, points: np.ndarray, offsets: np.ndarray) -> tuple[list, np.ndarray]:
    """Language and score of each text."""
    counts, sizes, worded = phrases(model, points, offsets)
    if not model.languages:
        return [UNDECIDED] * len(sizes), np.zeros(len(sizes))
    entropy = counts * np.array(model.bits) / np.maximum(sizes, 1)[:, None]
    best = entropy.argmin(1)
    weight = np.exp(-SHARPNESS * (entropy - entropy.min(1, keepdims=True)))
    score = np.where(worded, 1 / weight.sum(1), 0.0)
    return [model.languages[b] if w else UNDECIDED for b, w in zip(best.tolist(), worded.tolist(), strict=True)], score


def sample(docs: DataFrame, learnable: Column, text_col: str = "text", lang_col: str = "lang") -> dict:
    """language -> texts: at most ``SAMPLE_TEXTS`` distinct ones a language, those of the smallest hashes.

    Every language with a text that has a letter within the part that is read has a sample.
    """
    each = SAMPLE_CHARS * 4 // SAMPLE_TEXTS
    rows = docs.filter(learnable & F.col(lang_col).isNotNull()).select(
        F.left(F.col(text_col), F.lit(each)).alias("text"), F.col(lang_col).alias("lang"),
        F.xxhash64(F.col(text_col)).alias("place")).filter(F.col("text").rlike(r"\p{L}"))
    # copies count once; the limit applies before the shuffle by language
    order = Window.partitionBy("lang").orderBy("place")
    chosen = rows.select("lang", "place").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_TEXTS)
    # at most SAMPLE_TEXTS rows a language
    texts = rows.join(F.broadcast(chosen), ["lang", "place"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    out: dict = {}
    for r in texts.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, model: Model, columns: dict, text_col: str = "text") -> DataFrame:
    """The named columns with lang_pred and score, one row for each row of ``docs``.

    ``columns`` maps output names to expressions. Whole texts are parsed. A
    null text or one without letters is ``und`` with score 0, as is every text
    where nothing could be learned; repeated rows get equal results; ties go
    to the first language in code-point order; an empty table gives an empty
    result. Columns that are not asked for are left out.
    """
    kept = docs.select(*[c.alias(k) for k, c in columns.items()], F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(columns)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                found, scores = predict(shared.value, *code_points(part.column("_text")))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.string()), pa.array(scores)],
                                                 [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("_text").schema)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row belongs to the fourth that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    model = fit(sample(docs, ~held_out()))
    return identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out()})
