"""Fill-in-middle transformation with piece tables.

A document is a piece table: descriptors (buffer, start, end) over its text,
which never changes, and over a buffer of sentinels. Cutting at a place splits
the descriptor that holds it, an arrangement permutes the descriptors, and the
inverse permutation restores them. No step copies text; hashes and outputs
stream the descriptors in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.texts import slices

SEED = 7
RATE, SPM = 100, 50  # per cent of the documents that are transformed, and of these in the order suffix, prefix, middle
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PARTS = ("prefix", "middle", "suffix")  # as they stand in the text
SLICE = 1 << 20  # bytes of text that are handled together

TEXT, MARKS = 0, 1
_MARKS = b"".join(SENTINELS.values())
_MARK_AT = {name: (_MARKS.index(mark), _MARKS.index(mark) + len(mark)) for name, mark in SENTINELS.items()}


class Piece(NamedTuple):
    buffer: int
    start: int
    end: int


class PieceTable:
    """Descriptors over an immutable text and the sentinels."""

    def __init__(self, text: bytes, pieces: list[Piece] | None = None):
        self.buffers = (memoryview(text), memoryview(_MARKS))
        self.pieces = [Piece(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, *places: int) -> PieceTable:
        """Split so that a piece begins at each of the ascending places; a place at an edge splits off an empty piece."""
        pieces, before = [], 0
        left = list(places)
        for piece in self.pieces:
            after = before + piece.end - piece.start
            start = piece.start
            while left and left[0] <= after:
                middle = piece.start + left.pop(0) - before
                pieces.append(Piece(piece.buffer, start, middle))
                start = middle
            pieces.append(Piece(piece.buffer, start, piece.end))
            before = after
        return PieceTable(self.buffers[TEXT], pieces)

    def arrange(self, order: tuple[str, ...]) -> PieceTable:
        """The pieces of prefix, middle and suffix in this order, each after its sentinel."""
        pieces = []
        for name in order:
            pieces += [Piece(MARKS, *_MARK_AT[name]), self.pieces[PARTS.index(name)]]
        return PieceTable(self.buffers[TEXT], pieces)

    def stream(self) -> Iterator[memoryview]:
        return (self.buffers[p.buffer][p.start:p.end] for p in self.pieces)

    def sha256(self) -> str:
        state = hashlib.sha256()
        for part in self.stream():
            state.update(part)
        return state.hexdigest()

    def __bytes__(self) -> bytes:
        return b"".join(self.stream())


def restored(output: bytes, form: str) -> PieceTable:
    """The text as a piece table over an output and its form alone: the inverse permutation of its parts."""
    if form == "plain":
        return PieceTable(output)
    order = ORDERS[form]
    starts = [output.index(SENTINELS[name]) for name in order]  # the text holds no sentinel
    ends = [*starts[1:], len(output)]
    found = {n: Piece(TEXT, a + len(SENTINELS[n]), b) for n, a, b in zip(order, starts, ends, strict=True)}
    return PieceTable(output, [found[name] for name in PARTS])


def unit_ends(text: bytes) -> np.ndarray:
    """Offsets behind every line; a line keeps its newline, and the last one may lack it."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.append(ends, len(text)) if text and not text.endswith(b"\n") else ends


def characters(part: memoryview) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


def draws(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: bytes, key: str, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, PieceTable, PieceTable | None]:
    """(lines, form, output, cut table) of one document; no cut table where the form is plain."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in SENTINELS.values()):
        return n, "plain", PieceTable(text), None
    places = np.concatenate([[0], ends])
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    table = PieceTable(text).cut(int(places[low]), int(places[high]))
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, table.arrange(ORDERS[form]), table


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
                   spm: int = SPM, keep_text: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256[, output]), one row for each row of ``docs``.

    A text is cut between lines at two places that hash from the seed and the
    id. ``restored_sha256`` is of the text rebuilt from output and form.
    Null texts count as empty and stay plain, as do texts that hold a
    sentinel; a null id hashes as an empty one; rows with one id are cut by the
    same draws; other columns are left out; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))

    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + (["output"] if keep_text else [])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()][:len(names)]

    def one(text: bytes, key: str) -> tuple:
        n, form, output, table = transformed(text, key, seed, rate, spm)
        prefix, middle = [characters(m) for m in table.stream()][:2] if table else (None, None)
        whole = bytes(output)
        row = (n, form, prefix, middle, output.sha256(), restored(whole, form).sha256())
        return (*row, whole.decode()) if keep_text else row

    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=SLICE):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                made = [one(t or b"", k or "") for t, k in zip(texts, part.column("key").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]], ["doc_id", *names])

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
                           "restored_sha256 string" + (", output string" if keep_text else ""))


def op12_fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, lines, form, the lengths of prefix and middle, and the SHA-256 of output and restored text, one row per document."""
    return fill_in_middle(docs, keep_text=False)
