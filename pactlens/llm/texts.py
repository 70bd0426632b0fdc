"""Vectorised text helpers for Arrow batches: code points, words and shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# odd multipliers of the 64-bit mixing steps
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; ``values`` is uint64 and is not changed."""
    h = values ^ (values >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def seeds(count: int, salt: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit values."""
    start = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
    return mix(start + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64))


@cache
def _tables():
    """Word-character flags and lower-case code points for every code point."""
    chars = [chr(i) for i in range(0x110000)]
    word = np.fromiter((c.isalnum() for c in chars), bool, 0x110000)
    word[ord("_")] = True
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(word).tolist():
        low = chars[i].lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return word, lower, seeds(1 << 16, 1), seeds(1 << 10, 2) | np.uint64(1)


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``budget`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // budget
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array and the offset of each text in it; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    try:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeError:  # a text that isn't valid UTF-8
        parts = [raw[a:b].tobytes().decode(errors="replace") for a, b in zip(ends, ends[1:], strict=False)]
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        return points, np.cumsum([0, *map(len, parts)])
    if len(points) == len(raw):
        return points, ends
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, starts[ends]


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every lower-case word (letters, digits, ``_``) and each text's offset in them."""
    is_word, lower, of_char, of_place = _tables()
    flags = is_word[points]
    begins = flags.copy()
    begins[1:] &= ~flags[:-1]
    first = offsets[:-1][offsets[:-1] < len(points)]
    begins[first] = flags[first]
    at = np.flatnonzero(flags)
    starts = np.flatnonzero(begins)
    counts = np.searchsorted(starts, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), counts
    number = np.cumsum(begins[at]) - 1
    chars = lower[points[at]]
    value = of_char[(chars ^ (chars >> np.uint32(16)) * np.uint32(0x9E37)) & np.uint32(0xFFFF)]
    value *= of_place[(at - starts[number]) & 1023]
    return mix(np.add.reduceat(value, np.flatnonzero(begins[at]))), counts


def shingles(word: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words and each text's offset in them.

    A text with fewer words, but one at least, has one shingle of all of them.
    """
    count = np.diff(offsets)
    made = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    out = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(count)), made)
    place = np.arange(out[-1]) - out[text]
    start, left = offsets[text] + place, count[text] - place
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    total = np.zeros(len(start), np.uint64)
    for j, factor in enumerate(seeds(size, 3) | np.uint64(1)):
        total += np.where(left > j, padded[start + j] * factor, np.uint64(0))
    return mix(total + np.uint64(size)), out


def counted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of every text in ascending order, their counts, and each text's offset in them."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(values)))
    return values[at], counts, np.searchsorted(text[at], np.arange(len(offsets)))
