"""Filter interaction audit with decision diagrams.

Every document has a mask of the filters that it fails. The masks of a part
are counted, and a diagram over them, one level for each filter, carries the
counts: a node branches on its filter into the documents that pass and those
that fail. Swapping two adjacent levels turns the diagram of one order of
filters into that of another, so adjacent swaps visit all orders. The path on
which everything passes gives the steps of an order: at each of its nodes the
failing branch is what the filter removes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.texts import slices
from pactlens.session import cut_lineage

LETTERS = "ABCDE"
MIN_WORDS = 200
SLICE = 1 << 20  # bytes of text that are handled together
_SYMBOLS = re.compile(rb"[#$%&*|]")


def text_failures(text: bytes) -> int:
    """Mask of the filters A to D, lowest bit first, that a text fails."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    upper = np.count_nonzero((raw >= 65) & (raw <= 90))
    points = np.count_nonzero((raw & 0xC0) != 0x80)
    fails = (len(words) < MIN_WORDS, 100 * len(set(words)) < 50 * len(words), 100 * upper > 2 * points, _SYMBOLS.search(text) is not None)
    return sum(1 << i for i, f in enumerate(fails) if f)


class Diagram:
    """A count-weighted decision diagram over masks; equal sub-diagrams are one node.

    A node is a number: 0 and up of leaves and inner nodes alike. ``total``
    holds the counts below each node. All levels are present on every path.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], variables: int):
        self.order = list(range(variables))  # the variable of each level
        self.zero = (0,) * max((len(c) for c in counts.values()), default=1)
        self.unique: dict = {}
        self.nodes: list = []  # None of a leaf, else (variable, passing, failing)
        self.total: list[tuple[int, ...]] = []
        self.root = self._build(counts, 0, 0)

    def _add(self, key, total) -> int:
        if key not in self.unique:
            self.unique[key] = len(self.nodes)
            self.nodes.append(None if key[0] == "leaf" else key)
            self.total.append(total)
        return self.unique[key]

    def leaf(self, counts: tuple[int, ...]) -> int:
        return self._add(("leaf", counts), counts)

    def node(self, variable: int, passing: int, failing: int) -> int:
        total = tuple(a + b for a, b in zip(self.total[passing], self.total[failing], strict=True))
        return self._add((variable, passing, failing), total)

    def _build(self, counts, level: int, mask: int) -> int:
        if level == len(self.order):
            return self.leaf(counts.get(mask, self.zero))
        variable = self.order[level]
        return self.node(variable, self._build(counts, level + 1, mask), self._build(counts, level + 1, mask | 1 << variable))

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the next one."""
        upper, lower = self.order[level:level + 2]
        self.order[level:level + 2] = [lower, upper]
        done: dict[int, int] = {}

        def rebuilt(at: int, depth: int) -> int:
            if at not in done:
                variable, low, high = self.nodes[at]
                if depth < level:
                    done[at] = self.node(variable, rebuilt(low, depth + 1), rebuilt(high, depth + 1))
                else:
                    (_, ll, lh), (_, hl, hh) = self.nodes[low], self.nodes[high]
                    done[at] = self.node(lower, self.node(upper, ll, hl), self.node(upper, lh, hh))
            return done[at]

        self.root = rebuilt(self.root, 0)

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(variable, counts removed, counts kept) of every level along the path on which everything passes."""
        at = self.root
        while self.nodes[at] is not None:
            variable, passing, failing = self.nodes[at]
            yield variable, self.total[failing], self.total[passing]
            at = passing


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels whose swaps, one after the other, lead through all orders of ``n`` variables."""
    if n < 2:
        return
    inner = list(adjacent_swaps(n - 1))
    # the last variable walks through the order of the others, which then take one swap of their own
    for i, own in enumerate([*inner, None]):
        yield from range(n - 2, -1, -1) if i % 2 == 0 else range(n - 1)
        if own is not None:
            yield own + (i % 2 == 0)


def audit(counts: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters.

    ``counts`` holds (documents, good ones, toxic ones) of every failure mask.
    """
    n = len(letters)
    diagram = Diagram({0: (0, 0, 0)} | counts, n)
    failing = [sum(c[0] for m, c in counts.items() if m >> v & 1) for v in range(n)]
    rows, shapley, unique = [], defaultdict(int), [0] * n
    for swap in (None, *adjacent_swaps(n)):
        if swap is not None:
            diagram.swap(swap)
        order = "".join(letters[v] for v in diagram.order)
        for step, (v, removed, kept) in enumerate(diagram.steps(), 1):
            rows.append((order, step, kept[0], removed[0], failing[v] - removed[0], v, removed[1], removed[2]))
            shapley[v] += removed[0]
            if step == n:
                unique[v] = removed[0]  # all other filters passed
    return [(*r[:5], unique[r[5]], *r[6:], shapley[r[5]]) for r in rows]


def text_masks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, k1, k2, mask): the filters A to D of every row; the keys tell texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=SLICE):
                masks = pa.array([text_failures(t) for t in part.column("text").cast(pa.binary()).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "part", "k1", "k2")], masks], ["doc_id", "part", "k1", "k2", "mask"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, part string, k1 long, k2 long, mask int")


def with_copies(rows: DataFrame, facts: tuple[str, ...], copy_bit: int) -> DataFrame:
    """Counts ``n`` by ``facts`` with ``copy_bit`` set in ``mask`` of rows whose text a smaller id has.

    ``rows`` has doc_id, k1, k2 and ``facts``, among them mask. Rows are
    counted before every shuffle and never joined, so a text that very many
    rows have is one row for each task. A null id is no smaller id, and has none.
    """
    # narrow rows, written once, so that the texts are read once
    counted = cut_lineage(rows.groupBy("k1", "k2", "doc_id", *facts).agg(F.count("*").alias("n")))
    alike = counted.filter("doc_id IS NOT NULL").groupBy("k1", "k2", "doc_id").agg(F.collect_list(F.struct(*facts, "n")).alias("rows"))
    first = alike.groupBy("k1", "k2").agg(F.min_by("rows", "doc_id").alias("rows")).select(F.inline("rows")).unionByName(
        counted.filter("doc_id IS NULL").select(*facts, "n"))
    signed = counted.select(*facts, "n", F.lit(0).alias("p")).unionByName(first.select(*facts, F.lit(0).alias("n"), F.col("n").alias("p")))
    both = signed.groupBy(*facts).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    marked = F.inline(F.array(F.struct(F.lit(0).alias("bit"), F.col("p").alias("n")), F.struct(F.lit(copy_bit).alias("bit"), (F.col("n") - F.col("p")).alias("n"))))
    return both.select(*facts, marked.alias("bit", "c")).select(
        *[f for f in facts if f != "mask"], F.col("mask").bitwiseOR(F.col("bit")).alias("mask"), F.col("c").alias("n")).filter("n > 0")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                 masks: Callable[..., DataFrame] = text_masks, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part, order of the filters and step, zeros included.
    ``masks`` finds the failures of single rows; the last letter is the copy
    filter. A null text is empty, a null part the empty string. A document
    counts as good or toxic where any label of its id says so. Rows that share
    an id and a text are no copies of each other; a row with a null id never is
    one. Other columns are left out; an empty table gives an empty result.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    rows = masks(docs, id_col, text_col, part_col).join(known, "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    counts = with_copies(rows, ("part", "mask", "good", "toxic"), 1 << (len(letters) - 1)).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # at most 2 ** filters rows
        table = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(frame["mask"], frame["n"], frame["good"], frame["toxic"], strict=True)}
        out = pd.DataFrame(audit(table, letters), columns=names)
        return out.assign(part=frame["part"].iloc[0])

    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return counts.groupBy("part").applyInPandas(
        run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
             "toxic_lost long, shapley long")


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters for every source."""
    return filter_audit(docs, labels)
