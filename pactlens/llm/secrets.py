"""Secret scan with corpus-wide ownership: copied examples against live-looking credentials.

Patterns find candidates in every text. Their hashes are then counted over the
whole corpus by distinct repositories and owners: a value that many owners
hold is a published example, one that a single owner holds looks live.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.texts import slices
from pactlens.session import cut_lineage

# Fixed values: (kind, text that must occur in lower case, pattern, group of the value, least length of the value)
BASE_KINDS = (
    ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
     r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", ("akia",), r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", (), r"([0-9a-f]{24,})", 1, 24),
)
ADDED_KINDS = (
    ("private_key", ("private key-----",), r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)", 1, 1),
    ("hub_token", ("gh",), r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40),
    ("web_token", ("eyj",), r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 30),
)
KINDS = tuple(k[0] for k in BASE_KINDS + ADDED_KINDS)
COMPILED = [(kind, guards, re.compile(pattern), group, least) for kind, guards, pattern, group, least in BASE_KINDS + ADDED_KINDS]
EXAMPLE_OWNERS = 3  # owners from which on a value counts as a copied example
LIVE_ENTROPY = 3.0  # bits a character that a live-looking value has at least

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("entropy", pa.float64())])
SPAN_DDL = "array<struct<kind:string,start:int,end:int,value:string,entropy:double>>"


def entropy(value: str) -> float:
    """Bits a character of the value's own distribution of characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def scan(text: str) -> list[dict]:
    """Spans of one text by start, then by kind as listed; offsets count code points."""
    low, spans = text.lower(), []
    for order, (kind, guards, pattern, group, least) in enumerate(COMPILED):
        if guards and not any(g in low for g in guards):
            continue
        for m in pattern.finditer(text):
            value = m[group]
            if len(value) >= least:
                spans.append((m.start(), order, {"kind": kind, "start": m.start(), "end": m.end(), "value": value, "entropy": entropy(value)}))
    return [s for _, _, s in sorted(spans, key=lambda s: s[:2])]


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: str = "source",
                    owner: str = "source") -> DataFrame:
    """(id, repository, owner, spans) for every row of ``docs``; a null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(repository).cast("string").alias("repository"),
                       F.col(owner).cast("string").alias("owner"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                spans = [scan(t) if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(spans, pa.list_(SPAN))], ["id", "repository", "owner", "spans"])

    return rows.mapInArrow(run, f"id long, repository string, owner string, spans {SPAN_DDL}")


def ownership(candidates: DataFrame) -> DataFrame:
    """(secret, repositories, owners) over the whole corpus for each distinct value.

    Values are hashed; null repositories and owners count as one of their own.
    Both steps combine before their shuffle, so a value that a third of the
    corpus copies is a few rows in each.
    """
    held = candidates.select("repository", "owner", F.explode("spans").alias("s")).select(
        F.sha2(F.col("s.value"), 256).alias("secret"),
        F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner"))
    pairs = held.groupBy("secret", "repository", "owner").agg(F.count("*").alias("uses"))
    return pairs.groupBy("secret").agg(
        F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"),
        F.sum("uses").alias("uses"))


def classified(candidates: DataFrame) -> DataFrame:
    """(row, n_example, n_live, repositories) of the rows that hold candidates, which carry a stable ``row``.

    ``repositories`` is the widest spread of any value of the row.
    """
    spans = candidates.select("row", F.explode("spans").alias("s")).select(
        "row", F.sha2(F.col("s.value"), 256).alias("secret"), F.col("s.entropy").alias("entropy"))
    known = spans.join(ownership(candidates), "secret")
    example = F.col("owners") >= EXAMPLE_OWNERS
    return known.groupBy("row").agg(
        F.sum(example.cast("long")).alias("n_example"),
        F.sum((~example & (F.col("entropy") >= LIVE_ENTROPY)).cast("long")).alias("n_live"),
        F.max("repositories").alias("repositories"))


def find_secrets(docs: DataFrame, **columns: str) -> DataFrame:
    """(id, spans, n_example, n_live, repositories), one row for each row of ``docs``.

    Repeated rows give repeated results and count once as an owner's; other
    columns are left out; an empty table gives an empty result. The candidates
    are written once, as the counts over the corpus need all of them.
    """
    candidates = cut_lineage(find_candidates(docs, **columns).withColumn("row", F.monotonically_increasing_id()))
    counts = classified(candidates)
    return candidates.join(counts, "row", "left").select(
        "id", "spans", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_example", "n_live", "repositories")])


def number_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def op8_secrets(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document; a document stands for a repository of its source."""
    base = [k[0] for k in BASE_KINDS]

    def joined(kinds):
        chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [number_of(kind).cast("long").alias(f"n_{kind}") for kind in base]
    return find_secrets(docs, repository="doc_id").select(
        F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"), "n_example", "n_live", "repositories")
