"""Contract, clause and score relations: joins, filters, roll-ups and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens import domain as D
from pactlens.functions import scoring

CLAUSE_KEY = ["contract_id", "clause_index"]
DIGEST_BYTES = 4096  # of a piece of a digest
DIGEST_CELL = 256  # positions whose lines are laid out together


def owned_by(contracts: DataFrame, owners: DataFrame) -> DataFrame:
    """Contracts of the given owners."""
    return contracts.join(owners.select("owner_id").distinct(), "owner_id", "left_semi")


def scoped_clauses(clauses: DataFrame, contracts: DataFrame) -> DataFrame:
    """Clauses whose contract is in ``contracts`` (already owner-scoped)."""
    return clauses.join(contracts.select("contract_id"), "contract_id", "left_semi")


def with_level(scored: DataFrame, level: str = "all") -> DataFrame:
    return scored if level == "all" else scored.filter(F.col("risk_level") == level)


def scored_clauses(clauses: DataFrame, scores: DataFrame, how: str = "inner") -> DataFrame:
    """Clauses with their score row; ``how="left"`` keeps unanalyzed clauses."""
    return clauses.join(scores, CLAUSE_KEY, how)


def with_defaults(clauses: DataFrame) -> DataFrame:
    return clauses.withColumns({
        "clause_type": F.coalesce("clause_type", F.lit(D.DEFAULT_TYPE)),
        "conf": F.coalesce("conf", F.lit(D.DEFAULT_CONFIDENCE)),
    })


def with_hybrid(clauses: DataFrame) -> DataFrame:
    """Add ``hybrid_score`` and ``risk_level`` from type, confidence, score and factors."""
    scored = clauses.withColumn("hybrid_score", scoring.hybrid_score(
        F.col("clause_type"), F.col("conf"), F.col("model_score"), F.col("n_factors")))
    return scored.withColumn("risk_level", scoring.hybrid_level(F.col("hybrid_score")))


def level_counts(level: Column) -> dict[str, Column]:
    """Conditional counts that always sum to the number of rows."""
    clean = F.lower(scoring.strip(F.coalesce(level, F.lit(""))))
    counts = {name: F.count_if(clean == name) for name in D.RISK_LEVELS}
    counts["unanalyzed"] = F.count_if(~clean.isin(*D.RISK_LEVELS))
    return counts


def risk_distribution(scored: DataFrame, *keys: str) -> DataFrame:
    aggregates = [col.alias(name) for name, col in level_counts(F.col("risk_level")).items()]
    return scored.groupBy(*keys).agg(*aggregates, F.count("*").alias("n_clauses"))


def distribution_shares(distribution: DataFrame, total: str = "n_clauses") -> DataFrame:
    base = F.greatest(F.col(total), F.lit(1))
    return distribution.withColumns({
        f"{name}_share": F.col(name) / base for name in (*D.RISK_LEVELS, "unanalyzed")})


def contract_list(contracts: DataFrame, clauses: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per contract with clause and analyzed counts.

    Both sides are counted before the join, so nothing fans out.
    """
    clause_counts = clauses.groupBy("contract_id").agg(
        F.count("*").alias("clause_count"))
    score_counts = scores.groupBy("contract_id").agg(
        F.count_distinct("clause_index").alias("analyzed_count"))
    return (
        contracts.join(clause_counts, "contract_id", "left")
        .join(score_counts, "contract_id", "left")
        .withColumns({
            "clause_count": F.coalesce("clause_count", F.lit(0)),
            "analyzed_count": F.coalesce("analyzed_count", F.lit(0)),
        })
        .withColumn("has_analysis", F.col("analyzed_count") > 0)
    )


def newest_first(contracts: DataFrame) -> DataFrame:
    return contracts.orderBy(F.col("created_at").desc(), "contract_id")


def newest_clause_rank(scores: DataFrame, keep: int, *keys: str) -> DataFrame:
    """Most recent ``keep`` rows per key; the rank limit is applied before the shuffle."""
    recent = Window.partitionBy(*keys).orderBy(F.col("created_at").desc(), *CLAUSE_KEY)
    return (
        scores.withColumn("recency", F.row_number().over(recent))
        .filter(F.col("recency") <= keep).drop("recency")
    )


def _protections(*fields: str) -> Column:
    names = ("pain_point", "required_type", "severity", "title", "detail")
    return F.array(*[
        F.struct(*[F.lit(row[names.index(f)]).alias(f) for f in ("required_type", *fields)])
        for row in D.PROTECTIONS
    ])


def missing_protections(clauses: DataFrame, *keys: str) -> DataFrame:
    """Expected protections whose clause type a contract does not contain.

    The present types are a set of at most eight names, built with partial
    aggregation; the fixed checklist is compared inside the row, so there is
    neither a cross join nor a second shuffle.
    """
    types = [row[1] for row in D.PROTECTIONS]
    relevant = F.when(F.col("clause_type").isin(*types), F.col("clause_type"))
    present = clauses.groupBy(*keys).agg(F.collect_set(relevant).alias("present"))
    absent = F.filter(
        _protections("pain_point", "severity", "title", "detail"),
        lambda item: ~F.array_contains("present", item["required_type"]))
    return (
        present.select(*keys, F.explode(absent).alias("item"))
        .select(*keys, F.lit("missing_protection").alias("finding_type"),
                "item.pain_point", "item.severity", "item.title", "item.detail")
    )


def missing_types(clauses: DataFrame, *keys: str) -> DataFrame:
    """The same difference as one array per contract, in checklist order."""
    required = F.array(*[F.lit(row[1]) for row in D.PROTECTIONS])
    return clauses.groupBy(*keys).agg(
        F.array_except(required, F.collect_set("clause_type")).alias("missing"))


def findings_in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("contract_id", "severity", "pain_point")


def risk_percentile(scored: DataFrame, *keys: str, score: str = "model_score") -> DataFrame:
    """Percentile rank (0-100) of each clause's score within its contract.

    Scores carry four decimals, so a contract has at most 10 001 distinct
    values. Ranking those instead of the clauses keeps the window small even
    for a contract that holds a large part of all rows.
    """
    counts = scored.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count("*").alias("ties"))
    whole = Window.partitionBy(*keys)
    below = whole.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select(
        *keys, score,
        F.coalesce(F.sum("ties").over(below), F.lit(0)).alias("lower"),
        F.sum("ties").over(whole).alias("total"))
    share = F.when(F.col("total") > 1, F.col("lower") / (F.col("total") - 1)).otherwise(0.0)
    percentiles = ranked.select(
        *keys, score, F.rint(F.lit(100) * share).cast("int").alias("risk_percentile"))
    return scored.join(percentiles, [*keys, score], "left")


def digest_lines(scored: DataFrame, findings: DataFrame) -> DataFrame:
    """(contract_id, part, position, line): clause lines are part 0, finding lines part 1."""
    clause_lines = scored.select(
        "contract_id", F.lit(0).alias("part"), F.col("clause_index").alias("position"),
        scoring.digest_line(
            F.col("clause_index"), F.col("clause_type"), F.col("risk_level"), F.col("summary"))
        .alias("line"))
    order = F.array_position(
        F.array(*[F.lit(p) for p in D.PAIN_POINTS]), F.col("pain_point")).cast("int")
    finding_lines = findings.select(
        "contract_id", F.lit(1).alias("part"), order.alias("position"),
        scoring.finding_line(F.col("title"), F.col("detail")).alias("line"))
    return clause_lines.unionByName(finding_lines)


def contract_digest(scored: DataFrame, findings: DataFrame) -> DataFrame:
    """Clause lines in order, then finding lines, as one text per contract.

    Each contract is one row; ``digest_parts`` is for contracts of any size.
    """
    ordered = F.sort_array(F.collect_list(F.struct("part", "position", "line")))
    return digest_lines(scored, findings).groupBy("contract_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("digest"))


def digest_parts(scored: DataFrame, findings: DataFrame, budget: int = DIGEST_BYTES, cell: int = DIGEST_CELL) -> DataFrame:
    """The digest as pieces of at most ``budget`` bytes: (contract_id, part, cell, piece, text).

    In the order of part, cell and piece, the texts of a contract put together
    are its digest with a newline at the end of every line. A cell holds the
    lines of ``cell`` neighbouring positions, so that no task sees a whole
    contract; inside it, a line goes to the piece in whose half of the budget
    it starts. Lines of more than an eighth of the budget in characters are
    cut, as a character takes four bytes at most. Null lines are left out, as
    in the digest; lines without a position come first.
    """
    if budget < 64:
        raise ValueError("a piece needs 64 bytes")
    size = budget // 8
    lines = digest_lines(scored, findings).filter(F.col("line").isNotNull()).withColumn(
        "cell", F.coalesce(F.floor(F.col("position") / cell), F.lit(-1)).cast("long"))
    key = ["contract_id", "part", "cell"]
    cuts = F.sequence(F.lit(0), F.floor(F.length("line") / size).cast("int"))
    numbered = lines.withColumns({
        "at": F.row_number().over(Window.partitionBy(*key).orderBy("position", "line")),
        "whole": F.concat("line", F.lit("\n"))})
    cut = numbered.select(*key, "at", "whole", F.explode(cuts).alias("n")).select(
        *key, "at", "n", F.substring("whole", F.col("n") * size + 1, F.lit(size)).alias("text"))
    before = Window.partitionBy(*key).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))
    placed = cut.withColumn("piece", F.floor(start / (budget // 2)))
    ordered = F.sort_array(F.collect_list(F.struct("at", "n", "text")))
    return placed.groupBy(*key, "piece").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def executive_summary(distribution: DataFrame, clauses: DataFrame) -> DataFrame:
    """Offline summary text per contract from its distribution and gaps."""
    titles = F.array(*[F.lit(row[3]) for row in D.PROTECTIONS])
    required = F.array(*[F.lit(row[1]) for row in D.PROTECTIONS])
    gaps = missing_types(clauses, "contract_id").select(
        "contract_id",
        F.transform(
            "missing", lambda t: F.element_at(titles, F.array_position(required, t).cast("int")))
        .alias("titles"))
    return distribution.join(gaps, "contract_id").select(
        "contract_id",
        scoring.demo_contract_summary(
            F.col("n_clauses"), F.col("high"), F.col("medium"), F.col("low"), F.col("titles"))
        .alias("executive_summary"))
