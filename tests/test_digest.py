"""Digests in pieces."""

from pyspark.sql import functions as F

from pactlens import domain as D
from pactlens.functions import scoring
from pactlens.operators import contracts as C


def frames(spark, scored, findings):
    return (spark.createDataFrame(scored, "contract_id long, clause_index int, clause_type string, risk_level string, summary string"),
            spark.createDataFrame(findings, "contract_id long, pain_point string, title string, detail string"))


def put_together(parts):
    out = {}
    for r in sorted(parts.collect(), key=lambda r: (r["contract_id"], r["part"], r["cell"], r["piece"])):
        out[r["contract_id"]] = out.get(r["contract_id"], "") + r["text"]
    return out


def test_pieces_put_together_are_the_digest(spark):
    points = list(D.PAIN_POINTS)
    scored = [(1, i, "liability", "high", "s" * (i * 7 % 160)) for i in range(900)]
    scored += [(2, 0, "§" * 700, "low", "ü😀" * 60), (2, 1, "x", "low", ""), (2, 1, "x", "low", ""), (3, 5, "x", None, "gone")]
    findings = [(1, points[1], "second", "d"), (1, points[0], "first", "d"), (4, points[0], "only", "é" * 900)]
    rows, found = frames(spark, scored, findings)
    whole = {r["contract_id"]: r["digest"] for r in C.contract_digest(rows, found).collect()}
    for budget in (64, 500, 4096):
        parts = C.digest_parts(rows, found, budget, cell=100)
        assert put_together(parts) == {k: v + "\n" for k, v in whole.items() if v}
        assert parts.agg(F.max(F.octet_length("text"))).first()[0] <= budget
    assert C.digest_parts(rows.limit(0), found.limit(0)).collect() == []


def test_a_contract_of_very_many_clauses(spark):
    rows = spark.range(300_000).select(
        F.lit(1).cast("long").alias("contract_id"), F.col("id").cast("int").alias("clause_index"), F.lit("liability").alias("clause_type"),
        F.lit("high").alias("risk_level"), F.repeat(F.lit("w "), (F.col("id") % 60).cast("int")).alias("summary"))
    none = frames(spark, [], [])[1]
    parts = C.digest_parts(rows, none)
    got = parts.agg(F.max(F.octet_length("text")), F.sum(F.octet_length("text"))).first()
    line = scoring.digest_line(F.col("clause_index"), F.col("clause_type"), F.col("risk_level"), F.col("summary"))
    assert got[0] <= C.DIGEST_BYTES and got[1] == rows.select(F.sum(F.octet_length(line) + 1)).first()[0]


def test_registered_digests_derive_clauses_with_their_scores_once(spark):
    from registry.base import Tables
    from registry.relations import _digest_inputs
    scored, findings = _digest_inputs(Tables(spark, "/root/testdata/sf0.001"))
    for digest in (C.contract_digest(scored, findings), C.digest_parts(scored, findings)):
        plan = digest._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 3
