"""Quality measurement: binary and class metrics, boundaries, gates, scorecard."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from pactlens import domain as D
from pactlens.functions.text import is_blank


def ratio(part: Column, whole: Column) -> Column:
    """Division that gives 0.0 for an empty denominator."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_f1(df: DataFrame, precision: Column, recall: Column) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    return df.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", ratio(2 * p * r, p + r))


def _from_confusion(df: DataFrame) -> DataFrame:
    tp = F.col("tp")
    return with_f1(df, ratio(tp, tp + F.col("fp")), ratio(tp, tp + F.col("fn")))


def _confusion(truth: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if(truth & predicted).alias("tp"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
        F.count_if(~truth & ~predicted).alias("tn"),
        F.count("*").alias("n"),
    ]


def labeled(rows: DataFrame, truth: str = "gold_high", text: str | None = None) -> DataFrame:
    """Rows that carry a label; unlabeled is not the same as negative."""
    kept = rows.filter(F.col(truth).isNotNull())
    return kept.filter(~is_blank(F.col(text))) if text else kept


def binary_metrics(
    rows: DataFrame, *keys: str, truth: str = "gold_high", predicted: str = "predicted_high"
) -> DataFrame:
    return _from_confusion(
        rows.groupBy(*keys).agg(*_confusion(F.col(truth), F.col(predicted))))


def metrics_by_source(
    rows: DataFrame, truth: str = "gold_high", predicted: str = "predicted_high"
) -> DataFrame:
    """Metrics per source plus one ``overall`` row from the same pass.

    Sources are counted first and rolled up from those counts, so the overall
    row costs one row per source, not a second copy of the data.
    """
    counts = rows.groupBy("source").agg(*_confusion(F.col(truth), F.col(predicted)))
    sums = [F.sum(name).alias(name) for name in ("tp", "fp", "fn", "tn", "n")]
    both = counts.rollup("source").agg(*sums, F.grouping("source").alias("is_overall"))
    scored = _from_confusion(both)
    return scored.select(
        F.when(F.col("is_overall") == 1, F.lit("overall")).otherwise(F.col("source"))
        .alias("source"),
        "n", "tp", "fp", "fn", "tn", "precision", "recall", "f1",
        ((F.col("precision") >= D.TARGET_PRECISION) & (F.col("recall") >= D.TARGET_RECALL))
        .alias("meets_targets"))


def threshold_sweep(
    rows: DataFrame, score: str = "hybrid_score", truth: str = "gold_high",
    thresholds=D.SWEEP_THRESHOLDS, current: float = D.HYBRID_HIGH,
) -> DataFrame:
    """Metrics at every candidate threshold from one pass over the rows.

    Each threshold adds conditional counts to a single aggregate; rows are
    never multiplied.
    """
    truth_col, score_col = F.col(truth), F.col(score)
    counts = []
    for i, threshold in enumerate(thresholds):
        hit = score_col >= F.lit(threshold)
        counts += [
            F.count_if(truth_col & hit).alias(f"tp{i}"), F.count_if(~truth_col & hit).alias(f"fp{i}")]
    totals = rows.agg(
        *counts, F.count_if(truth_col).alias("positives"), F.count("*").alias("n"))
    points = F.array(*[
        F.struct(
            F.lit(t).alias("threshold"), F.lit(abs(t - current) < 1e-9).alias("is_current"),
            F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
        for i, t in enumerate(thresholds)])
    flat = totals.select("positives", "n", F.inline(points)).withColumns({
        "fn": F.col("positives") - F.col("tp"),
        "tn": F.col("n") - F.col("positives") - F.col("fp"),
    })
    return _from_confusion(flat).select(
        "threshold", "is_current", "n", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


def confusion_matrix(pairs: DataFrame, labels=None) -> DataFrame:
    """Long-form matrix over all label pairs, zero-filled: (true_label, pred_label, n)."""
    names = sorted(labels or D.CLAUSE_TYPES)
    counts = pairs.groupBy("true_label").agg(*[
        F.count_if(F.col("pred_label") == name).alias(name) for name in names])
    columns = F.array(*[
        F.struct(F.lit(name).alias("pred_label"), F.coalesce(F.col(name), F.lit(0)).alias("n"))
        for name in names])
    grid = pairs.sparkSession.createDataFrame([(name,) for name in names], "true_label string")
    return grid.join(counts, "true_label", "left").select("true_label", F.inline(columns))


def confusion_shares(matrix: DataFrame) -> DataFrame:
    """Share of each cell in its row; 0 for an empty row."""
    row = Window.partitionBy("true_label")
    return matrix.withColumn("share", ratio(F.col("n"), F.sum("n").over(row)))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion matrix."""
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    per_true = matrix.groupBy(F.col("true_label").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    per_pred = matrix.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    joined = per_true.join(per_pred, "label")
    return with_f1(
        joined, ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support")),
    ).select("label", "precision", "recall", "f1", "support")


def f1_averages(report: DataFrame, *keys: str) -> DataFrame:
    return report.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("n"))


def low_confidence_rate(rows: DataFrame, conf: str = "conf") -> DataFrame:
    return rows.agg(
        F.count("*").alias("n"),
        F.avg((F.col(conf) < D.LOW_CONFIDENCE).cast("double")).alias("low_confidence_rate"))


def acceptance_gate(report: DataFrame) -> DataFrame:
    """Macro and per-class floors of a trained classifier."""
    return report.agg(
        F.avg("f1").alias("macro_f1"), F.min("f1").alias("worst_f1"),
        (F.avg("f1") >= D.MACRO_F1_FLOOR).alias("macro_ok"),
        (F.min("f1") >= D.CLASS_F1_FLOOR).alias("classes_ok"),
        (F.avg("f1") >= D.OUT_OF_DOMAIN_F1_FLOOR).alias("out_of_domain_ok"))


def pick_model(candidates: DataFrame, reference: str, gate: float = D.MODEL_GATE) -> DataFrame:
    """First candidate, in order, that loses less than ``gate`` to the reference.

    ``candidates`` has (model, position, f1). Falls back to the reference; a
    missing reference gives NULL and a reason.
    """
    ref = F.max(F.when(F.col("model") == reference, F.col("f1")))
    listed = candidates.agg(
        ref.alias("reference_f1"),
        F.sort_array(F.collect_list(F.struct("position", "model", "f1"))).alias("models"))
    chosen = F.get(F.filter(
        "models", lambda m: F.col("reference_f1") - m["f1"] < F.lit(gate)), F.lit(0))
    missing = F.col("reference_f1").isNull()
    return listed.select(
        F.when(missing, F.lit(None)).otherwise(F.coalesce(chosen["model"], F.lit(reference)))
        .alias("chosen"),
        F.when(~missing, F.round(F.col("reference_f1") - F.coalesce(chosen["f1"], F.col("reference_f1")), 4))
        .alias("delta_vs_reference"),
        F.when(missing, F.lit(f"{reference} was not evaluated")).alias("reason"))


def model_comparison(candidates: DataFrame, reference: str) -> DataFrame:
    """Candidates with their distance to the reference; their own columns, such as ``ms_per_row``, stay."""
    whole = Window.partitionBy()
    ref = F.max(F.when(F.col("model") == reference, F.col("macro_f1"))).over(whole)
    return candidates.withColumn("delta_vs_reference", F.round(ref - F.col("macro_f1"), 4))


def regression_gate(
    current: DataFrame, baseline: DataFrame, max_drop: float = D.MAX_F1_DROP
) -> DataFrame:
    """Compare two one-row frames with ``f1``; a missing baseline passes."""
    both = current.select(F.lit("current").alias("kind"), "f1").unionByName(
        baseline.select(F.lit("baseline").alias("kind"), "f1"))
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("f1")))
    delta = F.col("current_f1") - F.col("baseline_f1")
    return both.agg(one("current").alias("current_f1"), one("baseline").alias("baseline_f1")).select(
        "current_f1", "baseline_f1", delta.alias("delta"),
        F.coalesce(~(delta < -max_drop), F.lit(True)).alias("ok"))


# --- clause boundaries ----------------------------------------------------------


def boundary_candidates(
    predicted: DataFrame, gold: DataFrame, tolerance: int = D.BOUNDARY_TOLERANCE
) -> DataFrame:
    """Predicted and gold starts of one document at most ``tolerance`` apart.

    Inputs are (doc_id, idx, offset). Offsets fall into cells of the tolerance
    width, each predicted start probes its own and both neighbour cells, and
    the equi-join on (doc_id, cell) keeps every comparison local.
    """
    width = max(tolerance, 1)
    cell = F.floor(F.col("offset") / width)
    probes = predicted.select(
        "doc_id", F.col("idx").alias("p_idx"), F.col("offset").alias("p_offset"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    targets = gold.select(
        "doc_id", F.col("idx").alias("g_idx"), F.col("offset").alias("g_offset"),
        cell.alias("cell"))
    distance = F.abs(F.col("p_offset") - F.col("g_offset"))
    return (
        probes.join(targets, ["doc_id", "cell"])
        .withColumn("distance", distance)
        .filter(F.col("distance") <= tolerance)
        .select("doc_id", "p_idx", "g_idx", "p_offset", "g_offset", "distance")
    )


def match_boundaries(
    predicted: DataFrame, gold: DataFrame, tolerance: int = D.BOUNDARY_TOLERANCE
) -> DataFrame:
    """Greedy one-to-one pairs, closest first, ties by (p_idx, g_idx).

    Starts more than the tolerance apart cannot compete, so a document's
    offsets are cut into runs at such gaps. A run without rivals needs no
    order; the others are settled by one walk over their sorted candidates,
    linear in their number.
    """
    points = predicted.select("doc_id", "offset").unionByName(
        gold.select("doc_id", "offset")).distinct()
    along = Window.partitionBy("doc_id").orderBy("offset")
    gap = F.col("offset") - F.lag("offset").over(along) > tolerance
    runs = points.withColumn("opens", F.coalesce(gap, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("opens").over(along)).select("doc_id", F.col("offset").alias("p_offset"), "run")
    candidates = boundary_candidates(predicted, gold, tolerance).join(
        runs, ["doc_id", "p_offset"])
    ordered = F.sort_array(F.collect_list(F.struct(
        "distance", F.col("p_idx").cast("int").alias("p_idx"), F.col("g_idx").cast("int").alias("g_idx")))).alias("pairs")
    rivals = F.greatest(*[F.size("pairs") - F.size(F.array_distinct(f"pairs.{side}")) for side in ("p_idx", "g_idx")]) > 0
    # runs in which nothing competes are settled as they are
    taken = _first_free(*[F.when(rivals, F.col(f"pairs.{side}")) for side in ("p_idx", "g_idx")])
    runs_of = candidates.groupBy("doc_id", "run").agg(ordered).withColumn("taken", taken)
    kept = F.when(F.col("taken").isNull(), F.col("pairs")).otherwise(F.transform("taken", lambda i: F.get("pairs", i)))
    return runs_of.select("doc_id", F.inline(kept)).select("doc_id", "p_idx", "g_idx")


@F.arrow_udf(returnType=ST.ArrayType(ST.IntegerType()))
def _first_free(left: pa.Array, right: pa.Array) -> pa.Array:
    """Positions of the pairs that a walk in order takes, each side once; linear in the pairs."""
    def walk(ps: list | None, gs: list | None) -> list | None:
        if ps is None:
            return None
        seen_p, seen_g, out = set(), set(), []
        for i, (p, g) in enumerate(zip(ps, gs, strict=True)):
            if p not in seen_p and g not in seen_g:
                seen_p.add(p)
                seen_g.add(g)
                out.append(i)
        return out

    return pa.array(map(walk, left.to_pylist(), right.to_pylist()), pa.list_(pa.int32()))


def boundary_scores(predicted: DataFrame, gold: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document and micro (``doc_id`` NULL) boundary precision, recall and F1."""
    one = lambda df, name: df.select(
        "doc_id", *[F.lit(int(name == n)).alias(n) for n in ("predicted", "gold", "matched")])
    counts = one(predicted, "predicted").unionByName(one(gold, "gold")).unionByName(
        one(matches, "matched")).groupBy("doc_id").agg(
        *[F.sum(n).alias(n) for n in ("predicted", "gold", "matched")])
    both = counts.rollup("doc_id").agg(
        *[F.sum(n).alias(n) for n in ("predicted", "gold", "matched")])
    m = F.col("matched")
    scored = with_f1(both, ratio(m, F.col("predicted")), ratio(m, F.col("gold")))
    return scored.withColumns({n: F.round(n, 4) for n in ("precision", "recall", "f1")})


def type_accuracy(spans: DataFrame) -> DataFrame:
    """Accuracy per gold type and overall (``clause_type`` NULL) on labeled spans."""
    counts = spans.filter(F.col("gold_type").isNotNull()).groupBy("gold_type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("gold_type") == F.col("predicted_type")).alias("correct"))
    return counts.rollup("gold_type").agg(
        F.sum("n").alias("n"), F.sum("correct").alias("correct")).select(
        F.coalesce("gold_type", F.lit("overall")).alias("clause_type"), "n", "correct",
        F.round(F.col("correct") / F.col("n"), 4).alias("accuracy")).filter("n > 0")


def coverage_summary(per_doc: DataFrame) -> DataFrame:
    return per_doc.agg(
        F.round(F.avg("coverage"), 4).alias("mean_coverage"),
        F.round(F.min("coverage"), 4).alias("min_coverage"),
        (F.min("coverage") >= D.COVERAGE_FLOOR).alias("coverage_ok"))


def readability_summary(
    grades: DataFrame, *keys: str, grade: str = "grade", target: float = D.TARGET_GRADE
) -> DataFrame:
    """Sample size, mean, median and share at or below the target grade.

    Grades carry two decimals, so the exact median's value counts stay small.
    The verdict uses the rounded mean; without a sample everything is NULL.
    """
    g = F.col(grade)
    summary = grades.groupBy(*keys).agg(
        F.count(g).alias("sample_size"),
        F.round(F.avg(g), 2).alias("avg_grade"),
        F.round(F.median(g), 2).alias("median_grade"),
        F.round(F.avg((g <= target).cast("double")), 3).alias("share_at_or_below_target"))
    return summary.withColumn("meets_target", F.col("avg_grade") <= target)


def scorecard(
    clauses: DataFrame, runs: DataFrame, latency: DataFrame, views: DataFrame
) -> DataFrame:
    """Acceptance criteria over the whole corpus: (criterion, measured, target, passed).

    ``clauses`` needs clause_type, conf, summary, violations, risk_level,
    n_factors; ``runs`` status; ``latency`` p95_ms; ``views`` page.
    """
    high = F.col("risk_level") == "high"
    clause_part = clauses.agg(
        F.avg(F.col("clause_type").isNotNull().cast("double")).alias("typed"),
        F.avg(F.coalesce(F.col("conf").between(0, 1), F.lit(False)).cast("double"))
        .alias("confident"),
        F.avg((F.coalesce(F.col("summary"), F.lit("")) != "").cast("double")).alias("summarised"),
        F.sum("violations").cast("double").alias("violations"),
        ratio(F.count_if(high & (F.col("n_factors") > 0)), F.count_if(high)).alias("explained"))
    run_part = runs.agg(
        ratio(F.count_if(F.col("status") == "completed"),
              F.count_if(F.col("status").isin("completed", "failed"))).alias("success"))
    view_part = views.agg(
        F.avg((F.coalesce(F.col("page"), F.lit("")) != "").cast("double")).alias("logged"))
    # fixed values: criterion, measure, target, direction
    criteria = (
        ("clauses_typed", "typed", 1.0, ">="),
        ("confidence_stored", "confident", 1.0, ">="),
        ("clauses_summarised", "summarised", 1.0, ">="),
        ("language_violations", "violations", 0.0, "<="),
        ("high_risk_explained", "explained", 0.8, ">="),
        ("run_success_rate", "success", 0.95, ">="),
        ("latency_p95_ms", "p95_ms", 60000.0, "<="),
        ("disclaimer_coverage", "logged", 1.0, ">="),
    )
    # four one-row aggregates, laid side by side as rows of one measure table
    parts = [
        part.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("measured"))
            for c in part.columns])))
        for part in (clause_part, run_part, latency.select("p95_ms"), view_part)]
    measures = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    spec = F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(n).alias("criterion"), F.lit(t).alias("target"),
                 F.lit(d).alias("direction")) for n, m, t, d in criteria])
    rule = F.filter(spec, lambda s: s["m"] == F.col("measure"))[0]
    return measures.withColumn("rule", rule).select(
        "rule.criterion", "measured", "rule.target",
        F.when(F.col("rule.direction") == ">=", F.col("measured") >= F.col("rule.target"))
        .otherwise(F.col("measured") <= F.col("rule.target")).alias("passed"))
