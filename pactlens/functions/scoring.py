"""Classification rules, hybrid risk score, answer parsing and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens import domain as D
from pactlens.functions.text import WS, bind, strip


def lookup(mapping: dict, key: Column, default) -> Column:
    """Value of a small constant mapping, with a default for unknown keys."""
    entries = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def keyword_rule(lowered: Column) -> Column:
    """Index of the first matching keyword rule for a text as bytes; NULL when none matches."""
    result = None
    for index, (_, _, words) in enumerate(D.KEYWORD_RULES):
        hit = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(word.encode())) for word in words])
        result = F.when(hit, F.lit(index)) if result is None else result.when(hit, F.lit(index))
    return result


def classify_keywords(text: Column) -> Column:
    """``struct<clause_type, confidence>`` from the ordered keyword rules."""
    types = F.array(*[F.lit(rule[0]) for rule in D.KEYWORD_RULES])
    confidences = F.array(*[F.lit(rule[1]) for rule in D.KEYWORD_RULES])

    def answer(lowered: Column) -> Column:
        rule = keyword_rule(lowered)
        return bind(rule, lambda i: F.struct(
            F.coalesce(F.get(types, i), F.lit(D.KEYWORD_DEFAULT[0])).alias("clause_type"),
            F.coalesce(F.get(confidences, i), F.lit(D.KEYWORD_DEFAULT[1])).alias("confidence")))

    # bytes are searched faster than a string
    return bind(F.lower(text).cast("binary"), answer)


def served_type(clause_type: Column, confidence: Column) -> Column:
    """Unsure predictions are served as ``general``; the probability is kept."""
    return F.when(confidence < D.LOW_CONFIDENCE, F.lit(D.DEFAULT_TYPE)).otherwise(clause_type)


def map_provision(label: Column) -> Column:
    return lookup(D.PROVISION_TYPES, F.lower(strip(label)), D.DEFAULT_TYPE)


def question_category(question: Column, categories) -> Column:
    """First category, longest name first, that the question contains."""
    ordered = sorted(categories, key=len, reverse=True)
    return bind(question, lambda q: F.coalesce(*[
        F.when(q.contains(name), F.lit(name)) for name in ordered]))


def unit_interval(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def hybrid_score(
    clause_type: Column, confidence: Column, model_score: Column, n_factors: Column
) -> Column:
    density = F.least(F.greatest(n_factors, F.lit(0)) / F.lit(D.FACTOR_SATURATION), F.lit(1.0))
    severity = lookup(D.SEVERITY_PRIOR, clause_type, D.SEVERITY_PRIOR[D.DEFAULT_TYPE])
    return unit_interval(
        F.lit(D.WEIGHT_MODEL_SCORE) * unit_interval(model_score)
        + F.lit(D.WEIGHT_FACTORS) * density
        + F.lit(D.WEIGHT_UNCERTAINTY) * (F.lit(1.0) - unit_interval(confidence))
        + F.lit(D.WEIGHT_SEVERITY) * severity
    )


def hybrid_level(score: Column) -> Column:
    return (
        F.when(score >= D.HYBRID_HIGH, "high")
        .when(score >= D.HYBRID_MEDIUM, "medium")
        .otherwise("low")
    )


def model_level(score: Column) -> Column:
    """Level from the model score alone; the hybrid level replaces it later."""
    return (
        F.when(score < D.MODEL_MEDIUM, "low")
        .when(score < D.MODEL_HIGH, "medium")
        .otherwise("high")
    )


def parse_score(raw: Column, strict: bool = True) -> Column:
    """Number in a free-text answer, clamped to [0, 1]; 0.5 when there is none.

    ``strict`` keeps the published reading, in which "1.0" yields .0; with
    ``strict=False`` a leading digit belongs to the number.
    """
    pattern = r"0?\.\d+" if strict else r"\d*\.\d+"
    decimal = F.nullif(F.regexp_extract(raw, pattern, 0), F.lit(""))
    digit = F.nullif(F.regexp_extract(raw, "[01]", 0), F.lit(""))
    number = F.coalesce(decimal, digit).try_cast("double")
    return unit_interval(F.coalesce(number, F.lit(0.5)))


def parse_factors(raw: Column) -> Column:
    """Factor list from a bulleted or comma-separated answer."""
    lines = F.transform(
        F.split(raw, "\n"),
        lambda line: strip(F.regexp_replace(line, rf"\A(?:[\-*\d.]|{WS})+", "")))
    items = F.transform(F.split(raw, ","), strip)
    kept = F.filter(
        F.when(raw.contains("\n"), lines).otherwise(items), lambda item: item != "")
    empty = raw.isNull() | (raw == "") | F.lower(strip(raw)).isin("none", "n/a", "null")
    return F.when(empty, F.array().cast("array<string>")).otherwise(kept)


def normalise_factors(stored: Column) -> Column:
    """Stored JSON factors as a clean list: list, single string or NULL."""
    listed = F.filter(
        F.transform(F.from_json(stored, "array<string>"), strip),
        lambda item: item.isNotNull() & (item != ""))
    single = strip(F.coalesce(
        F.get_json_object(F.concat(F.lit('{"v":'), stored, F.lit("}")), "$.v"), stored))
    none = F.array().cast("array<string>")
    return (
        F.when(stored.isNull() | (strip(stored) == "null"), none)
        .when(F.ltrim(stored).startswith("["), F.coalesce(listed, none))
        .when(single == "", none)
        .otherwise(F.array(single))
    )


def pipeline_fingerprint(model: str, library: str, version: str, program: str) -> str:
    return f"{model}|{library}|v{version}|{program}"


def content_hash(text: Column, fingerprint: str) -> Column:
    return F.sha2(F.concat(text, F.lit("|" + fingerprint)), 256)


def program_tag(content: Column) -> Column:
    """Content address of a compiled program; ``opt:none`` when there is none."""
    return F.coalesce(
        F.concat(F.lit("opt:"), F.substring(F.sha2(content, 256), 1, 16)), F.lit("opt:none"))


def demo_answer(text: Column, clause_type: Column) -> Column:
    """Deterministic stand-in for a language model, derived from the text's hash."""
    first_byte = F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("double")
    jitter = (first_byte / F.lit(255.0) - F.lit(0.5)) * F.lit(0.30)
    base = lookup(D.DEMO_BASE_RISK, clause_type, D.DEMO_BASE_OTHER)
    score = F.greatest(F.lit(0.02), F.least(F.lit(0.98), base + jitter))
    factors = lookup(
        {kind: ", ".join(items) or "None" for kind, items in D.DEMO_FACTORS.items()},
        clause_type, "None")
    summary = F.concat(
        F.lit(D.DEMO_SUMMARY_OPEN), F.translate(clause_type, "_", " "),
        F.lit(D.DEMO_SUMMARY_SPAN), F.length(text).cast("string"), F.lit(D.DEMO_SUMMARY_CLOSE))
    return F.struct(
        summary.alias("summary"),
        factors.alias("factors_raw"),
        F.format_string("%.2f", score).alias("score_raw"),
    )


def digest_line(index: Column, clause_type: Column, level: Column, summary: Column) -> Column:
    return F.format_string(
        "#%d [%s] risk=%s: %s", index, clause_type, level,
        F.substring(F.coalesce(summary, F.lit("")), 1, 140))


def finding_line(title: Column, detail: Column) -> Column:
    return F.concat(F.lit("MISSING PROTECTION: "), title, F.lit(" — "), detail)


def demo_contract_summary(
    n_clauses: Column, high: Column, medium: Column, low: Column, missing: Column
) -> Column:
    """Offline executive summary from the distribution and missing protections."""
    opening = F.format_string(
        D.DEMO_CONTRACT_OPEN + "%d clauses: %d rated high risk, %d medium, and %d low.",
        n_clauses, high, medium, low)
    review = F.when(
        F.size(missing) > 0,
        F.concat(F.lit(D.DEMO_CONTRACT_FLAGGED), F.array_join(missing, "; "), F.lit(".")),
    ).otherwise(F.lit(D.DEMO_CONTRACT_COVERED))
    return F.concat_ws(" ", opening, review, F.lit(D.DEMO_CONTRACT_CLOSE))


def output_quality(
    summary: Column, factors_raw: Column, score_raw: Column,
    expected_factors: Column, expected_score: Column,
) -> Column:
    """Quality of one answer in [0, 1]: summary length, factor agreement, score distance."""
    factors = parse_factors(factors_raw)
    distance = F.abs(parse_score(score_raw) - expected_score)
    expects_none = F.lower(expected_factors) == "none"
    none_given = (F.size(factors) == 0) | (F.lower(F.get(factors, F.lit(0))) == "none")
    agree = F.when(expects_none, none_given).otherwise(F.size(factors) > 0)
    return (
        F.when(F.length(strip(summary)) > 30, 0.4).otherwise(0.0)
        + F.when(agree, 0.3).otherwise(0.0)
        + F.when(distance <= 0.2, 0.3).when(distance <= 0.4, 0.15).otherwise(0.0)
    )


def merge_metadata(stored: Column, patch: Column) -> Column:
    """Run metadata with a patch applied on top; the patch wins on equal keys."""
    base = F.coalesce(F.from_json(stored, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda key, _: ~F.array_contains(F.map_keys(patch), key))
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(F.map_concat(kept, patch)))))


def annotation_label(raw: Column) -> Column:
    """Trimmed lower-case label; spellings of "no label" become NULL."""
    value = F.lower(strip(raw))
    return F.when(~value.isin(*D.NULL_LABELS), value)


