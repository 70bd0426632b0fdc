"""Prescriptive-language filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: ordered rewrites (pattern, replacement) -------------------------
REWRITES = (
    (r"\byou should consider\b", "some freelancers consider"),
    (r"\byou should not\b", "freelancers commonly avoid agreeing to"),
    (r"\byou should\b", "it is common to"),
    (r"\bwe (?:strongly )?recommend that you\b", "a common practice is to"),
    (r"\bwe (?:strongly )?recommend\b", "a common practice is"),
    (r"\bwe advise (?:you )?(?:to )?\b", "a common practice is to "),
    (r"\bour advice is\b", "a common observation is"),
    (r"\bmy advice is\b", "a common observation is"),
    (r"\byou need to renegotiate\b", "this term is often renegotiated"),
    (r"\bmake sure (?:that )?you\b", "signers often verify that they"),
)
# fixed values: flagged, never rewritten
FLAGGED = (r"\byou must (?:sign|reject|refuse|walk away)\b",)

_FLAGS = "(?iU)"
# A text that none of the patterns above matches needs no rule; one scan settles it.
# The same alternatives by their first words, sought only where a first letter stands.
_SUSPECT = _FLAGS + (
    r"(?=[ywom])\b(?:you (?:should\b|need to renegotiate\b|must (?:sign|reject|refuse|walk away)\b)"
    r"|we (?:(?:strongly )?recommend\b|advise (?:you )?(?:to )?\b)|(?:our|my) advice is\b|make sure (?:that )?you\b)")


def _found(col: Column, pattern: str) -> Column:
    # every pattern opens with a boundary and a letter, and the letter is cheaper to seek
    return F.when(col.rlike(f"{_FLAGS}(?={pattern[2]}){pattern}"), F.lit(pattern))


def sanitize(col: Column) -> Column:
    """``struct<text, rewrites, residual_flags>`` after all rewrites, in order."""
    rules = F.array(*[
        F.struct(F.lit(_FLAGS + pattern).alias("pattern"), F.lit(new).alias("new"))
        for pattern, new in REWRITES
    ])

    def step(state: Column, rule: Column) -> Column:
        return F.struct(
            F.regexp_replace(state["text"], rule["pattern"], rule["new"]).alias("text"),
            (state["rewrites"] + F.regexp_count(state["text"], rule["pattern"]))
            .alias("rewrites"),
        )

    def finish(state: Column) -> Column:
        flags = F.array_compact(F.array(*[_found(state["text"], p) for p in FLAGGED]))
        return F.struct(state["text"], state["rewrites"], flags.alias("residual_flags"))

    rewritten = F.aggregate(
        rules, F.struct(col.alias("text"), F.lit(0).alias("rewrites")), step, finish)
    untouched = F.struct(
        col.alias("text"), F.lit(0).alias("rewrites"),
        F.array().cast("array<string>").alias("residual_flags"))
    return F.when(col.rlike(_SUSPECT), rewritten).otherwise(untouched)


def violations(col: Column) -> Column:
    """Every prescriptive pattern present in the text as given."""
    patterns = [pattern for pattern, _ in REWRITES] + list(FLAGGED)
    found = F.array_compact(F.array(*[_found(col, pattern) for pattern in patterns]))
    return F.when(col.rlike(_SUSPECT), found).otherwise(F.array().cast("array<string>"))
