"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Only column expressions: a scan with a projection, no shuffle and no Python.
Patterns use possessive runs and look-behinds, so that a failed start is not
tried again inside the same run and long runs stay linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions.text import bind

# The base kinds in the order of their contract, then the added ones.
# (kind, text that must occur before the pattern is tried, pattern)
BASE_KINDS = (
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", "+", r"\+[0-9](?:[\x20().-]*+[0-9])++"),
)
ADDED_KINDS = (
    ("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}+){2,7}+(?:\x20?+[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])"),
    ("ssn", "-", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
)
KINDS = tuple(kind for kind, _, _ in BASE_KINDS + ADDED_KINDS)
# Words that make a kind likelier when they stand shortly before a span.
CONTEXT = {
    "email": "e-?mail|contact|write to|mailto|courriel|correo",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|credit|debit|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|tel[eé]fono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
}
# Score of a span before its context is read, and what a context word adds.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.9, "ssn": 0.3}
CONTEXT_BONUS, CONTEXT_CHARS, ADDED_THRESHOLD = 0.3, 40, 0.6


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod_97(iban: Column) -> Column:
    """Remainder of an account number by the rule of its check digits (1 for a right one)."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda total, c: F.when(
        c < "A", (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97).cast("int"))


def confirmed(kind: str, value: Column) -> Column:
    """Whether the validator of the kind accepts the matched text."""
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda part: ~part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return bind(digits(value), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "iban":
        return bind(F.translate(value, " ", ""), lambda v: F.length(v).between(15, 34) & (mod_97(v) == 1))
    return F.lit(True)


def before_each(lengths: Column) -> Column:
    """Sum of the elements before each element, in blocks of about the square root of their number."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))

    def total(values):
        return F.aggregate(values, F.lit(0), lambda a, b: a + b)

    def with_size(b):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / b).cast("int")),
                             lambda c: total(F.slice(lengths, c * b + 1, b)))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return bind(starts, lambda s: F.transform(lengths, lambda _, i: F.get(s, F.floor(i / b).cast("int"))
                    + total(F.slice(lengths, F.floor(i / b).cast("int") * b + 1, (i % b).cast("int")))))

    return F.when(F.size(lengths) > 0, bind(size, with_size)).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, kind: str, guard: str, pattern: str) -> Column:
    """array<struct<kind, start, end, score>> of the accepted spans of one kind, by start.

    Offsets count code points. The pieces between the matches give them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern)

    def placed(matches):
        parts = F.transform(matches, lambda m, i: F.struct(m.alias("value"), F.length(m).alias("n")))

        def located(gaps):
            steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), parts,
                               lambda gap, p: F.struct(gap.alias("gap"), p["value"].alias("value"), p["n"].alias("n")))
            advance = F.transform(steps, lambda s: F.length(s["gap"]) + s["n"])
            return F.transform(
                F.zip_with(steps, before_each(advance), lambda s, at: F.struct(s.alias("s"), at.alias("at"))),
                lambda x: F.struct(
                    F.lit(kind).alias("kind"), (x["at"] + F.length(x["s"]["gap"])).alias("start"),
                    (x["at"] + F.length(x["s"]["gap"]) + x["s"]["n"]).alias("end"),
                    F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(
                        F.right(x["s"]["gap"], F.lit(CONTEXT_CHARS)).rlike(rf"(?i)(?<!\pL)(?:{CONTEXT[kind]})(?!\pL)"),
                        CONTEXT_BONUS).otherwise(0.0)).alias("score"),
                    confirmed(kind, x["s"]["value"]).alias("ok")))

        return bind(pieces, located)

    spans = F.filter(bind(found, placed), lambda s: s["ok"])
    if kind in {k for k, _, _ in ADDED_KINDS}:
        spans = F.filter(spans, lambda s: s["score"] >= ADDED_THRESHOLD)
    spans = F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "score")]))
    wanted = F.instr(text, guard) > 0 if guard else text.rlike("[0-9][0-9\\x20-]") if kind == "card" else text.rlike("[A-Z]{2}[0-9]{2}")
    return F.when(wanted & text.rlike(pattern), spans).otherwise(
        F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans) for every row; a null text counts as empty and has no spans.

    Rows are independent: repeated rows give repeated results, other columns
    are left out, and an empty table gives an empty result. ``spans`` is
    ordered by kind as in ``KINDS``, then by start. Base kinds are kept
    whenever their validator accepts them; added kinds also need a score of
    ``ADDED_THRESHOLD``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = [spans_of(F.col("text"), *kind) for kind in BASE_KINDS + ADDED_KINDS]
    return rows.select("id", "text", F.concat(*spans).alias("spans"))


def span_digest(spans: Column, kinds) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, replacement: str = "[{}]") -> DataFrame:
    """(id, text) of ``find_personal_data`` with every span replaced by its kind; overlaps become one."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state, s):
        label = F.concat(*[F.lit(p) if p else s["kind"] for p in _around(replacement)])
        fresh = F.concat(state["out"], F.substr(F.col("text"), state["at"] + 1, s["start"] - state["at"]), label)
        return F.struct(F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"),
                        F.greatest(state["at"], s["end"]).alias("at"))

    return found.select("id", F.aggregate(
        ordered, start, step, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1))).alias("text"))


def _around(replacement: str):
    left, _, right = replacement.partition("{}")
    return [p for p in (left, None, right) if p != ""]


def number_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def op6_personal_data(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    base = [kind for kind, _, _ in BASE_KINDS]
    found = find_personal_data(docs)
    counts = [number_of(kind).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(span_digest(F.col("spans"), base), 256).alias("base_sha256"),
        span_digest(F.col("spans"), KINDS).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))
