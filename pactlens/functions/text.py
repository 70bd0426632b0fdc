"""Text expressions: whitespace, segmentation, clean-up, anchors, shingles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_type

from pactlens.domain import SHINGLE_WORDS

# Every character that counts as whitespace; the built-in trim only knows spaces.
WHITESPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NON_WS = WS.replace("[", "[^", 1)
WS_NOT_NEWLINE = WS.replace(r"\t-\r", r"\t\x0b-\r")
ALNUM = r"[\p{L}\p{N}]"
WORD_CHAR = r"[\p{L}\p{N}_]"

# --- fixed values: patterns -----------------------------------------------------
HEADING_WORDS = r"(?:ARTICLE|SECTION|CLAUSE)" + WS + r"+[0-9IVXL]+"
HEADING_NUMBER = r"\d{1,2}(?:\.\d{1,2})*+[.)]" + WS + "+"
HEADING_SPLIT = rf"(?=(?mdiu)^[ \t]*(?:{HEADING_WORDS}|{HEADING_NUMBER}[A-Z]))"
HEADING_LINE = rf"(?iu)\A[ \t]*(?:{HEADING_WORDS}|{HEADING_NUMBER}{NON_WS})"
BOLD_FLAG = 16
HEADING_SIZE_RATIO = 1.15
BOLD_HEADING_CHARS = 80
MIN_FRAGMENT_CHARS = 15
MONEY = (
    r"(?iu)(?:(?:US\$|USD|EUR|GBP|\$|£|€)" + WS + r"?\d[\d,]*(?:\.\d+)?"
    r"(?:" + WS + r"?(?:million|billion|thousand|m|bn|k))?"
    r"|\d[\d,]*(?:\.\d+)?" + WS + r"?(?:dollars|euros|pounds|usd|eur|gbp))"
)
PERCENT = r"(?iU)\d+(?:\.\d+)?\s*(?:%|(?:percent|per cent|pct)\b)"
PERIOD = (
    r"(?iU)\b\d+\s?[-]?\s?(?:day|days|week|weeks|month|months|year|years|hour|hours"
    r"|business day|business days|calendar day|calendar days)\b"
)
MONEY_TOKEN = "__MONETARY_AMOUNT__"
PERCENT_TOKEN = "__PERCENTAGE__"
PERIOD_TOKEN = "__TIME_PERIOD__"
PRESERVED_WORDS = (
    "not", "no", "only", "nothing", "neither", "nor", "never",
    "without", "except", "unless",
)
BOILERPLATE_WORDS = (
    "herein", "hereinafter", "hereinabove", "hereinbefore", "hereof", "hereto",
    "heretofore", "hereunder", "hereby", "thereto", "thereof", "therein",
    "thereunder", "therewith", "wherein", "whereof", "whereas", "witnesseth",
    "aforesaid", "aforementioned", "notwithstanding", "pursuant",
    "such", "said", "the", "this", "that", "these", "those",
)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def normalise_whitespace(col: Column) -> Column:
    """Every whitespace run becomes one space; ends are stripped."""
    # a single space before a printable ASCII character stays as it is
    return F.btrim(F.regexp_replace(col, f"(?![!-~]| [!-~]){WS}++", " "), F.lit(" "))


def _from_window(window: Column, limit: int, pos: int, whole: Column) -> Column:
    """``limit`` characters of a normalised text from ``window``, an end of it, or else from ``whole``."""
    def take(found: Column) -> Column:
        return F.when((F.length(found) >= limit) | (F.length(window) < 2 * limit), F.substring(found, pos, limit))

    return F.coalesce(bind(normalise_whitespace(window), take), whole)


def preview(col: Column, limit: int = 200) -> Column:
    """The first ``limit`` characters of the normalised text."""
    text = F.coalesce(col, F.lit(""))
    # ``limit`` characters that are not whitespace are enough to fill it
    head = F.regexp_extract(text, rf"\A(?:{WS}*+{NON_WS}){{0,{limit}}}", 0)
    return _from_window(F.substring(text, 1, 2 * limit), limit, 1, F.substring(normalise_whitespace(head), 1, limit))


def preview_end(col: Column, limit: int) -> Column:
    """The last ``limit`` characters of the normalised text, all of a shorter one."""
    text = F.coalesce(col, F.lit(""))
    return _from_window(
        F.substring(text, -2 * limit, 2 * limit), limit, -limit, F.substring(normalise_whitespace(text), -limit, limit))


def _strip_part(part: Column) -> Column:
    """``strip``, whose search from the right lists every character: only where the last byte may be whitespace."""
    printable = F.substring(part.cast("binary"), -1, 1).between(F.lit(b"!"), F.lit(b"~"))
    return F.when(printable, F.ltrim(part, F.lit(WHITESPACE))).otherwise(strip(part))


def _stripped_parts(parts: Column) -> Column:
    return F.filter(F.transform(parts, _strip_part), lambda part: part != "")


def split_blank_lines(col: Column) -> Column:
    return _stripped_parts(F.split(col, rf"\n{WS}*\n"))


def split_headings(col: Column) -> Column:
    """Split before every line that looks like a numbered or named heading."""
    return _stripped_parts(F.split(col, HEADING_SPLIT))


def is_heading_line(text: Column, size: Column, all_bold: Column, body_size: Column) -> Column:
    """Numbered, clearly larger than body text, or short and fully bold."""
    stripped = strip(text)
    return (stripped != "") & (
        stripped.rlike(HEADING_LINE)
        | (size > body_size * HEADING_SIZE_RATIO)
        | (all_bold & (F.length(stripped) < BOLD_HEADING_CHARS))
    )


# noncharacters, which mark the seams between pieces and the ends of groups
_SEAM, _END = "\ufdd0", "\ufdd1"
_LOOSE = WS.replace("]", _SEAM + "]")
# the shortest run of whole pieces whose joined and stripped text is long enough
_GROUP = (rf"\G{_LOOSE}*+{_LOOSE.replace('[', '[^', 1)}[\s\S]{{{MIN_FRAGMENT_CHARS - 2},}}?{_LOOSE.replace('[', '[^', 1)}"
          rf"{WS}*+(?={_SEAM}|\z)")


def fold_fragments(parts: Column) -> Column:
    """Join pieces that are too short to stand alone with the piece that follows.

    A trailing short piece joins the one before it. The pieces are joined once
    and one pattern finds where each group of them closes, in a single pass and
    without a copy per piece. Only documents that hold a short piece are
    searched, and only those that hold the marks themselves are folded.
    """
    def groups(joined: Column) -> Column:
        marked = F.split(F.regexp_replace(joined, f"({_GROUP})", f"$1{_END}"), _END)
        return bind(marked, lambda found: F.when(F.size(found) < 2, found).otherwise(F.concat(
            F.slice(found, F.lit(1), F.size(found) - 2),
            F.array(F.concat(F.element_at(found, -2), F.element_at(found, -1))))))

    def fold(joined: Column) -> Column:
        return F.when(joined.rlike(f"[{_SEAM}{_END}]"), _fold_by_steps(parts)).otherwise(
            F.transform(groups(F.array_join(parts, _SEAM)), lambda part: F.replace(part, F.lit(_SEAM), F.lit("\n"))))

    short = F.exists(parts, lambda part: F.length(_strip_part(part)) < MIN_FRAGMENT_CHARS)
    return F.when(short, _stripped_parts(fold(F.array_join(parts, "")))).otherwise(_stripped_parts(parts))


def _fold_by_steps(parts: Column) -> Column:
    """The same piece by piece, for texts that hold the marks."""
    is_short = lambda part: F.length(strip(part)) < MIN_FRAGMENT_CHARS
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("open"),
    )

    def step(state: Column, part: Column) -> Column:
        whole = F.when(state["open"].isNull(), part).otherwise(
            F.concat(state["open"], F.lit("\n"), part))
        return bind(whole, lambda joined: F.struct(
            F.when(is_short(joined), state["done"])
            .otherwise(F.concat(state["done"], F.array(joined))).alias("done"),
            F.when(is_short(joined), joined).alias("open"),
        ))

    def finish(state: Column) -> Column:
        done, rest = state["done"], state["open"]
        last = F.concat(F.element_at(done, -1), F.lit("\n"), rest)
        return (
            F.when(rest.isNull(), done)
            .when(F.size(done) == 0, F.array(rest))
            .otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(last)))
        )

    return F.aggregate(parts, start, step, finish)


def segment_text(col: Column, layout_segments: Column | None = None) -> Column:
    """Clause texts of a document: blank lines, else layout, else headings, else whole."""
    def by_headings(text: Column, blank: Column) -> Column:
        return bind(split_headings(text), lambda headings: F.when(
            F.size(headings) > 1, fold_fragments(headings)).otherwise(blank))

    def choose(text: Column, blank: Column) -> Column:
        chosen = F.when(F.size(blank) > 1, fold_fragments(blank))
        if layout_segments is not None:
            chosen = chosen.when(
                F.coalesce(F.size(layout_segments), F.lit(0)) > 1, fold_fragments(layout_segments))
        return chosen.otherwise(by_headings(text, blank))

    # the text and its paragraphs are each computed once
    return bind(col, lambda text: bind(
        split_blank_lines(text), lambda blank: choose(text, blank)))


def non_whitespace_length(col: Column) -> Column:
    return F.length(F.regexp_replace(col, WS + "+", ""))


def coverage_ratio(col: Column, parts: Column) -> Column:
    """Share of the source's non-whitespace characters that the parts keep."""
    source = non_whitespace_length(col)
    kept = F.aggregate(
        parts, F.lit(0).cast("long"), lambda acc, part: acc + non_whitespace_length(part))
    return F.when(source == 0, F.lit(1.0)).otherwise(kept / source)


def search_parts(text: str | None, needles: list | None) -> dict | None:
    """``locate_parts`` of one text, whose parts are normalised already."""
    if text is None or needles is None:
        return None
    offsets, cursor = [], 0
    for position, needle in enumerate(needles):
        if needle:
            at = text.find(needle, cursor)
            if at < 0:
                return {"offsets": offsets, "missing": position}
            offsets.append(at)
            cursor = at + len(needle)
    return {"offsets": offsets, "missing": None}


LOCATED = ST.StructType([ST.StructField("offsets", ST.ArrayType(ST.IntegerType())), ST.StructField("missing", ST.IntegerType())])


@F.arrow_udf(returnType=LOCATED)
def _located(texts: pa.Array, parts: pa.Array) -> pa.Array:
    return pa.array(map(search_parts, texts.to_pylist(), parts.to_pylist()), to_arrow_type(LOCATED))


# so that no filter is pushed below the search, which would run it twice
_searched = _located.asNondeterministic()


def locate_parts(text: Column, parts: Column) -> Column:
    """Offsets (0-based) of ordered parts in ``text``, searched with a moving cursor.

    Returns ``struct<offsets array<int>, missing int>``; ``missing`` is the
    0-based position of the first part that cannot be found, NULL if all are.
    A cursor that walks through one text is no expression, and every search
    from a place inside a text would walk there from the text's beginning, so
    the walk is done for the texts of an Arrow batch; not to be used in lambdas.
    """
    return _searched(text, F.transform(parts, normalise_whitespace))


_ANCHORED = ST.ArrayType(ST.StructType([
    ST.StructField("id", ST.IntegerType()), ST.StructField("start", ST.IntegerType()), ST.StructField("end", ST.IntegerType()),
    ST.StructField("start_problem", ST.StringType()), ST.StructField("end_problem", ST.StringType())]))


@F.arrow_udf(returnType=_ANCHORED)
def _anchored(texts: pa.Array, quotes: pa.Array) -> pa.Array:
    def walk(text: str | None, clauses: list | None) -> list | None:
        if text is None or clauses is None:
            return None

        def problem(needle: str) -> str:
            return "empty" if not needle else "earlier" if needle in text else "absent"

        spans, cursor = [], 0
        for c in clauses:
            head, tail = c["head"], c["tail"]
            begin = text.find(head, cursor) if head else -1
            close = text.find(tail, begin) if begin >= 0 and tail else -1
            spans.append({
                "id": c["id"], "start": begin if begin >= 0 else None, "end": close + len(tail) if close >= 0 else None,
                "start_problem": problem(head) if begin < 0 else None,
                "end_problem": problem(tail) if begin >= 0 and tail and close < 0 else None})
            if close >= 0:
                cursor = close + len(tail)
            elif begin >= 0:
                cursor = max(cursor, begin + len(head))
        return spans

    return pa.array(map(walk, texts.to_pylist(), quotes.to_pylist()), to_arrow_type(_ANCHORED))


_walked = _anchored.asNondeterministic()


def resolve_anchors(text: Column, clauses: Column) -> Column:
    """Bind annotated clauses to spans of the whitespace-normalised ``text``.

    ``clauses`` is an ordered ``array<struct<id, anchor_start, anchor_end, ...>>``.
    Each search starts at the cursor left by the clause before. The result
    keeps one entry per clause, in order, with ``start`` NULL when the head
    anchor did not resolve and ``end`` NULL when the clause runs to the next.
    Like ``locate_parts`` it walks through the texts of an Arrow batch.
    """
    return _walked(text, F.transform(clauses, lambda c: F.struct(
        c["id"].cast("int").alias("id"),
        normalise_whitespace(F.coalesce(c["anchor_start"], F.lit(""))).alias("head"),
        normalise_whitespace(F.coalesce(c["anchor_end"], F.lit(""))).alias("tail"))))


_ARTIFACT_LINE = rf"(?:confidential|draft|exhibit{WS}+[a-z0-9]+|page{WS}+\d+|\d+{WS}*/{WS}*\d+)"


def clean_page_artifacts(col: Column) -> Column:
    """Undo line-break hyphens, page numbers, running headers and trailing blanks.

    A text of one line can only be a running header as a whole.
    """
    text = F.regexp_replace(col, rf"({WORD_CHAR}+)-{WS}*\n{WS}*({WORD_CHAR}+)", "$1$2")
    text = F.regexp_replace(
        text, rf"(?iu)\n{WS}*(?:page{WS}*)?\d{{1,4}}{WS}*(?:of{WS}*\d{{1,4}})?{WS}*\n", "\n")
    text = F.regexp_replace(text, rf"(?mdiu)^{WS}*{_ARTIFACT_LINE}{WS}*$", "")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    line = F.when(col.rlike(rf"(?diu)\A{WS}*{_ARTIFACT_LINE}{WS}*\z"), "").otherwise(col)
    return strip(F.when(col.contains("\n"), text).otherwise(line))


def mark_numbers(col: Column) -> Column:
    """Replace money, percentages and time periods (in that order) by sentinels."""
    text = F.regexp_replace(col, MONEY, MONEY_TOKEN)
    text = F.regexp_replace(text, PERCENT, PERCENT_TOKEN)
    return F.regexp_replace(text, PERIOD, PERIOD_TOKEN)


def number_annotations(col: Column) -> Column:
    """The same spans as values: ``array<struct<annotation_type, value>>``."""
    without_money = F.regexp_replace(col, MONEY, MONEY_TOKEN)
    without_percent = F.regexp_replace(without_money, PERCENT, PERCENT_TOKEN)

    def typed(kind: str, source: Column, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(source, F.lit(pattern), F.lit(0)),
            lambda value: F.struct(F.lit(kind).alias("annotation_type"), value.alias("value")))

    return F.concat(
        typed("amount", col, MONEY),
        typed("percentage", without_money, PERCENT),
        typed("period", without_percent, PERIOD),
    )


def legal_stop_words(base: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Base list plus boilerplate, minus words that flip a clause's meaning."""
    words = {word.lower() for word in base} | set(BOILERPLATE_WORDS)
    return sorted(words - set(PRESERVED_WORDS))


def general_stop_words() -> list[str]:
    """The list above on the English stop words that Spark ships; needs an active session."""
    from pyspark.ml.feature import StopWordsRemover
    return legal_stop_words(StopWordsRemover.loadDefaultStopWords("english"))


def remove_stop_words(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda token: ~F.lower(token).isin(words))


def modal_counts(col: Column) -> dict[str, Column]:
    """Deontic modal verbs; a "shall not" is not counted as "shall" again."""
    def count(pattern: str) -> Column:
        return F.regexp_count(col, F.lit(rf"(?iU)\b{pattern}\b"))

    shall_not = count(r"shall\s+not")
    return {
        "count_shall": F.greatest(count("shall") - shall_not, F.lit(0)),
        "count_shall_not": shall_not,
        "count_may": count("may"),
        "count_must": count("must"),
    }


def _shingles(col: Column, k: int, make, empty: str) -> Column:
    tokens = F.filter(F.split(F.lower(col), WS + "+"), lambda token: token != "")

    def windows(words: Column) -> Column:
        # positional reads: slicing would copy the whole array for every shingle
        many = F.transform(
            F.sequence(F.lit(0), F.size(words) - k),
            lambda i: make(*[F.get(words, i + j) for j in range(k)]))
        return (
            F.when(F.size(words) >= k, F.array_distinct(many))
            .when(F.size(words) > 0, F.array(make(F.array_join(words, " "))))
            .otherwise(F.array().cast(empty))
        )

    return bind(tokens, windows)


def word_shingles(col: Column, k: int = SHINGLE_WORDS) -> Column:
    """Distinct lower-case k-word shingles; shorter texts give one shingle."""
    return _shingles(col, k, lambda *words: F.concat_ws(" ", *words), "array<string>")


def shingle_hashes(col: Column, k: int = SHINGLE_WORDS) -> Column:
    """The same set as sorted 64-bit hashes."""
    return F.sort_array(_shingles(col, k, F.xxhash64, "array<bigint>"))
