"""Document assembly from page and span tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.functions import text as T
from pactlens.session import built_once


def _joined(pages: Column) -> Column:
    return T.strip(F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n"))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, text) -> one text per document, blank pages dropped."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return (
        pages.filter(~T.is_blank(F.col("text")))
        .groupBy("doc_id").agg(ordered.alias("pages"))
        .select("doc_id", _joined(F.col("pages")).alias("full_text"),
                F.size("pages").alias("text_pages"))
    )


def fill_page_gaps(
    digital: DataFrame, fallback: DataFrame | None = None,
    cap: int | None = None, enabled: bool = True,
) -> DataFrame:
    """Fill blank digital pages from a second text source.

    With ``cap``, the second source is used only when a document has at most
    so many blank pages; otherwise the reason is recorded. ``fallback=None``
    means the source is not available.
    """
    if fallback is None:
        paired = digital.withColumn("fallback_text", F.lit(None).cast("string"))
    else:
        paired = digital.join(
            fallback.select("doc_id", "page_no", F.col("text").alias("fallback_text")),
            ["doc_id", "page_no"], "left")
    page = F.struct(
        "page_no",
        F.when(~T.is_blank(F.col("text")), F.col("text")).alias("text"),
        F.when(~T.is_blank(F.col("fallback_text")), F.col("fallback_text")).alias("other"))
    docs = paired.groupBy("doc_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    empty = F.filter("pages", lambda p: p["text"].isNull())
    n_empty = F.size(empty)
    usable = F.lit(enabled and fallback is not None)
    if cap is not None:
        usable = usable & (n_empty <= cap)
    filled = F.filter(
        F.transform("pages", lambda p: F.struct(
            p["page_no"].alias("page_no"),
            F.coalesce(p["text"], F.when(usable, p["other"])).alias("text"),
            p["text"].isNull().alias("was_empty"))),
        lambda p: p["text"].isNotNull())
    recovered = F.filter(filled, lambda p: p["was_empty"])
    lost = F.array_except(
        F.transform(empty, lambda p: p["page_no"]),
        F.transform(recovered, lambda p: p["page_no"]))
    if not enabled:
        reason = F.lit("OCR is disabled on the server")
    elif fallback is None:
        reason = F.lit("tesseract is not installed on the server")
    elif cap is None:
        reason = F.lit(None).cast("string")
    else:
        reason = F.when(n_empty > cap, F.format_string(
            f"%d scanned pages exceed the {cap}-page OCR limit", n_empty))
    return docs.select(
        "doc_id",
        _joined(filled).alias("full_text"),
        F.size("pages").alias("page_count"),
        F.size(filled).alias("text_pages"),
        F.size(recovered).alias("ocr_pages"),
        lost.alias("unreadable_pages"),
        F.when(n_empty > 0, reason).alias("ocr_error"),
    )


def roll_up_lines(spans: DataFrame) -> DataFrame:
    """Typographic spans -> lines with largest size and an all-bold flag."""
    ordered = F.sort_array(F.collect_list(F.struct("span_no", F.coalesce("text", F.lit("")).alias("text"))))
    bold = F.coalesce("flags", F.lit(0)).bitwiseAND(T.BOLD_FLAG) != 0
    return (
        spans.groupBy("doc_id", "line_no")
        .agg(
            F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("text"),
            F.max(F.coalesce(F.col("size"), F.lit(0.0))).alias("max_size"),
            F.every(bold).alias("all_bold"))
        .filter(~T.is_blank(F.col("text")))
    )


def layout_segments(lines: DataFrame) -> DataFrame:
    """Segments of each document that open at a typographic heading.

    Returns (doc_id, segment_id, text); lines before the first heading form
    segment 0, and a heading on the first line opens that same segment.
    """
    shown = lines.filter(~T.is_blank(F.col("text")))
    body = shown.groupBy("doc_id").agg(F.median("max_size").alias("body_size"))
    heading = T.is_heading_line(
        F.col("text"), F.col("max_size"), F.col("all_bold"), F.col("body_size"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    marked = shown.join(body, "doc_id").select(
        "doc_id", "line_no", T.rstrip(F.col("text")).alias("text"),
        heading.alias("heading"), F.row_number().over(order).alias("n"))
    opened = F.sum((F.col("heading") & (F.col("n") > 1)).cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return (
        marked.withColumn("segment_id", opened.cast("int"))
        .groupBy("doc_id", "segment_id")
        .agg(T.strip(F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).alias("text"))
        .filter(F.col("text") != "")
    )


@built_once
def _segments(text: str) -> Column:
    return T.segment_text(F.col(text))


def clauses_of(documents: DataFrame, text: str = "text", segments: Column | None = None) -> DataFrame:
    """Documents -> clauses (doc_id, clause_index from 1, raw_text), without a shuffle."""
    parts = _segments(text) if segments is None else segments
    # exploding a column of its own would let the optimiser filter on its size, which segments every text twice
    return documents.select("doc_id", F.posexplode(parts).alias("_pos", "raw_text")).select(
        "doc_id", (F.col("_pos") + 1).alias("clause_index"), "raw_text")
