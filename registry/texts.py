"""F rows: expressions over document and clause texts."""

from __future__ import annotations

from pactlens.functions import language as L
from pactlens.functions import readability as B
from pactlens.functions import scoring as S
from pactlens.operators import evaluation as E
from pactlens.sources import pages as P
from registry.base import (
    D, F, PHRASES, T, Tables, query, quoted, spread, sql_case, sql_list, with_ctes)


def documents(t: Tables, *more: str):
    return spread(t.documents.select("doc_id", "text", *more))


@query("f1_blank_line_split", with_ctes(
    "SELECT doc_id, clause_index, raw_text FROM doc_clauses", "doc_clauses"))
def f1(t: Tables):
    return P.clauses_of(t.contract_texts(), segments=T.split_blank_lines(F.col("text")))


def _heading_texts(t: Tables):
    """Single-spaced documents in which every third line opens with a heading."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        F.when(i % 3 == 0, F.when(
            F.col("doc_id") % 2 == 0,
            F.concat(F.lit("ARTICLE "), (i + 1).cast("string"), F.lit(" Terms of the parties. ")))
            .otherwise(F.concat((i % 20 + 1).cast("string"), F.lit(". Terms of the parties. "))))
        .otherwise(F.lit("")), line))
    return documents(t).select("doc_id", F.array_join(lines, "\n").alias("text"))


_HEADING_TEXT_SQL = (
    "SELECT doc_id, string_agg(CASE WHEN line_no % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'ARTICLE ' "
    "|| (line_no + 1) || ' Terms of the parties. ' ELSE (line_no % 20 + 1) || '. Terms of the parties. ' "
    "END ELSE '' END || line, chr(10) ORDER BY line_no) AS text FROM doc_lines GROUP BY 1")


def _marked(column: str) -> str:
    return (f"regexp_replace({column}, '(?im)^([ \\t]*(?:(?:ARTICLE|SECTION|CLAUSE)\\s+[0-9IVXL]+|"
            "\\d{1,2}(?:\\.\\d{1,2})*[.)]\\s+[A-Z]))', chr(30) || '\\1', 'g')")


def _parts(source: str, parts: str) -> str:
    """Numbered, trimmed, non-empty list items per document."""
    return (
        "SELECT doc_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS clause_index, unnest(p) AS raw_text "
        f"FROM (SELECT doc_id, list_filter(list_transform({parts}, lambda x: trim(x, ' ' || chr(10))), "
        f"lambda x: x <> '') AS p FROM {source})")


@query("f2_heading_split", with_ctes(
    _parts("heads", f"string_split({_marked('text')}, chr(30))"), "doc_lines", heads=_HEADING_TEXT_SQL))
def f2(t: Tables):
    return P.clauses_of(_heading_texts(t), segments=T.split_headings(F.col("text")))


def layout_lines(t: Tables):
    rows = documents(t).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    seed = F.col("doc_id") + F.col("line_no")
    return rows.select(
        "doc_id", "line_no",
        F.when(F.col("line_no") % 4 == 2, F.concat(
            (F.col("line_no") % 20 + 1).cast("string"), F.lit(". "), F.col("line")))
        .otherwise(F.col("line")).alias("text"),
        (F.lit(10) + seed % 3 + F.when((F.col("doc_id") * 3 + F.col("line_no")) % 9 == 0, 3)
         .otherwise(0)).cast("double").alias("max_size"),
        (seed % 5 == 0).alias("all_bold"))


LAYOUT_SQL = (
    "SELECT doc_id, line_no, CASE WHEN line_no % 4 = 2 THEN (line_no % 20 + 1) || '. ' || "
    "line ELSE line END AS text, (10 + (doc_id + line_no) % 3 + CASE WHEN "
    "(doc_id * 3 + line_no) % 9 = 0 THEN 3 ELSE 0 END)::DOUBLE AS max_size, "
    "(doc_id + line_no) % 5 = 0 AS all_bold FROM doc_lines")
_BODY_SQL = "SELECT doc_id, median(max_size) AS body_size FROM lay WHERE trim(text) <> '' GROUP BY 1"
_IS_HEADING_SQL = (
    "(regexp_matches(trim(text), '(?i)^[ \\t]*(?:(?:ARTICLE|SECTION|CLAUSE)\\s+[0-9IVXL]+|"
    "\\d{1,2}(?:\\.\\d{1,2})*[.)]\\s+\\S)') OR max_size > body_size * 1.15::DOUBLE "
    "OR (all_bold AND length(trim(text)) < 80))")


@query("a20_body_font_size", with_ctes("SELECT * FROM body", "doc_lines", lay=LAYOUT_SQL, body=_BODY_SQL))
def a20(t: Tables):
    lines = layout_lines(t).filter(~T.is_blank(F.col("text")))
    return lines.groupBy("doc_id").agg(F.median("max_size").alias("body_size"))


@query("f3_heading_lines", with_ctes(
    f"SELECT doc_id, line_no::INTEGER AS line_no, {_IS_HEADING_SQL} AS heading FROM lay JOIN body "
    "USING (doc_id) WHERE trim(text) <> ''", "doc_lines", lay=LAYOUT_SQL, body=_BODY_SQL))
def f3(t: Tables):
    lines = layout_lines(t).filter(~T.is_blank(F.col("text")))
    body = lines.groupBy("doc_id").agg(F.median("max_size").alias("body_size"))
    return lines.join(body, "doc_id").select("doc_id", "line_no", T.is_heading_line(
        F.col("text"), F.col("max_size"), F.col("all_bold"), F.col("body_size")).alias("heading"))


@query("w5_layout_segments", with_ctes(
    "SELECT doc_id, segment_id, trim(string_agg(rtrim(text), chr(10) ORDER BY line_no), ' ' || chr(10)) AS text FROM "
    "(SELECT *, CAST(sum(CASE WHEN heading AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id "
    "ORDER BY line_no) AS INTEGER) AS segment_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id "
    f"ORDER BY line_no) AS rn, {_IS_HEADING_SQL} AS heading FROM lay JOIN body USING (doc_id) WHERE "
    "trim(text) <> '')) GROUP BY 1, 2", "doc_lines", lay=LAYOUT_SQL, body=_BODY_SQL))
def w5(t: Tables):
    return P.layout_segments(layout_lines(t))


@query("f4_fragment_fold", """SELECT doc_id, len(p)::INTEGER AS n_parts,
    md5(array_to_string(p, chr(30))) AS parts_md5 FROM (SELECT doc_id, list_filter(list_transform(
    string_split(CASE WHEN length(trim(list_last(string_split(j, chr(30))), ' ' || chr(10))) < 15
      AND contains(j, chr(30)) THEN regexp_replace(j, '\\x1e([^\\x1e]*)$', chr(10) || '\\1') ELSE j END,
    chr(30)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS p FROM (SELECT doc_id, list_reduce(
    string_split_regex(text, '[,\\n]'), lambda a, x: CASE WHEN length(trim(list_last(string_split(a,
    chr(30))), ' ' || chr(10))) < 15 THEN a || chr(10) || x ELSE a || chr(30) || x END) AS j
    FROM documents))""")
def f4(t: Tables):
    parts = T.fold_fragments(F.split("text", "[,\n]"))
    return documents(t).select("doc_id", parts.alias("p")).select(
        "doc_id", F.size("p").alias("n_parts"), F.md5(F.array_join("p", "\x1e")).alias("parts_md5"))


_MIXED_SQL = ("SELECT doc_id, clause_index, raw_text FROM doc_clauses WHERE doc_id % 3 = 0 UNION ALL "
              + _parts("(SELECT * FROM heads WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, text FROM "
                       "documents WHERE doc_id % 3 = 2)", f"string_split({_marked('text')}, chr(30))"))


def _mixed(t: Tables):
    """A third each: blank-line contracts, numbered contracts, plain prose."""
    k = F.col("doc_id") % 3
    return (t.contract_texts().filter(k == 0).unionByName(_heading_texts(t).filter(k == 1))
            .unionByName(documents(t).filter(k == 2)))


@query("f5_segment_text", with_ctes(_MIXED_SQL, "doc_clauses", heads=_HEADING_TEXT_SQL))
def f5(t: Tables):
    return P.clauses_of(_mixed(t))


@query("w4_clause_index", with_ctes(
    "SELECT doc_id, count(*) AS n_clauses, max(clause_index) AS last_index, sum(clause_index)::BIGINT AS "
    "index_sum FROM (" + _MIXED_SQL + ") GROUP BY 1", "doc_clauses", heads=_HEADING_TEXT_SQL))
def w4(t: Tables):
    return P.clauses_of(_mixed(t)).groupBy("doc_id").agg(
        F.count("*").alias("n_clauses"), F.max("clause_index").alias("last_index"),
        F.sum("clause_index").alias("index_sum"))


_NORM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query("f6_normalise_whitespace",
       f"SELECT doc_id, {_NORM.format('text')} AS text FROM documents")
def f6(t: Tables):
    return documents(t).select("doc_id", T.normalise_whitespace(F.col("text")).alias("text"))


@query("f8_locate_segments", with_ctes(
    "SELECT doc_id, clause_index, CAST(coalesce(sum(length(n) + 1) OVER (PARTITION BY doc_id ORDER BY "
    "clause_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM ("
    f"SELECT doc_id, clause_index, {_NORM.format('raw_text')} AS n FROM doc_clauses)", "doc_clauses"))
def f8(t: Tables):
    return segment_starts(t)


def segment_starts(t: Tables):
    from pactlens.plans.evaluate import predicted_starts
    return predicted_starts(t.contract_texts()).select(
        "doc_id", (F.col("idx") + 1).alias("clause_index"), F.col("offset").alias("start"))


KEYWORD_SQL = "(CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(raw_text), {quoted(w)})" for w in words) + f" THEN {i}"
    for i, (_, _, words) in enumerate(D.KEYWORD_RULES)) + " ELSE 7 END)"
TYPE_SQL = sql_list([r[0] for r in D.KEYWORD_RULES] + ["general"]) + f"[{KEYWORD_SQL} + 1]"
CONF_SQL = ("[" + ", ".join(f"{r[1]}::DOUBLE" for r in D.KEYWORD_RULES) + ", 0.5::DOUBLE]"
            f"[{KEYWORD_SQL} + 1]")
CTE_TYPED = f"SELECT doc_id, clause_index, raw_text, {TYPE_SQL} AS clause_type, {CONF_SQL} AS conf FROM doc_clauses"


def typed_clauses(t: Tables):
    return t.doc_clauses().withColumn("c", S.classify_keywords(F.col("raw_text"))).select(
        "doc_id", "clause_index", "raw_text", "c.clause_type", F.col("c.confidence").alias("conf"))


@query("f9_keyword_classifier", with_ctes(
    "SELECT doc_id, clause_index, clause_type, conf FROM typed", "doc_clauses", typed=CTE_TYPED))
def f9(t: Tables):
    return typed_clauses(t).select("doc_id", "clause_index", "clause_type", "conf")


# ---- answers of a scorer, derived from line items ---------------------------------------

_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ANSWER_SQL = (
    f"SELECT {_KEYS}, CASE l_suppkey % 8 WHEN 0 THEN '0.' || lpad((l_partkey % 100)::VARCHAR, 2, '0') "
    "WHEN 1 THEN '1.0' WHEN 2 THEN '1' WHEN 3 THEN 'high' WHEN 4 THEN 'Score: .' || (l_partkey % 10) || "
    "' of 1' WHEN 6 THEN '-0.5 or so' WHEN 7 THEN '12.75' END AS score_raw, CASE l_partkey % 6 WHEN 0 THEN "
    "'None' WHEN 1 THEN 'cap, fee ,' || l_suppkey WHEN 2 THEN '- one' || chr(10) || '2. two' || chr(10) || "
    "chr(10) || ' * three' WHEN 3 THEN '' WHEN 4 THEN ' n/a ' END AS factors_raw, "
    f"{sql_list(PHRASES)}[l_partkey % {len(PHRASES)} + 1] AS summary FROM lineitem")


def answers(t: Tables):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    k = supp % 8
    score = (
        F.when(k == 0, F.concat(F.lit("0."), F.lpad((part % 100).cast("string"), 2, "0")))
        .when(k == 1, "1.0").when(k == 2, "1").when(k == 3, "high")
        .when(k == 4, F.concat(F.lit("Score: ."), (part % 10).cast("string"), F.lit(" of 1")))
        .when(k == 6, "-0.5 or so").when(k == 7, "12.75"))
    m = part % 6
    factors = (
        F.when(m == 0, "None").when(m == 1, F.concat(F.lit("cap, fee ,"), supp.cast("string")))
        .when(m == 2, "- one\n2. two\n\n * three").when(m == 3, "").when(m == 4, " n/a "))
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    return t.lineitem.select(
        *_KEYS.split(", "), score.alias("score_raw"), factors.alias("factors_raw"),
        F.element_at(phrases, (part % len(PHRASES) + 1).cast("int")).alias("summary"))


SCORE_SQL = ("greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(nullif(regexp_extract(score_raw, '0?\\.\\d+'), '') "
             "AS DOUBLE), TRY_CAST(nullif(regexp_extract(score_raw, '[01]'), '') AS DOUBLE), 0.5)))")
FACTORS_SQL = (
    "(CASE WHEN factors_raw IS NULL OR lower(trim(factors_raw)) IN ('', 'none', 'n/a', 'null') THEN "
    "CAST([] AS VARCHAR[]) WHEN contains(factors_raw, chr(10)) THEN list_filter(list_transform(string_split("
    "factors_raw, chr(10)), lambda x: trim(regexp_replace(x, '^[\\-\\*\\d\\.\\s]+', ''))), lambda x: x <> '') "
    "ELSE list_filter(list_transform(string_split(factors_raw, ','), lambda x: trim(x)), lambda x: x <> '') END)")


@query("f13_parse_score", with_ctes(
    f"SELECT {_KEYS}, {SCORE_SQL} AS score FROM a", a=ANSWER_SQL))
def f13(t: Tables):
    return answers(t).select(*_KEYS.split(", "), S.parse_score(F.col("score_raw")).alias("score"))


@query("f14_parse_factors", with_ctes(
    f"SELECT {_KEYS}, len({FACTORS_SQL})::INTEGER AS n_factors, array_to_string({FACTORS_SQL}, '|') AS "
    "factors FROM a", a=ANSWER_SQL))
def f14(t: Tables):
    return answers(t).select(*_KEYS.split(", "), S.parse_factors(F.col("factors_raw")).alias("f")).select(
        *_KEYS.split(", "), F.size("f").alias("n_factors"), F.array_join("f", "|").alias("factors"))


@query("f31_normalise_factors", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 5
    WHEN 0 THEN 'cap|fee ' || l_suppkey WHEN 2 THEN 'late fee' WHEN 3 THEN 'open text' ELSE '' END AS factors
    FROM lineitem""")
def f31(t: Tables):
    k = F.col("l_partkey") % 5
    stored = (
        F.when(k == 0, F.concat(F.lit('["cap", " ", " fee '), F.col("l_suppkey").cast("string"), F.lit('"]')))
        .when(k == 1, "[]").when(k == 2, '" late fee "').when(k == 3, "open text"))
    return t.lineitem.select(
        *_KEYS.split(", "), F.array_join(S.normalise_factors(stored), "|").alias("factors"))


@query("f32_output_quality", with_ctes(
    f"SELECT {_KEYS}, (CASE WHEN length(trim(summary)) > 30 THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN CASE WHEN "
    "l_partkey % 2 = 0 THEN len(f) = 0 OR lower(f[1]) = 'none' ELSE len(f) > 0 END THEN 0.3::DOUBLE ELSE 0 END) + "
    "(CASE WHEN d <= 0.2 THEN 0.3::DOUBLE WHEN d <= 0.4 THEN 0.15::DOUBLE ELSE 0 END) AS quality FROM ("
    f"SELECT *, {FACTORS_SQL} AS f, abs({SCORE_SQL} - (l_suppkey % 11) / 10.0) AS d FROM a)", a=ANSWER_SQL))
def f32(t: Tables):
    expected = F.when(F.col("l_partkey") % 2 == 0, F.lit("None")).otherwise(F.lit("cap, fee"))
    return answers(t).select(*_KEYS.split(", "), S.output_quality(
        F.col("summary"), F.col("factors_raw"), F.col("score_raw"), expected,
        F.col("l_suppkey") % 11 / 10).alias("quality"))


# ---- language filter ---------------------------------------------------------------------


def sanitize_sql(source: str, column: str, keep: str) -> str:
    """Chained rewrites with a running count, one sub-select per rule."""
    sql = f"SELECT {keep}, {column} AS t, 0 AS n FROM {source}"
    for pattern, new in L.REWRITES:
        sql = (f"SELECT {keep}, regexp_replace(t, {quoted('(?i)' + pattern)}, {quoted(new)}, 'g') AS t, "
               f"n + len(regexp_extract_all(t, {quoted('(?i)' + pattern)})) AS n FROM ({sql})")
    return sql


@query("f15_language_filter", with_ctes(
    "SELECT doc_id, clause_index, t AS text, n::INTEGER AS rewrites, "
    f"regexp_matches(t, {quoted('(?i)' + L.FLAGGED[0])}) AS flagged FROM ("
    + sanitize_sql("doc_clauses", "raw_text", "doc_id, clause_index") + ")", "doc_clauses"))
def f15(t: Tables):
    return t.doc_clauses().select(
        "doc_id", "clause_index", L.sanitize(F.col("raw_text")).alias("s")).select(
        "doc_id", "clause_index", "s.text", "s.rewrites",
        (F.size("s.residual_flags") > 0).alias("flagged"))


_ALL_PATTERNS = [p for p, _ in L.REWRITES] + list(L.FLAGGED)


@query("f16_language_violations", with_ctes(
    "SELECT doc_id, clause_index, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(raw_text, {quoted('(?i)' + p)}) THEN {quoted(p)} END"
                for p in _ALL_PATTERNS)
    + "], lambda x: x IS NOT NULL), ' ; ') AS violations FROM doc_clauses", "doc_clauses"))
def f16(t: Tables):
    return t.doc_clauses().select(
        "doc_id", "clause_index",
        F.array_join(L.violations(F.col("raw_text")), " ; ").alias("violations"))


# ---- numbers, artifacts, words -------------------------------------------------------------

_MONEY_SQL = quoted(
    r"(?i)(?:(?:US\$|USD|EUR|GBP|\$|£|€)\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:million|billion|thousand|m|bn|k))?"
    r"|\d[\d,]*(?:\.\d+)?\s?(?:dollars|euros|pounds|usd|eur|gbp))")
_PERCENT_SQL = quoted(r"(?i)\d+(?:\.\d+)?\s*(?:%|(?:percent|per cent|pct)\b)")
_PERIOD_SQL = quoted(
    r"(?i)\b\d+\s?[-]?\s?(?:day|days|week|weeks|month|months|year|years|hour|hours|business day"
    r"|business days|calendar day|calendar days)\b")
_NO_MONEY = f"regexp_replace(raw_text, {_MONEY_SQL}, '__MONETARY_AMOUNT__', 'g')"
_NO_PERCENT = f"regexp_replace({_NO_MONEY}, {_PERCENT_SQL}, '__PERCENTAGE__', 'g')"


@query("f17_number_sentinels", with_ctes(
    f"SELECT doc_id, clause_index, regexp_replace({_NO_PERCENT}, {_PERIOD_SQL}, '__TIME_PERIOD__', 'g') "
    "AS text FROM doc_clauses", "doc_clauses"))
def f17(t: Tables):
    return t.doc_clauses().select(
        "doc_id", "clause_index", T.mark_numbers(F.col("raw_text")).alias("text"))


@query("f17_number_annotations", with_ctes(
    "SELECT annotation_type, value, count(*) AS n FROM ("
    f"SELECT 'amount' AS annotation_type, unnest(regexp_extract_all(raw_text, {_MONEY_SQL})) AS value FROM "
    f"doc_clauses UNION ALL SELECT 'percentage', unnest(regexp_extract_all({_NO_MONEY}, {_PERCENT_SQL})) FROM "
    f"doc_clauses UNION ALL SELECT 'period', unnest(regexp_extract_all({_NO_PERCENT}, {_PERIOD_SQL})) FROM "
    "doc_clauses) GROUP BY 1, 2", "doc_clauses"))
def f17_annotations(t: Tables):
    return t.doc_clauses().select(F.inline(T.number_annotations(F.col("raw_text")))).groupBy(
        "annotation_type", "value").agg(F.count("*").alias("n"))


def _dirty(t: Tables):
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        line, F.when(i % 4 == 0, F.lit("-")).when(i % 4 == 1, F.lit("  ")).otherwise(F.lit("")), F.lit("\n"),
        F.when(i % 5 == 0, F.concat(F.lit("Page "), i.cast("string"), F.lit(" of 99\n")))
        .when(i % 5 == 1, F.lit("CONFIDENTIAL\n")).when(i % 5 == 2, F.lit("\n\n\n"))
        .when(i % 5 == 3, F.lit("  Exhibit B2 \n")).otherwise(F.lit(""))))
    return documents(t).select("doc_id", F.array_join(lines, "").alias("text"))


_DIRTY_SQL = (
    "SELECT doc_id, string_agg(line || CASE line_no % 4 WHEN 0 THEN '-' WHEN 1 THEN '  ' ELSE '' END || chr(10) "
    "|| CASE line_no % 5 WHEN 0 THEN 'Page ' || line_no || ' of 99' || chr(10) WHEN 1 THEN 'CONFIDENTIAL' || "
    "chr(10) WHEN 2 THEN chr(10) || chr(10) || chr(10) WHEN 3 THEN '  Exhibit B2 ' || chr(10) ELSE '' END, '' "
    "ORDER BY line_no) AS text FROM doc_lines GROUP BY 1")
_W = r"[\p{L}\p{N}_]"


@query("f18_clean_page_artifacts", with_ctes(
    "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, "
    + quoted(rf"({_W}+)-\s*\n\s*({_W}+)") + ", '\\1\\2', 'g'), "
    + quoted(r"(?i)\n\s*(?:page\s*)?\d{1,4}\s*(?:of\s*\d{1,4})?\s*\n") + ", chr(10), 'g'), "
    + quoted(r"(?im)^\s*(?:confidential|draft|exhibit\s+[a-z0-9]+|page\s+\d+|\d+\s*/\s*\d+)\s*$") + ", '', 'g'), "
    + quoted(r"[ \t]+\n") + ", chr(10), 'g'), " + quoted(r"\n{3,}") + ", chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text "
    "FROM dirty", "doc_lines", dirty=_DIRTY_SQL))
def f18(t: Tables):
    return _dirty(t).select("doc_id", T.clean_page_artifacts(F.col("text")).alias("text"))


_BASE_WORDS = ("the", "and", "of", "to", "in", "or", "not", "no", "is", "it", "as", "on", "that", "for")
_STOP = T.legal_stop_words(_BASE_WORDS)


@query("f19_legal_stop_words", with_ctes(
    "SELECT doc_id, len(k)::INTEGER AS kept, md5(array_to_string(k, ' ')) AS words_md5 FROM (SELECT doc_id, list_filter("
    f"string_split(lower({_NORM.format('text')}), ' '), lambda w: w <> '' AND NOT list_contains({sql_list(_STOP)}, w)) "
    "AS k FROM documents)"))
def f19(t: Tables):
    tokens = F.filter(F.split(F.lower(T.normalise_whitespace(F.col("text"))), " "), lambda w: w != "")
    return documents(t).select("doc_id", T.remove_stop_words(tokens, _STOP).alias("k")).select(
        "doc_id", F.size("k").alias("kept"), F.md5(F.array_join("k", " ")).alias("words_md5"))


def _word_sql(word: str) -> str:
    return (f"len(list_filter(regexp_extract_all(lower(raw_text), '{_W}+'), lambda w: w = '{word}'))")


_SHALL_NOT = f"len(regexp_extract_all(lower(raw_text), '(?:^|[^\\p{{L}}\\p{{N}}_])shall\\s+not(?:[^\\p{{L}}\\p{{N}}_]|$)'))"


@query("f20_modal_counts", with_ctes(
    f"SELECT doc_id, clause_index, greatest({_word_sql('shall')} - {_SHALL_NOT}, 0)::INTEGER AS count_shall, "
    f"{_SHALL_NOT}::INTEGER AS count_shall_not, {_word_sql('may')}::INTEGER AS count_may, "
    f"{_word_sql('must')}::INTEGER AS count_must FROM doc_clauses", "doc_clauses"))
def f20(t: Tables):
    return t.doc_clauses().select(
        "doc_id", "clause_index", *[c.alias(n) for n, c in T.modal_counts(F.col("raw_text")).items()])


# ---- readability ------------------------------------------------------------------------------

_WORD_SQL = "'[\\p{L}\\p{N}]+(?:[''’.,\\-][\\p{L}\\p{N}]+)*'"
_WORDS_CTE = f"SELECT doc_id, regexp_extract_all(text, {_WORD_SQL}) AS words FROM documents"
# per word: vowel groups plus hiatus, minus one for an unvoiced e
_SYLLABLE_SQL = (
    "SELECT doc_id, CAST(sum(CASE WHEN n > 1 AND (silent OR medial) THEN n - 1 WHEN n < 1 THEN 1 ELSE n END) AS BIGINT) "
    "AS syllables FROM (SELECT doc_id, len(regexp_extract_all(w, '[aeiouy]+')) + len(regexp_extract_all(w, "
    "'[bdfhjkmprvwz]i[aou]|[bdfhjklmnprstvwxz]ua')) AS n, regexp_matches(w, '[^aeiouyl]e(?:ly|ful|less|ment|ness)$') AS medial, "
    "length(w) > 2 AND coalesce(regexp_matches(stem, '[gq]ue$') OR (regexp_matches(stem, '[^aeiouy]e$') AND NOT "
    "regexp_matches(stem, '[^aeiouyl]le$')), false) AS silent FROM (SELECT doc_id, w, CASE WHEN regexp_matches(w, "
    "'(?:[^dt]ed|[^sxzcgh]es)$') THEN left(w, length(w) - 1) WHEN w LIKE '%e' THEN w END AS stem FROM (SELECT doc_id, "
    "regexp_replace(lower(unnest(words)), '[^a-z]', '', 'g') AS w FROM words))) GROUP BY 1")


@query("f22_syllables", with_ctes(
    "SELECT d.doc_id, coalesce(s.syllables, 0)::INTEGER AS syllables FROM documents d LEFT JOIN s USING (doc_id)",
    words=_WORDS_CTE, s=_SYLLABLE_SQL))
def f22(t: Tables):
    return documents(t).select("doc_id", B.syllable_count(F.col("text")).alias("syllables"))


@query("f23_word_count", with_ctes(
    "SELECT doc_id, len(words)::INTEGER AS words FROM words", words=_WORDS_CTE))
def f23(t: Tables):
    return documents(t).select("doc_id", B.word_count(F.col("text")).alias("words"))


_ABBREVIATED_SQL = quoted(
    "^[\"'“‘”’()\\[\\]]*(?:" + "|".join(B.ABBREVIATIONS)
    + "|(?:[a-z]\\.)+[a-z]?)[\"'“‘”’()\\[\\]]*$")
# sentence units, then tokens; a token closes a sentence when the next one opens like one
_SENTENCE_SQL = (
    "SELECT doc_id, unit, string_agg(tok || CASE WHEN ends THEN chr(10) ELSE ' ' END, '' ORDER BY k) AS u FROM ("
    "SELECT *, coalesce(regexp_matches(tok, '[.!?]+[\"''”’)\\]]*$') AND regexp_matches(lead(tok) OVER (PARTITION BY doc_id, "
    "unit ORDER BY k), '^[\"''“‘(\\[]?[A-Z0-9]') AND NOT regexp_matches(lower(regexp_replace(tok, "
    "'^(.*?)[.!?]+[\"''”’)\\]]*$', '\\1')), " + _ABBREVIATED_SQL + "), false) AS ends FROM (SELECT doc_id, unit, "
    "unnest(toks) AS tok, generate_subscripts(toks, 1) AS k FROM (SELECT doc_id, unit, list_filter(string_split_regex(body, "
    "'[ \\n]+'), lambda x: x <> '') AS toks FROM (SELECT doc_id, unnest(units) AS body, generate_subscripts(units, 1) AS unit "
    "FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(replace(text, '…', '...'), '\\n[ \\t]*\\n+', chr(30), 'g'), "
    "'\\n([ \\t]*(?:[-*•‣▪–—]|\\(?\\d{1,3}[.)]|\\(?[A-Za-z][.)])[ \\t]+)', chr(30) || '\\1', 'g'), chr(30)) AS units FROM {src}))))) "
    "GROUP BY 1, 2")
_SENTENCES_CTE = (
    "SELECT doc_id, list_filter(list_transform(string_split(string_agg(u, chr(10) ORDER BY unit), chr(10)), lambda x: trim(x)), "
    "lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')) AS sentences FROM (" + _SENTENCE_SQL + ") GROUP BY 1")


def _prose(t: Tables):
    """Texts whose lines end in clause phrases, with a bullet on every fourth line."""
    from registry.base import phrase
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        F.when(i % 4 == 3, F.lit("- ")).otherwise(F.lit("")), line, F.lit(" "), phrase(F.col("doc_id"), i),
        F.when(i % 6 == 5, F.lit("\n")).otherwise(F.lit(""))))
    return documents(t).select("doc_id", F.array_join(lines, "\n").alias("text"))


_PROSE_SQL = (
    "SELECT doc_id, string_agg(CASE WHEN line_no % 4 = 3 THEN '- ' ELSE '' END || line || ' ' || "
    f"{sql_list(PHRASES)}[(doc_id * 7 + line_no * 5) % {len(PHRASES)} + 1] || CASE WHEN line_no % 6 = 5 THEN chr(10) ELSE '' END, "
    "chr(10) ORDER BY line_no) AS text FROM doc_lines GROUP BY 1")


@query("f24_sentences", with_ctes(
    "SELECT doc_id, len(sentences)::INTEGER AS n_sentences, md5(array_to_string(sentences, chr(10))) AS sentences_md5 FROM s",
    "doc_lines", prose=_PROSE_SQL, s=_SENTENCES_CTE.replace("{src}", "prose")))
def f24(t: Tables):
    clean = F.transform(B.split_sentences(F.col("text")), T.normalise_whitespace)
    return _prose(t).select("doc_id", clean.alias("s")).select(
        "doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


_GRADE_CTE = (
    "SELECT w.doc_id, len(w.words) AS n_words, CASE WHEN len(w.words) > 0 THEN greatest(0.0, 0.39 * (len(w.words) / "
    "greatest(coalesce(len(s.sentences), 0), 1)) + 11.8 * (y.syllables / len(w.words)) - 15.59) END AS raw_grade, "
    "coalesce(len(s.sentences), 0) AS n_sentences FROM words w LEFT JOIN s USING (doc_id) LEFT JOIN y USING (doc_id)")
# two-decimal rounding of the exact binary value: the product's error settles near-halves
_ROUNDED_CTE = (
    "SELECT doc_id, n_words, n_sentences, CASE WHEN r > 0.5 OR (r = 0.5 AND (e > 0 OR (e = 0 AND f % 2 = 1))) THEN (f + 1) / 100 "
    "ELSE f / 100 END AS grade FROM (SELECT *, floor(p) AS f, p - floor(p) AS r, (h * 100::DOUBLE - p) + (raw_grade - h) * 100::DOUBLE AS e "
    "FROM (SELECT *, raw_grade * 100::DOUBLE AS p, raw_grade * 134217729::DOUBLE - (raw_grade * 134217729::DOUBLE - raw_grade) AS h FROM gr))")
_GRADES = {"words": _WORDS_CTE, "s": _SENTENCES_CTE.replace("{src}", "documents"), "y": _SYLLABLE_SQL, "gr": _GRADE_CTE,
           "g": _ROUNDED_CTE}


@query("f25_grade_level", with_ctes("SELECT doc_id, grade FROM g", **_GRADES))
def f25(t: Tables):
    return documents(t).select("doc_id", B.text_grade(F.col("text")).alias("grade"))


@query("f21_surface_features", with_ctes(
    "SELECT doc_id, n_words::INTEGER AS word_count, n_words / greatest(n_sentences, 1) AS avg_sentence_len, "
    f"len(regexp_extract_all(text, {_MONEY_SQL}))::INTEGER AS count_money, "
    f"len(regexp_extract_all(text, {_PERIOD_SQL}))::INTEGER AS count_date FROM g JOIN documents USING (doc_id)", **_GRADES))
def f21(t: Tables):
    from pactlens.ml.features import surface_features
    return documents(t).select(
        "doc_id", *[c.alias(n) for n, c in surface_features(F.col("text")).items()])


@query("a5_readability_summary", with_ctes(
    "SELECT lang, sample_size, avg_grade, median_grade, share AS share_at_or_below_target, avg_grade <= 12 AS meets_target FROM ("
    "SELECT lang, count(grade) AS sample_size, round(avg(grade), 2) AS avg_grade, round(median(grade), 2) AS median_grade, "
    "round(avg(CASE WHEN grade <= 12 THEN 1.0 WHEN grade > 12 THEN 0.0 END), 3) AS share FROM g JOIN documents USING (doc_id) "
    "GROUP BY 1)", **_GRADES))
def a5(t: Tables):
    grades = documents(t, "lang").select("lang", B.text_grade(F.col("text")).alias("grade"))
    return E.readability_summary(grades, "lang")


# ---- hashes, demo scorer, previews ----------------------------------------------------------------

FINGERPRINT = S.pipeline_fingerprint("fake/demo", "spark", "4", "opt:none")


@query("f26_content_hash", with_ctes(
    f"SELECT doc_id, clause_index, sha256(raw_text || {quoted('|' + FINGERPRINT)}) AS content_hash FROM doc_clauses",
    "doc_clauses"))
def f26(t: Tables):
    return t.doc_clauses().select(
        "doc_id", "clause_index", S.content_hash(F.col("raw_text"), FINGERPRINT).alias("content_hash"))


@query("f27_program_tag", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'opt:none' ELSE 'opt:' || "
       "substr(sha256(text), 1, 16) END AS tag FROM documents")
def f27(t: Tables):
    stored = F.when(F.col("doc_id") % 5 != 0, F.col("text")).cast("binary")
    return documents(t).select("doc_id", S.program_tag(stored).alias("tag"))


DEMO_SCORE_SQL = (
    "round(greatest(0.02::DOUBLE, least(0.98::DOUBLE, "
    + sql_case("clause_type", D.DEMO_BASE_RISK, "0.30") + "::DOUBLE + (('0x' || substr(sha256(raw_text), 1, 2))::INTEGER / 255.0::DOUBLE "
    "- 0.5::DOUBLE) * 0.30::DOUBLE)), 2)")
DEMO_SUMMARY_SQL = (
    f"{quoted(D.DEMO_SUMMARY_OPEN)} || replace(clause_type, '_', ' ') || {quoted(D.DEMO_SUMMARY_SPAN)} || "
    f"length(raw_text) || {quoted(D.DEMO_SUMMARY_CLOSE)}")


@query("f28_demo_scorer", with_ctes(
    f"SELECT doc_id, clause_index, {DEMO_SCORE_SQL} AS score, {DEMO_SUMMARY_SQL} AS summary, "
    + sql_case("clause_type", {k: quoted(", ".join(v) or "None") for k, v in D.DEMO_FACTORS.items()}, "'None'")
    + " AS factors_raw FROM typed", "doc_clauses", typed=CTE_TYPED))
def f28(t: Tables):
    answer = S.demo_answer(F.col("raw_text"), F.col("clause_type"))
    return typed_clauses(t).withColumn("a", answer).select(
        "doc_id", "clause_index", F.col("a.score_raw").cast("double").alias("score"), "a.summary", "a.factors_raw")


@query("f33_word_shingles", f"""SELECT doc_id, len(s)::INTEGER AS n, md5(array_to_string(list_sort(s), '|')) AS shingles_md5
    FROM (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM (SELECT doc_id, string_split(lower({_NORM.format('text')}), ' ') AS w
    FROM documents))""")
def f33(t: Tables):
    return documents(t).select("doc_id", T.word_shingles(F.col("text")).alias("s")).select(
        "doc_id", F.size("s").alias("n"), F.md5(F.array_join(F.sort_array("s"), "|")).alias("shingles_md5"))


@query("f34_preview", f"SELECT page_id, substr({_NORM.format('html')}, 1, 200) AS preview FROM pages")
def f34(t: Tables):
    return t.pages.select("page_id", T.preview(F.col("html")).alias("preview"))


@query("f35_run_metadata", """SELECT event_id, '{"analyzed":"' || (event_id % 9) || '","cached":"' || (user_id % 7) ||
    CASE WHEN event_id % 4 = 0 THEN '","k":"0"}' ELSE '","k":"' || json_extract_string(props, '$.k') || '"}' END AS metadata
    FROM events""")
def f35(t: Tables):
    patch = F.create_map(
        F.lit("cached"), (F.col("user_id") % 7).cast("string"),
        F.lit("analyzed"), (F.col("event_id") % 9).cast("string"))
    override = F.map_concat(patch, F.create_map(F.lit("k"), F.lit("0")))
    chosen = F.when(F.col("event_id") % 4 == 0, override).otherwise(patch)
    return t.events.select("event_id", S.merge_metadata(F.col("props"), chosen).alias("metadata"))
