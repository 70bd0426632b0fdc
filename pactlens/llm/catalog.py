"""Registered queries of the operators in this package, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pactlens.llm import (filter_audit, fill_in_middle, fingerprints, language_id, line_spread, mixing, near_duplicates, packing, personal_data,
                          quality, secrets, substring_dedup, vector_search)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, build: Callable[..., DataFrame], *tables: str, sql: str | None = None) -> None:
    """Register an operator over whole tables, ``documents`` where none is named."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(*[spark.read.parquet(f"{folder}/{t}.parquet") for t in tables or ("documents",)])

    run.__doc__ = build.__doc__
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


TOP_SQL = """WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND NOT list_contains(
      list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)),
  s AS (
    SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(
      CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 20 = 0),
  r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

LINES_SQL = """WITH l AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
  b AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
  c AS (
    SELECT bare, min(doc_id) AS keeper FROM b WHERE bare <> '' GROUP BY bare
    HAVING count(DISTINCT coalesce(source, '')) >= 4),
  m AS (SELECT b.*, coalesce(b.doc_id <> c.keeper, false) AS gone FROM b LEFT JOIN c USING (bare)),
  d AS (
    SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
      string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS cleaned FROM m GROUP BY doc_id)
  SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(cleaned, '')) AS cleaned_sha256 FROM documents LEFT JOIN d USING (doc_id)"""

MIDDLE_SQL = r"""WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  u AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
      CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
      CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
  c AS (
    SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
  p AS (
    SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS pre, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS mid,
      coalesce(array_to_string(u[hi + 1:], ''), '') AS suf FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

AUDIT_SQL = r"""WITH RECURSIVE o(ord) AS (
    SELECT '' UNION ALL SELECT ord || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(f) WHERE NOT contains(ord, f)),
  k AS (SELECT ord AS filter_order, CAST(step AS INTEGER) AS step, substr(ord, CAST(step AS INTEGER), 1) AS f, substr(ord, 1, CAST(step AS INTEGER) - 1) AS earlier
    FROM o, range(1, 6) r(step) WHERE length(ord) = 5),
  d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  b AS (
    SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
      CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END ||
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
      CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS mask FROM d),
  l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1),
  m AS (
    SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
  s AS (
    SELECT part, filter_order, step, f, earlier, n, good, toxic, mask, contains(mask, f) AS fails,
      earlier <> '' AND regexp_matches(mask, '[' || CASE earlier WHEN '' THEN '-' ELSE earlier END || ']') AS gone FROM m, k),
  g AS (
    SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
  SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""

query("op1_language_id", language_id.op1_language_id)
query("op2_fingerprints", fingerprints.op2_fingerprints)
query("op3_near_duplicates", near_duplicates.op3_near_duplicates)
query("op4_mix_sources", mixing.op4_mix_sources)
query("op5_quality", quality.op5_quality, "documents", "labels")
query("op6_personal_data", personal_data.op6_personal_data)
query("op7_vector_search", vector_search.op7_vector_search, "embeddings", sql=TOP_SQL)
query("op8_secrets", secrets.op8_secrets)
query("op9_packing", packing.op9_packing)
query("op10_line_spread", line_spread.op10_line_spread, sql=LINES_SQL)
query("op11_substring_dedup", substring_dedup.op11_substring_dedup)
query("op12_fill_in_middle", fill_in_middle.op12_fill_in_middle, sql=MIDDLE_SQL)
query("op13_filter_audit", filter_audit.op13_filter_audit, "documents", "labels", sql=AUDIT_SQL)
