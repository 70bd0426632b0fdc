"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites of every line hash is merged by aggregation.
Lines whose estimate lies near the threshold get an exact distinct count;
lines on enough sites are boilerplate and stay only where they occur first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 4  # sites from which on a line is boilerplate
RELATIVE_ERROR = 0.1  # standard error of the sketches
SALTS = 8  # parts into which the documents that hold a line are dealt
BAND = 4.0  # an estimate within so many standard errors of the threshold is counted exactly


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """Hash of the line without surrounding blanks; null for blank lines."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(key, keeper): keys of the lines on ``min_sites`` sites at least, and the smallest document that has them.

    ``lines`` has (key, site, doc_id). Sketches and smallest ids combine before
    their shuffle, so a line that every document holds is a row for each task.
    A null site is a site of its own.
    """
    site = F.coalesce("site", F.lit("\0"))
    sketched = lines.groupBy("key").agg(
        F.approx_count_distinct(site, RELATIVE_ERROR).alias("sites"), F.count("*").alias("uses"),
        F.min("doc_id").alias("keeper")).filter(F.col("uses") >= min_sites)
    margin = BAND * RELATIVE_ERROR * min_sites
    near = F.col("sites").between(min_sites - margin - 1, min_sites + margin + 1)
    sure = sketched.filter(~near & (F.col("sites") > min_sites))
    asked = sketched.filter(near)
    # a line is one row for each of its sites here, however many documents hold it
    pairs = lines.groupBy("key", site.alias("site")).agg(F.count("*").alias("n")).join(asked.select("key", "keeper"), "key")
    exact = pairs.groupBy("key", "keeper").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return sure.select("key", "keeper").unionByName(exact.select("key", "keeper"))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                     min_sites: int = MIN_SITES, keep: tuple = ()) -> DataFrame:
    """(doc_id, text, cleaned, n_lines, n_removed), one row for each row of ``docs``; ``keep`` names columns to carry along.

    Boilerplate lines go from every document but the one with the smallest id
    that has them, so no line leaves the corpus. Any line counts that is not
    blank, however short: only its sites decide. Documents are matched by id
    and a hash of the text: repeated rows are cleaned alike. Null ids keep
    their lines, a null text stays null, other columns are left out, and an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"),
                       F.xxhash64(F.col(text_col)).alias("text_key"), F.struct(F.lit(0), *keep).alias("kept"))
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: k.isNotNull()))
    lines = rows.filter("text IS NOT NULL").select("doc_id", "text_key", "site", F.explode(keys).alias("key"))
    common = boilerplate(lines, min_sites)
    # a common line meets its documents in several parts, so that no task gets all of them
    parts = common.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = lines.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
    hits = dealt.join(parts, ["key", "part"]).filter("doc_id <> keeper").groupBy("doc_id", "text_key").agg(
        F.collect_set("key").alias("gone"))
    known = rows.join(hits, ["doc_id", "text_key"], "left")
    return known.select(
        "doc_id", "text", cleaned(F.col("text"), F.col("gone")).alias("cleaned"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_of(F.col("text")))).alias("n_lines"),
        F.coalesce(F.size(F.filter(lines_of(F.col("text")), lambda x: removed(x, F.col("gone")))), F.lit(0)).alias("n_removed"),
        *[F.col("kept")[c].alias(c) for c in keep])


def removed(line: Column, gone: Column) -> Column:
    return F.coalesce(F.array_contains(gone, line_key(line)), F.lit(False))


def cleaned(text: Column, gone: Column) -> Column:
    return F.when(gone.isNull(), text).otherwise(
        F.array_join(F.filter(lines_of(text), lambda x: ~removed(x, gone)), "\n"))


def op10_line_spread(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the cleaned text, one row per document."""
    return drop_boilerplate(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("cleaned_sha256"))
