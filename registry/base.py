"""Registration, and the relations every query derives from the given tables.

Each relation exists twice: as a DataFrame built with the library and as a SQL
common table expression for the reference engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens import domain as D
from pactlens.functions import text as T
from pactlens.operators import contracts as C
from pactlens.sources import pages as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the given tables and the relations derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def contracts(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("contract_id"), F.col("o_custkey").alias("owner_id"),
            F.col("o_orderdate").alias("created_at"))

    def clauses(self) -> DataFrame:
        items = self.lineitem
        order = Window.partitionBy("l_orderkey").orderBy(
            *[c for c in items.columns if c != "l_orderkey"])
        kinds = F.array(*[F.lit(k) for k in sorted(D.CLAUSE_TYPES)])
        return items.select(
            F.col("l_orderkey").alias("contract_id"),
            F.row_number().over(order).alias("clause_index"),
            F.element_at(kinds, (F.col("l_partkey") % 8 + 1).cast("int")).alias("clause_type"),
            F.round(F.lit(1) - F.col("l_discount") * 8, 4).alias("conf"),
            F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("l_tax") * 12)), 4)
            .alias("model_score"),
            (F.col("l_suppkey") % 6).alias("n_factors"),
            (F.col("l_linestatus") == "F").alias("analyzed"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_partkey").alias("part"))

    def scored(self) -> DataFrame:
        """All clauses with hybrid score and level; unanalyzed ones keep NULL levels."""
        full = C.with_hybrid(self.clauses())
        return full.withColumn("risk_level", F.when(F.col("analyzed"), F.col("risk_level")))

    def scores(self) -> DataFrame:
        return self.scored().filter("analyzed").select(
            "contract_id", "clause_index", "model_score", "n_factors", "risk_level", "created_at",
            summary_of().alias("summary"))

    def runs(self) -> DataFrame:
        kind = F.col("event_type")
        status = (
            F.when(kind.isin("purchase", "view"), "completed").when(kind == "error", "failed")
            .when(kind == "signup", "pending").otherwise("running"))
        took = F.floor(F.col("value") * 100).cast("int")
        return self.events.select(
            F.col("event_id").alias("run_id"), F.col("user_id").alias("contract_id"),
            status.alias("status"), F.col("ts").alias("started_at"), "props",
            F.when(status.isin("completed", "failed"), took).alias("processing_time_ms"))

    def contract_texts(self) -> DataFrame:
        """Documents as contracts: every line is a paragraph that ends in a clause phrase."""
        lines = F.transform(
            F.split("text", "\n"),
            lambda line, i: F.concat(line, F.lit(" "), phrase(F.col("doc_id"), i)))
        return spread(self.documents.select("doc_id", "text")).select(
            "doc_id", F.array_join(lines, "\n\n").alias("text"))

    def doc_clauses(self) -> DataFrame:
        return P.clauses_of(self.contract_texts())


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a given table that came as one file with a single row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def phrase(doc, i):
    choice = F.array(*[F.lit(p) for p in PHRASES])
    return F.element_at(choice, ((doc * 7 + i * 5) % len(PHRASES) + 1).cast("int"))


def summary_of():
    choice = F.array(*[F.lit(p) for p in PHRASES])
    return F.concat(
        F.when(F.col("part") % 5 == 0, F.lit("[Demo analysis] ")).otherwise(F.lit("")),
        F.element_at(choice, (F.col("part") % len(PHRASES) + 1).cast("int")))


# sentences that make clauses of prose
PHRASES = (
    "The Client shall pay each invoice within 30 days of receipt.",
    "Either party may terminate this agreement with 14 days notice, e.g. by email.",
    "All intellectual property created hereunder is assigned to the Client.",
    "The Contractor shall not be liable for indirect damages above USD 5,000.",
    "Each party must keep confidential information secret for 2 years.",
    "The deliverables are listed in the statement of work, see Sec. 4.",
    "This agreement is subject to the governing law of the State.",
    "You should consider a late fee of 1.5 percent per month.",
    "We strongly recommend that you review the exclusivity clause.",
    "Make sure you keep a copy; our advice is to wait.",
    "You must sign before 12 months have passed.",
    "Nothing in this paragraph limits the rights of the parties.",
    "The parties agree to meet in good faith!",
    "Does the notice period apply? It shall apply without exception.",
    "You should not accept a cap of 250 euros, and you should ask for more.",
    "Such obligations survive and shall not expire.",
)


# fixed values: the English stop words of Spark's StopWordsRemover, for SQL that is made before any session
ENGLISH_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is
    are was were be been being have has had having do does did doing a an the and but if or because as until
    while of at by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each few more
    most other some such no nor not only own same so than too very s t can will just don should now i'll
    you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
    won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
    there's what's when's where's who's why's would
""".split()


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sql_case(column: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in mapping.items())
    return f"(CASE {column} {whens} ELSE {default} END)"


PRIOR_SQL = sql_case("clause_type", D.SEVERITY_PRIOR, "0.30")
HYBRID_SQL = (
    "greatest(0.0, least(1.0, 0.65 * model_score + 0.15 * least(greatest(n_factors, 0) / 4.0, 1.0)"
    " + 0.10 * (1.0 - conf) + 0.10::DOUBLE * " + PRIOR_SQL + "::DOUBLE))")
LEVEL_SQL = (
    "(CASE WHEN hybrid_score >= 0.65 THEN 'high' WHEN hybrid_score >= 0.35 THEN 'medium'"
    " ELSE 'low' END)")

CTES = {
    "contracts": "SELECT o_orderkey AS contract_id, o_custkey AS owner_id, "
                 "o_orderdate AS created_at FROM orders",
    "clauses": f"""SELECT l_orderkey AS contract_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey,
          l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
          l_linestatus, l_shipdate) AS INTEGER) AS clause_index,
        {sql_list(sorted(D.CLAUSE_TYPES))}[l_partkey % 8 + 1] AS clause_type,
        round(1 - l_discount * 8, 4) AS conf,
        round(least(1.0, greatest(0.0, l_tax * 12)), 4) AS model_score,
        l_suppkey % 6 AS n_factors, l_linestatus = 'F' AS analyzed,
        l_shipdate AS created_at, l_partkey AS part FROM lineitem""",
    "hybrid": f"SELECT *, {HYBRID_SQL} AS hybrid_score FROM clauses",
    "scored": f"SELECT *, CASE WHEN analyzed THEN {LEVEL_SQL} END AS risk_level FROM hybrid",
    "scores": f"""SELECT contract_id, clause_index, model_score, n_factors, risk_level, created_at,
        CASE WHEN part % 5 = 0 THEN '[Demo analysis] ' ELSE '' END
        || {sql_list(PHRASES)}[part % {len(PHRASES)} + 1] AS summary
        FROM scored WHERE analyzed""",
    "runs": """SELECT event_id AS run_id, user_id AS contract_id, status, ts AS started_at, props,
        CASE WHEN status IN ('completed','failed') THEN CAST(floor(value * 100) AS INTEGER) END
          AS processing_time_ms
        FROM (SELECT *, CASE WHEN event_type IN ('purchase','view') THEN 'completed'
          WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'pending'
          ELSE 'running' END AS status FROM events)""",
    "doc_lines": """SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents""",
    "doc_clauses": f"""SELECT doc_id, CAST(line_no + 1 AS INTEGER) AS clause_index,
        trim(line || ' ' || {sql_list(PHRASES)}[(doc_id * 7 + line_no * 5) % {len(PHRASES)} + 1])
          AS raw_text FROM doc_lines""",
}
NEEDS = {"hybrid": ["clauses"], "scored": ["hybrid"], "scores": ["scored"],
         "doc_clauses": ["doc_lines"]}


def with_ctes(body: str, /, *names: str, **extra: str) -> str:
    """``body`` preceded by the named relations and whatever they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({CTES[name]})" for name in ordered]
    parts += [f"{name} AS ({sql})" for name, sql in extra.items()]
    head = ("WITH " + ",\n".join(parts) + "\n") if parts else ""
    return head + body


def query(name: str, sql: str | None = None):
    """Register a query function of ``Tables`` with its reference SQL."""
    def wrap(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(Tables(spark, folder))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


__all__ = ["C", "CTES", "D", "F", "ORACLES", "P", "PHRASES", "QUERIES", "T", "Tables", "Window",
           "query", "quoted", "sql_case", "sql_list", "with_ctes", "LEVEL_SQL", "HYBRID_SQL",
           "spread", "phrase"]
