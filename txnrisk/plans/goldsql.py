"""Analyst SQL over the gold tables, and what each persona sees of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
GOLD_TABLES = (
    "fraud_metrics_daily",
    "merchant_risk",
    "transaction_risk_scores",
    "model_metrics",
    "fraud_value_daily",
)
ROW_CAP = 1000
AGENT_ROW_CAP = 200
HIDDEN = {
    "analyst": {
        "fraud_metrics_daily": ("distinct_customer_count", "total_fraud_signals"),
        "merchant_risk": ("distinct_customer_count", "merchant_risk_score"),
    },
    "risk_analyst": {},
}
# ----------------------------------------------------------------------------------------


def persona_view(table: str, df: DataFrame, persona: str) -> DataFrame:
    """``df`` without what ``persona`` must not see; also holds for SELECT *."""
    return df.drop(*HIDDEN[persona].get(table, ()))


class GoldDesk:
    """A session that holds the gold views of one persona and nothing else.

    Other sessions' views do not resolve in it and reading files by path is off. Spark's own
    grammar keeps a question to one read-only query, because it is placed in a FROM clause.
    Tables of a shared metastore would resolve, so bronze and silver stay path-based.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, str], persona: str = "risk_analyst", cap: int = ROW_CAP):
        """``tables``: gold table name to the folder it is stored in."""
        unknown = set(tables) - set(GOLD_TABLES)
        if unknown:
            raise ValueError(f"not gold tables: {sorted(unknown)}")
        if persona not in HIDDEN:
            raise ValueError(f"unknown persona {persona!r}")
        self.cap = cap
        self.session = spark.newSession()
        for name, path in tables.items():
            persona_view(name, self.session.read.parquet(path), persona).createOrReplaceTempView(name)
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self.session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
        self.names = sorted(tables)

    def ask(self, query: str) -> DataFrame:
        """The rows of ``query``, at most ``cap`` of them."""
        return self.session.sql(self.wrapped(query))

    def answer(self, query: str) -> DataFrame:
        """The rows of :meth:`ask` with ``answer_row``, their number from 1 in the order of the question,
        and ``truncated``: whether there were more. One row beyond the cap is fetched to know, so the
        windows here hold ``cap`` + 1 rows at most."""
        rows = self.session.sql(self.wrapped(query, 1))
        taken = {"answer_row", "truncated", "_seq", "_held"} & set(rows.columns)
        if taken:
            raise ValueError(f"columns of the answer: {sorted(taken)}")
        # A limit leaves one partition, in which the ids follow the order.
        numbered = rows.withColumn("_seq", F.monotonically_increasing_id())
        whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        counted = numbered.withColumn("answer_row", F.row_number().over(Window.orderBy("_seq"))).withColumn("_held", F.count("*").over(whole))
        kept = counted.where(F.col("answer_row") <= self.cap).withColumn("truncated", F.col("_held") > self.cap)
        return kept.drop("_seq", "_held")

    def wrapped(self, query: str, beyond: int = 0) -> str:
        # The newline ends a trailing line comment, which would otherwise swallow the cap.
        return f"SELECT * FROM (\n{query.strip().rstrip(';')}\n) LIMIT {int(self.cap) + beyond}"

    def listing(self) -> str:
        """Columns and types of every visible table, as DDL."""
        tables = [(name, self.session.table(name).schema) for name in self.names]
        return "\n".join(
            f"{name} (" + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + ")"
            for name, schema in tables
        )


def period_over_period(metrics: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Fraud per category in the last ``days`` and in the ``days`` before, in one pass over
    both periods. Categories without recent rows are left out; no prior rows is NULL."""
    today = F.lit(as_of).cast("date")
    recent = F.col("dt") >= F.date_sub(today, days)
    window = metrics.where(F.col("dt") >= F.date_sub(today, 2 * days))
    fraud = F.col("fraud_transaction_count")
    return (
        window.groupBy("mcc")
        .agg(
            F.sum(F.when(recent, fraud)).alias("fraud_txns"),
            F.sum(F.when(~recent, fraud)).alias("prior_fraud_txns"),
            F.count_if(recent).alias("recent_rows"),
        )
        .where("recent_rows > 0")
        .drop("recent_rows")
    )


def merchants_with_category(metrics: DataFrame, risk: DataFrame) -> DataFrame:
    """Each merchant beside what its category did. The category is summed before the join, so a
    merchant meets one row, not one per day and channel."""
    categories = metrics.groupBy("mcc").agg(
        F.sum("transaction_count").alias("category_transaction_count"),
        F.sum("fraud_transaction_count").alias("category_fraud_count"),
        F.max("dt").alias("category_last_day"),
    )
    merchants = risk.select("mcc", "merchant_id", "transaction_count", "fraud_rate_pct")
    return merchants.join(categories, "mcc")
