"""Roll-ups of silver."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk import schemas as S
from txnrisk.functions import scalars as X


def _volume() -> dict[str, Column]:
    """Measures both roll-ups share."""
    fraud = X.labelled(F.col("is_fraud"))
    return {
        "transaction_count": F.count("*"),
        "fraud_transaction_count": X.tally(fraud),
        "total_amount_usd": X.money(F.col("amount")),
        "fraud_loss_amount_usd": X.money(F.when(fraud, F.col("amount"))),
        "avg_transaction_amount_usd": X.rounded(X.mean_money(F.col("amount")), 2),
        "distinct_customer_count": F.count_distinct("customer_id"),
    }


def _rollup(df: DataFrame, grain: list[str], measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*grain).agg(*[column.alias(name) for name, column in measures.items()])


def stamped(rollup: DataFrame, column: str, moment: datetime) -> DataFrame:
    """``rollup`` with the moment it was computed, as every stored roll-up carries it."""
    return rollup.withColumn(column, F.lit(moment).cast("timestamp"))


def fraud_metrics_daily(silver: DataFrame) -> DataFrame:
    """By day, merchant category and channel."""
    measures = _volume() | {
        "distinct_merchant_count": F.count_distinct("merchant_id"),
        "approved_transaction_count": X.tally(X.approved(F.col("auth_response_code"))),
        "total_fraud_signals": F.sum(F.col("fraud_signal_count").cast("long")),
    }
    sums = _rollup(silver, ["dt", "mcc", "channel"], measures)
    n = F.col("transaction_count")
    rated = sums.withColumns(
        {
            "fraud_rate_pct": X.percent(F.col("fraud_transaction_count"), n, 4),
            "approval_rate_pct": X.percent(F.col("approved_transaction_count"), n, 4),
            "fraud_loss_rate_pct": X.percent(F.col("fraud_loss_amount_usd"), F.col("total_amount_usd"), 4),
        }
    )
    return S.conform(rated, S.DAILY_METRICS)


def merchant_risk(silver: DataFrame) -> DataFrame:
    """By merchant and category, over whatever period ``silver`` holds."""
    score = F.col("merchant_risk_score")
    measures = _volume() | {
        "merchant_risk_score": X.rounded(F.max(score), 6),
        # The tier that goes with the highest score, not the last one in the alphabet.
        "merchant_risk_tier": F.max_by("merchant_risk_tier", F.struct(score, F.col("merchant_risk_tier"))),
        "first_seen_date": F.min("dt"),
        "last_seen_date": F.max("dt"),
    }
    sums = _rollup(silver, ["merchant_id", "mcc"], measures)
    rated = sums.withColumn(
        "fraud_rate_pct", X.percent(F.col("fraud_transaction_count"), F.col("transaction_count"), 4)
    )
    return S.conform(rated, S.MERCHANT_RISK)


def gold_summary(daily: DataFrame) -> DataFrame:
    """One row over the daily metrics: volume, fraud, loss, rate (0 on no volume)."""
    n, fraud = F.sum("transaction_count"), F.sum("fraud_transaction_count")
    return daily.agg(
        F.coalesce(n, F.lit(0)).alias("total_transactions"),
        F.coalesce(fraud, F.lit(0)).alias("total_fraud"),
        X.money(F.col("fraud_loss_amount_usd")).alias("total_loss_usd"),
        F.coalesce(X.percent(fraud, n, 4), F.lit(0.0)).alias("fraud_rate_pct"),
    )
