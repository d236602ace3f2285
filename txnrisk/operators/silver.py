"""Merchant risk and the fully featured transaction."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk import schemas as S
from txnrisk.functions import scalars as X
from txnrisk.operators.history import customer_history


def merchant_risk_scores(bronze: DataFrame, prior_weight: int = S.RISK_PRIOR_WEIGHT) -> DataFrame:
    """Fraud rate per merchant, pulled toward the overall rate by ``prior_weight`` pseudo-rows.

    The overall rate is a scalar subquery over one column, so nothing returns to the driver.
    No rows: a rate of 0.
    """
    fraud = X.labelled(F.col("is_fraud"))
    totals = bronze.groupBy("merchant_id").agg(
        F.count("*").alias("merchant_txn_count"),
        X.tally(fraud).alias("merchant_fraud_count"),
        X.mean_money(F.col("amount")).alias("merchant_avg_amount"),
    )
    overall = bronze.agg(F.coalesce(X.ratio(X.tally(fraud), F.count("*")), F.lit(0.0))).scalar()
    score = (F.col("merchant_fraud_count") + overall * prior_weight) / (
        F.col("merchant_txn_count") + prior_weight
    )
    return totals.withColumn("merchant_risk_score", X.rounded(score, 6)).withColumn(
        "merchant_risk_tier", X.risk_tier(F.col("merchant_risk_score"))
    )


def with_merchant_risk(transactions: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds the risk columns of the merchant dimension; rows of unlisted merchants get the tier ``unknown``.

    Unhinted on purpose: Spark broadcasts the dimension when its measured size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, splitting hot merchants.
    """
    return transactions.join(dim, "merchant_id", "left").withColumns(
        {
            "merchant_risk_score": F.coalesce("merchant_risk_score", F.lit(S.UNKNOWN_MERCHANT_RISK)),
            "merchant_risk_tier": F.coalesce("merchant_risk_tier", F.lit("unknown")),
        }
    )


def with_signals(featured: DataFrame) -> DataFrame:
    """Three threshold flags and the 0-4 count that also includes the device change."""
    return featured.withColumns(
        {
            "is_high_velocity": X.burst(F.col("txn_count_1h"), F.col("txn_count_24h")),
            "is_amount_outlier": X.outlier(F.col("amount_zscore_30d")),
            "is_impossible_travel": X.too_fast(F.col("implied_speed_kmh")),
        }
    ).withColumn(
        "fraud_signal_count",
        X.signal_count(
            F.col("is_high_velocity"),
            F.col("is_amount_outlier"),
            F.col("is_impossible_travel"),
            F.col("device_change_flag"),
        ),
    )


def silver(
    bronze: DataFrame, merchant_dim: DataFrame | None = None, processed_at: datetime | None = None
) -> DataFrame:
    """bronze -> silver. Without a dimension one is derived from ``bronze``. The processing
    stamp is added only when given."""
    dim = merchant_dim if merchant_dim is not None else merchant_risk_scores(bronze)
    known = S.conform(dim, S.MERCHANT_DIM)
    out = S.conform(with_signals(with_merchant_risk(customer_history(bronze), known)), S.SILVER)
    if processed_at is None:
        return out
    return out.withColumn("silver_processed_at", F.lit(processed_at).cast("timestamp"))
