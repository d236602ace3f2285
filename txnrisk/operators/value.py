"""The confusion matrix of each day in money."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk import schemas as S
from txnrisk.functions import scalars as X


def priced_days(verdicts: DataFrame) -> DataFrame:
    """Per ``dt`` from rows of (dt, amount, predicted_is_fraud, actual_is_fraud)."""
    predicted = X.labelled(F.col("predicted_is_fraud"))
    actual = X.labelled(F.col("actual_is_fraud"))
    cells = {
        "actual_fraud": actual,
        "caught_fraud": predicted & actual,
        "missed_fraud": actual & ~predicted,
        "false_alarm": predicted & ~actual,
    }
    measures = [
        F.count("*").alias("transaction_count"),
        X.money(F.col("amount")).alias("total_amount_usd"),
        X.tally(predicted).alias("flagged_count"),
    ]
    for name, member in cells.items():
        measures.append(X.tally(member).alias(f"{name}_count"))
        measures.append(X.money(F.when(member, F.col("amount"))).alias(f"{name}_amount_usd"))
    caught = F.col("caught_fraud_count")
    priced = verdicts.groupBy("dt").agg(*measures).withColumns(
        {
            "capture_rate_pct": X.percent(caught, F.col("actual_fraud_count"), 2),
            "dollar_capture_rate_pct": X.percent(
                F.col("caught_fraud_amount_usd"), F.col("actual_fraud_amount_usd"), 2
            ),
            "flag_precision_pct": X.percent(caught, F.col("flagged_count"), 2),
        }
    )
    return S.conform(priced, S.VALUE)


def fraud_value_daily(silver: DataFrame, scores: DataFrame) -> DataFrame:
    """Amounts from silver, verdicts from scores, matched on ``transaction_id``."""
    amounts = silver.select("transaction_id", "dt", "amount")
    verdicts = scores.select("transaction_id", "predicted_is_fraud", "actual_is_fraud")
    return priced_days(amounts.join(verdicts, "transaction_id"))
