"""Late labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_confirmation(feedback: DataFrame) -> DataFrame:
    """The last verdict per transaction. Rows without id or verdict say nothing; verdicts of
    the same moment are settled toward fraud."""
    usable = feedback.dropna(subset=["transaction_id", "confirmed_is_fraud"])
    return usable.groupBy("transaction_id").agg(
        F.max_by("confirmed_is_fraud", F.struct("confirmed_at", "confirmed_is_fraud")).alias(
            "confirmed_is_fraud"
        )
    )


def apply_feedback(silver: DataFrame, feedback: DataFrame | None) -> DataFrame:
    """``silver`` with confirmed labels in ``is_fraud``; ids it does not hold are ignored."""
    if feedback is None:
        return silver
    confirmed = latest_confirmation(feedback)
    joined = silver.join(confirmed, "transaction_id", "left")
    label = F.coalesce("confirmed_is_fraud", "is_fraud")
    return joined.withColumn("is_fraud", label).select(*silver.columns)


def feedback_stats(silver: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: distinct confirmations, how many met a transaction, how many changed it.
    A confirmation of a NULL label is a change."""
    confirmed = latest_confirmation(feedback)
    labels = silver.select("transaction_id", "is_fraud", F.lit(True).alias("known"))
    met = confirmed.join(labels, "transaction_id", "left")
    differs = F.col("known") & ~F.col("confirmed_is_fraud").eqNullSafe(F.col("is_fraud"))
    return met.agg(
        F.count("*").alias("feedback_rows"),
        F.count("known").alias("labels_confirmed"),
        F.count_if(differs).alias("labels_changed"),
    )
