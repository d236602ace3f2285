"""Counts an operator watches: intake, features, versions, freshness, drift."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from txnrisk.functions import scalars as X

STALE_AFTER_HOURS = 3
DRIFT_AUC = 0.80
QUARANTINE_LIMIT_PCT = 5.0


def rejection_breakdown(flagged: DataFrame) -> DataFrame:
    """Rows per reason, most frequent first. Takes ``rejection_reasons`` (array) or, from the
    stored quarantine, ``rejection_reason`` (comma list)."""
    reasons = (
        F.col("rejection_reasons")
        if "rejection_reasons" in flagged.columns
        else F.split("rejection_reason", ",")
    )
    return (
        flagged.select(F.explode(reasons).alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "reason")
    )


def ingest_metrics(bronze: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row: kept, quarantined, quarantined share in percent (0 on no rows)."""
    kept = bronze.select(F.lit(False).alias("bad"))
    refused = quarantine.select(F.lit(True).alias("bad"))
    return kept.unionByName(refused).agg(*_intake(F.col("bad")))


def _intake(bad: Column) -> list[Column]:
    return [
        F.count_if(~bad).alias("bronze_rows"),
        F.count_if(bad).alias("quarantine_rows"),
        F.coalesce(X.percent(F.count_if(bad), F.count("*"), 4), F.lit(0.0)).alias("quarantine_pct"),
    ]


def intake_metrics(flagged: DataFrame) -> DataFrame:
    """The row of :func:`ingest_metrics` from rows that carry ``rejection_reasons``, in one scan."""
    return flagged.agg(*_intake(F.size("rejection_reasons") > 0))


def watched_intake(flagged: DataFrame) -> tuple[DataFrame, Observation]:
    """``flagged`` unchanged, and the same three numbers, filled in by the first job that reads all of it:
    a job that writes these rows anyway needs no scan for its counts. A job that stops early, or retries
    the whole plan, is not what to read them off."""
    seen = Observation()
    return flagged.observe(seen, *_intake(F.size("rejection_reasons") > 0)), seen


def feature_health(silver: DataFrame) -> DataFrame:
    """Share of rows on which each signal, and fraud, is set."""
    flags = {
        "high_velocity_rate": "is_high_velocity",
        "amount_outlier_rate": "is_amount_outlier",
        "impossible_travel_rate": "is_impossible_travel",
        "device_change_rate": "device_change_flag",
        "fraud_rate": "is_fraud",
    }
    return silver.agg(
        *[X.ratio(F.count_if(flag), F.count(flag)).alias(name) for name, flag in flags.items()]
    )


def signal_recall(silver: DataFrame) -> DataFrame:
    """Percent of fraud rows with at least one signal; 0 when there is no fraud."""
    fraud = X.labelled(F.col("is_fraud"))
    seen = X.tally(fraud & (F.col("fraud_signal_count") > 0))
    return silver.agg(
        X.tally(fraud).alias("fraud_rows"),
        seen.alias("fraud_rows_with_signal"),
        F.coalesce(X.percent(seen, X.tally(fraud), 4), F.lit(0.0)).alias("signal_recall_pct"),
    )


def raw_rows_per_day(raw: DataFrame, day: str = "dt") -> DataFrame:
    return raw.groupBy(day).agg(F.count("*").alias("records")).orderBy(F.desc(day))


def raw_fraud_mix(raw: DataFrame, day: str = "dt") -> DataFrame:
    """Untyped rows: fraud share per day and channel."""
    fraud = F.count_if(F.col("is_fraud") == "true")
    return (
        raw.groupBy(day, "channel")
        .agg(
            F.count("*").alias("transactions"),
            fraud.alias("fraud_transactions"),
            X.percent(fraud, F.count("*"), 3).alias("fraud_pct"),
        )
        .orderBy(F.desc(day), F.desc("transactions"), "channel")
    )


def schema_version_mix(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("schema_version").agg(
        F.count("*").alias("records"), F.count("auth_response_code").alias("with_auth_code")
    )


def replay_proof(bronze: DataFrame) -> DataFrame:
    """Equal numbers show that re-deliveries added nothing."""
    return bronze.agg(
        F.count("*").alias("rows"), F.count_distinct("transaction_id").alias("unique_ids")
    )


def latest_partition(table: DataFrame) -> DataFrame:
    return table.agg(F.max("dt").alias("latest_partition"))


def _verdict(name: str, value: Column, alarm: Column) -> list[Column]:
    return [F.lit(name).alias("check"), value.cast("double").alias("value"), alarm.alias("alarm")]


def freshness(bronze: DataFrame, as_of: datetime, hours: int = STALE_AFTER_HOURS) -> DataFrame:
    """Alarm when no row is newer than ``hours`` before ``as_of``; no rows at all is stale."""
    newest = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    fresh = F.count_if(F.col("transaction_timestamp") > newest)
    return bronze.agg(*_verdict("fresh_rows", fresh, fresh == 0))


def drift(model_metrics: DataFrame, floor: float = DRIFT_AUC) -> DataFrame:
    """Alarm when the ensemble of the newest run falls below ``floor``."""
    auc = F.max_by("holdout_roc_auc", "model_run_id")
    ensemble = model_metrics.where(F.col("model_name") == "ensemble")
    return ensemble.agg(*_verdict("ensemble_auc", auc, F.coalesce(auc < floor, F.lit(False))))


def quarantine_pressure(intake: DataFrame, limit_pct: float = QUARANTINE_LIMIT_PCT) -> DataFrame:
    """Alarm on the row of :func:`ingest_metrics`."""
    share = F.col("quarantine_pct")
    return intake.select(*_verdict("quarantine_pct", share, share > limit_pct))
