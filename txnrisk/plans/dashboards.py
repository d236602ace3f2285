"""What the dashboards show, as DataFrames over gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import scalars as X

CATEGORIES_SHOWN = 8


def _volume_and_fraud():
    n, fraud = F.sum("transaction_count"), F.sum("fraud_transaction_count")
    return [n.alias("transaction_count"), fraud.alias("fraud_transaction_count")]


def _rate(digits: int):
    return X.percent(F.sum("fraud_transaction_count"), F.sum("transaction_count"), digits)


def daily(metrics: DataFrame) -> DataFrame:
    return (
        metrics.groupBy("dt")
        .agg(
            *_volume_and_fraud(),
            X.money(F.col("total_amount_usd")).alias("total_amount_usd"),
            X.money(F.col("fraud_loss_amount_usd")).alias("fraud_loss_amount_usd"),
            _rate(3).alias("fraud_rate_pct"),
        )
        .orderBy("dt")
    )


def by_channel(metrics: DataFrame) -> DataFrame:
    rows = metrics.groupBy("channel").agg(*_volume_and_fraud(), _rate(3).alias("fraud_rate_pct"))
    return rows.orderBy(F.desc("fraud_rate_pct"), "channel")


def costliest_categories(metrics: DataFrame, shown: int = CATEGORIES_SHOWN) -> DataFrame:
    rows = metrics.groupBy("mcc").agg(
        F.sum("fraud_transaction_count").alias("fraud_transaction_count"),
        X.money(F.col("fraud_loss_amount_usd")).alias("fraud_loss_amount_usd"),
    )
    return rows.orderBy(F.desc("fraud_loss_amount_usd"), "mcc").limit(shown)


def ops_tiles(metrics: DataFrame) -> DataFrame:
    """One row over :func:`daily`; the rate is NULL without volume."""
    days = daily(metrics)
    n = F.coalesce(F.sum("transaction_count"), F.lit(0))
    return days.agg(
        n.alias("transactions"),
        F.coalesce(F.sum("fraud_transaction_count"), F.lit(0)).alias("fraud_transactions"),
        _rate(2).alias("fraud_rate_pct"),
        X.money(F.col("fraud_loss_amount_usd")).alias("fraud_loss_usd"),
        F.count("*").alias("days"),
    )


def model_listing(model_metrics: DataFrame) -> DataFrame:
    columns = [
        "model_name", "model_run_id", "trained_at", "training_rows", "holdout_roc_auc",
        "holdout_precision", "holdout_recall", "holdout_f1", "feedback_labels_confirmed",
        "feedback_labels_changed",
    ]
    return model_metrics.select(*columns).orderBy("trained_at", "model_name")


def leaderboard(model_metrics: DataFrame) -> DataFrame:
    """Models of the newest run, best first."""
    newest = model_metrics.agg(F.max("model_run_id")).scalar()
    rows = model_metrics.where(F.col("model_run_id") == newest)
    return rows.select(
        F.col("model_name").alias("model"),
        F.col("holdout_roc_auc").alias("roc_auc"),
        F.col("holdout_precision").alias("precision"),
        F.col("holdout_recall").alias("recall"),
        F.col("holdout_f1").alias("f1"),
    ).orderBy(F.desc("roc_auc"), "model")


def auc_trend(model_metrics: DataFrame) -> DataFrame:
    """Per model its (run, AUC) pairs in run order: one entry per training run."""
    point = F.struct(F.col("model_run_id").alias("run"), F.col("holdout_roc_auc").alias("roc_auc"))
    return model_metrics.groupBy(F.col("model_name").alias("model")).agg(
        F.array_sort(F.collect_list(point)).alias("trend")
    )


def feedback_per_run(model_metrics: DataFrame) -> DataFrame:
    """Run-level columns, which every model row of the run repeats."""
    one = {
        "training_rows": "training_rows",
        "labels_confirmed": "feedback_labels_confirmed",
        "labels_changed": "feedback_labels_changed",
    }
    rows = model_metrics.groupBy(F.col("model_run_id").alias("run")).agg(
        *[F.coalesce(F.min_by(source, "model_name"), F.lit(0)).alias(name) for name, source in one.items()]
    )
    return rows.orderBy("run")


def value_listing(value: DataFrame) -> DataFrame:
    return value.drop("total_amount_usd", "model_run_id", "computed_at").orderBy("dt")


def business_tiles(value: DataFrame) -> DataFrame:
    """One row over the value ledger."""
    caught, missed, actual = (
        X.money(F.col(f"{what}_fraud_amount_usd")) for what in ("caught", "missed", "actual")
    )
    n_caught, n_actual = F.sum("caught_fraud_count"), F.sum("actual_fraud_count")
    return value.agg(
        caught.alias("intercepted_usd"),
        missed.alias("missed_usd"),
        X.percent(caught, actual, 2).alias("dollar_capture_rate_pct"),
        X.percent(n_caught, n_actual, 2).alias("capture_rate_pct"),
        X.percent(n_caught, F.sum("flagged_count"), 2).alias("flag_precision_pct"),
        F.coalesce(F.sum("false_alarm_count"), F.lit(0)).alias("review_queue"),
    )


def business_daily(value: DataFrame) -> DataFrame:
    return value.select(
        "dt",
        F.col("caught_fraud_amount_usd").alias("caught_usd"),
        F.col("missed_fraud_amount_usd").alias("missed_usd"),
        F.col("false_alarm_count").alias("false_alarms"),
        "capture_rate_pct",
    ).orderBy("dt")
