from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.rows import bronze, by_id
from txnrisk import schemas as S
from txnrisk.functions import scalars as X
from txnrisk.operators import feedback as FB
from txnrisk.operators import gold as G
from txnrisk.operators import monitor as M
from txnrisk.operators import silver as V
from txnrisk.operators import value as VL


def test_smoothing_pulls_small_merchants_to_the_overall_rate(spark):
    rows = [{"merchant_id": "ONE", "is_fraud": "true"}] + [{"merchant_id": "MANY", "minutes": i} for i in range(58)]
    dim = {r["merchant_id"]: r for r in V.merchant_risk_scores(bronze(spark, *rows)).collect()}
    assert dim["ONE"]["merchant_risk_score"] == pytest.approx((1 + 20 / 59) / 21, abs=1e-6)
    assert dim["MANY"]["merchant_risk_score"] < 0.02
    assert (dim["ONE"]["merchant_risk_tier"], dim["MANY"]["merchant_risk_tier"]) == ("high", "low")


def test_missing_labels_are_not_fraud(spark):
    dim = V.merchant_risk_scores(bronze(spark, {"is_fraud": None}, {"is_fraud": None})).first()
    assert (dim["merchant_fraud_count"], dim["merchant_risk_score"]) == (0, 0.0)


def test_no_rows_no_error(spark):
    empty = spark.createDataFrame([], S.BRONZE)
    assert V.merchant_risk_scores(empty).count() == 0 and V.silver(empty).count() == 0


def test_unknown_merchant_is_not_safe(spark):
    rows = bronze(spark, {"merchant_id": "NEW"})
    dim = V.merchant_risk_scores(bronze(spark, {"merchant_id": "OLD"}))
    row = V.silver(rows, dim).first()
    assert (row["merchant_risk_score"], row["merchant_risk_tier"]) == (0.02, "unknown")


def test_silver_layout_signals_and_tiers(spark):
    rows = bronze(spark, *[{"minutes": i, "device_id": f"D{i}"} for i in range(6)])
    silver = V.silver(rows)
    assert silver.schema.simpleString() == S.SILVER.simpleString()
    out = by_id(silver, "is_high_velocity", "device_change_flag", "fraud_signal_count")
    assert out["T0001"] == (False, False, 0) and out["T0005"] == (True, True, 2)
    tiers = [X.risk_tier(F.lit(v)) for v in (0.05, 0.0499, 0.02, 0.0199)]
    assert list(spark.range(1).select(*tiers).first()) == ["high", "medium", "medium", "low"]


def test_daily_metrics_by_hand(spark):
    amounts = [(100, "false", "00"), (100, "false", "00"), (100, "false", "05"), (200, "true", "51")]
    rows = [{"minutes": 400 * i, "amount": a, "is_fraud": f, "auth_response_code": c} for i, (a, f, c) in enumerate(amounts)]
    silver = V.silver(bronze(spark, *rows)).withColumn("dt", F.lit(date(2026, 3, 1)))
    day = G.fraud_metrics_daily(silver).first()
    assert (day["transaction_count"], day["fraud_transaction_count"], day["fraud_rate_pct"]) == (4, 1, 25.0)
    assert (day["total_amount_usd"], day["fraud_loss_amount_usd"], day["fraud_loss_rate_pct"]) == (500.0, 200.0, 40.0)
    assert (day["approved_transaction_count"], day["approval_rate_pct"]) == (2, 50.0)
    merchant = G.merchant_risk(silver).first()
    assert (merchant["distinct_customer_count"], merchant["first_seen_date"]) == (1, date(2026, 3, 1))
    assert tuple(G.gold_summary(G.fraud_metrics_daily(silver)).first()) == (4, 1, 200.0, 25.0)


def test_recall_and_health(spark):
    silver = spark.createDataFrame(
        [(True, 1, True, False, False, False), (True, 0, False, False, False, False), (False, 2, True, True, False, False)],
        "is_fraud boolean, fraud_signal_count int, is_high_velocity boolean, is_amount_outlier boolean, is_impossible_travel boolean, device_change_flag boolean",
    )
    assert tuple(M.signal_recall(silver).first()) == (2, 1, 50.0)
    assert M.feature_health(silver).first()["high_velocity_rate"] == pytest.approx(2 / 3)
    assert M.signal_recall(silver.where("NOT is_fraud")).first()["signal_recall_pct"] == 0.0


VERDICTS = "transaction_id string, dt date, amount double, predicted_is_fraud boolean, actual_is_fraud boolean"


def ledger(spark, rows):
    day = date(2026, 3, 1)
    df = spark.createDataFrame([(f"T{i}", day, float(a), p, t) for i, (a, p, t) in enumerate(rows)], VERDICTS)
    silver = df.select("transaction_id", "dt", F.col("amount").cast("decimal(12,2)").alias("amount"))
    return VL.fraud_value_daily(silver, df.select("transaction_id", "predicted_is_fraud", "actual_is_fraud")).first()


def test_ledger_by_hand(spark):
    row = ledger(spark, [(1000, True, True), (100, True, True), (200, False, True), (50, True, False), (10, False, False)])
    assert (row["actual_fraud_count"], row["actual_fraud_amount_usd"]) == (3, 1300.0)
    assert (row["caught_fraud_count"], row["caught_fraud_amount_usd"]) == (2, 1100.0)
    assert (row["missed_fraud_count"], row["missed_fraud_amount_usd"]) == (1, 200.0)
    assert (row["false_alarm_count"], row["false_alarm_amount_usd"]) == (1, 50.0)
    assert (row["capture_rate_pct"], row["dollar_capture_rate_pct"], row["flag_precision_pct"]) == (66.67, 84.62, 66.67)


def test_ledger_without_fraud_has_no_rates(spark):
    row = ledger(spark, [(10, False, False), (20, False, False)])
    assert (row["capture_rate_pct"], row["dollar_capture_rate_pct"], row["flag_precision_pct"]) == (None, None, None)
    assert row["caught_fraud_amount_usd"] == 0.0


def test_feedback(spark):
    silver = spark.createDataFrame([("A", False, 1), ("B", True, 2), ("C", False, 3)], "transaction_id string, is_fraud boolean, amount int")
    fb = spark.createDataFrame(
        [("A", True, "2026-01-01"), ("A", False, "2026-01-02"), ("B", False, "2026-01-01"), ("Z", True, "2026-01-01"), (None, True, "x"), ("C", None, "x")],
        S.FEEDBACK,
    )
    assert by_id(FB.apply_feedback(silver, fb), "is_fraud") == {"A": False, "B": False, "C": False}
    assert tuple(FB.feedback_stats(silver, fb).first()) == (3, 2, 1)
    assert FB.apply_feedback(silver, None) is silver
    assert FB.apply_feedback(silver, fb).columns == silver.columns
