from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.rows import CLEAN, START, by_id, raw
from txnrisk import schemas as S
from txnrisk.operators import bronze as B
from txnrisk.operators import monitor as M

NOW = datetime(2026, 3, 2)


@pytest.mark.parametrize(
    ("change", "reasons"),
    [
        ({}, []),
        ({"transaction_id": None}, ["null_transaction_id"]),
        ({"transaction_id": "   "}, ["null_transaction_id"]),
        ({"customer_id": None}, ["null_customer_id"]),
        ({"merchant_id": None}, ["null_merchant_id"]),
        ({"amount": "N/A"}, ["non_numeric_amount"]),
        ({"amount": None}, ["missing_amount"]),
        ({"amount": "-19.99"}, ["amount_out_of_range"]),
        ({"amount": "999999.00"}, ["amount_out_of_range"]),
        ({"amount": "0.01"}, []),
        ({"amount": "25000.00"}, []),
        ({"amount": "25000.01"}, ["amount_out_of_range"]),
        ({"timestamp": "not-a-timestamp"}, ["unparseable_timestamp"]),
        ({"timestamp": None}, ["unparseable_timestamp"]),
        ({"lat": "181.5"}, ["lat_out_of_range"]),
        ({"lon": "-420.0"}, ["lon_out_of_range"]),
        ({"lat": "90", "lon": "-180"}, []),
        ({"lat": "north"}, []),
        ({"channel": "carrier_pigeon"}, ["unknown_channel"]),
        ({"channel": None}, []),
        ({"customer_id": None, "amount": "-5.00"}, ["null_customer_id", "amount_out_of_range"]),
    ],
)
def test_each_defect_has_its_reason(spark, change, reasons):
    assert B.flag_defects(raw(spark, change)).first()["rejection_reasons"] == reasons
    clean, rejected = B.split(raw(spark, change), NOW)
    assert (clean.count(), rejected.count()) == ((1, 0) if not reasons else (0, 1))


def test_typed_row_and_defaults(spark):
    row = B.clean_rows(raw(spark, {"currency": None, "schema_version": None, "ingest_timestamp": None}), NOW).first()
    assert (str(row["amount"]), row["currency"], row["schema_version"]) == ("42.50", "USD", 1)
    assert row["ingest_timestamp"] == NOW and row["dt"] == date(2026, 3, 1) and row["is_fraud"] is False
    assert B.clean_rows(raw(spark, {}), NOW).schema.simpleString() == S.BRONZE.simpleString()


def test_columns_a_producer_does_not_send_are_null(spark):
    old = raw(spark, {}).drop("auth_response_code", "currency")
    row = B.clean_rows(old, NOW).first()
    assert row["auth_response_code"] is None and row["currency"] == "USD"


def test_rejects_keep_their_row_and_fall_back_to_arrival_then_today(spark):
    rows = [
        {"transaction_id": "A", "amount": "N/A"},
        {"transaction_id": "B", "timestamp": "?", "ingest_timestamp": "2026-02-27T00:00:00"},
        {"transaction_id": "C", "timestamp": "?", "ingest_timestamp": "?"},
    ]
    out = B.rejected_rows(raw(spark, *rows), NOW)
    assert by_id(out, "dt") == {"A": date(2026, 3, 1), "B": date(2026, 2, 27), "C": date(2026, 3, 2)}
    assert by_id(out, "amount")["A"] == "N/A"


def test_latest_delivery_survives_and_replay_adds_nothing(spark):
    later = (START + timedelta(minutes=5)).isoformat()
    rows = [{"amount": "10"}, {"amount": "99", "ingest_timestamp": later}]
    kept, _ = B.bronze(raw(spark, *rows), NOW)
    assert [str(r["amount"]) for r in kept.collect()] == ["99.00"]
    five = [{"transaction_id": f"T{i}"} for i in range(5)]
    assert B.bronze(raw(spark, *five, *five), NOW)[0].count() == 5


def test_full_ties_are_settled_the_same_way_in_any_order(spark):
    rows = [{"amount": str(a)} for a in (10, 20, 30, 40)]
    forward = B.bronze(raw(spark, *rows), NOW)[0].first()["amount"]
    backward = B.bronze(raw(spark, *reversed(rows)).repartition(3), NOW)[0].first()["amount"]
    assert forward == backward


def test_rejection_breakdown_from_flags_and_from_stored_text(spark):
    rows = raw(spark, {"amount": "N/A"}, {"amount": "N/A", "customer_id": None}, {})
    expected = [("non_numeric_amount", 2), ("null_customer_id", 1)]
    assert [tuple(r) for r in M.rejection_breakdown(B.flag_defects(rows)).collect()] == expected
    stored = B.rejected_rows(rows, NOW).drop("rejection_reasons")
    assert [tuple(r) for r in M.rejection_breakdown(stored).collect()] == expected


def test_ingest_metrics(spark):
    good, bad = B.split(raw(spark, {}, {}, {}, {"amount": None}), NOW)
    assert tuple(M.ingest_metrics(good, bad).first()) == (3, 1, 25.0)
    nothing = spark.createDataFrame([], S.RAW)
    assert tuple(M.ingest_metrics(*B.split(nothing, NOW)).first()) == (0, 0, 0.0)
    rows = raw(spark, {}, {}, {}, {"amount": None})
    once = M.intake_metrics(B.flag_defects(rows))
    assert tuple(once.first()) == (3, 1, 25.0) and tuple(M.intake_metrics(B.flag_defects(nothing)).first()) == (0, 0, 0.0)
    watched, seen = M.watched_intake(B.flag_defects(rows))
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"bronze_rows": 3, "quarantine_rows": 1, "quarantine_pct": 25.0}


def test_the_share_of_rejects_takes_one_scan(spark, folder):
    raw(spark, {}, {"amount": None}).write.parquet(f"{folder}/raw")
    plan = M.intake_metrics(B.flag_defects(spark.read.parquet(f"{folder}/raw")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_extra_columns_reach_quarantine(spark):
    rows = raw(spark, {"amount": None}).withColumn("new_field", F.lit("x"))
    assert B.rejected_rows(rows, NOW).first()["new_field"] == "x"
    assert set(CLEAN) <= set(B.rejected_rows(rows, NOW).columns)
