from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.rows import START, bronze
from txnrisk import schemas as S
from txnrisk.operators import gold as G
from txnrisk.operators import monitor as M
from txnrisk.operators import quality as Q
from txnrisk.operators import silver as V

AS_OF = START + timedelta(hours=1)


def failed(df, layer, rules) -> set[str]:
    return {r["rule"] for r in Q.evaluate(df, layer, rules).where("outcome = 'Failed'").collect()}


def test_a_good_lake_passes_every_layer(spark):
    rows = bronze(spark, *[{"minutes": i, "amount": 10 + i} for i in range(12)])
    dim = V.merchant_risk_scores(rows)
    silver = V.silver(rows, dim)
    assert failed(rows, "bronze", Q.bronze_rules(AS_OF, dim)) == set()
    assert failed(silver, "silver", Q.silver_rules()) == set()
    assert failed(G.fraud_metrics_daily(silver), "gold", Q.gold_rules()) == set()
    assert (len(Q.bronze_rules(AS_OF, dim)), len(Q.silver_rules()), len(Q.gold_rules())) == (14, 15, 9)
    assert len(Q.bronze_rules(AS_OF)) == 13


def test_bounds_the_validator_admits_pass_the_gate(spark):
    rows = bronze(spark, {"amount": "0.01"}, {"amount": "25000.00"}, {"channel": None}, {"lat": None, "lon": "180"})
    assert failed(rows, "bronze", Q.bronze_rules(AS_OF)) == set()


def test_each_kind_of_rule_can_fail(spark):
    rows = bronze(spark, *[{"minutes": i} for i in range(4)])
    known = V.merchant_risk_scores(rows)
    broken = {
        "IsComplete customer_id": rows.withColumn("customer_id", F.lit(None).cast("string")),
        "IsUnique transaction_id": rows.unionByName(rows),
        "ColumnValues amount between 0.01 and 25000.0 inclusive": rows.withColumn("amount", F.lit(0).cast("decimal(12,2)")),
        "ColumnValues channel in card_present,ecommerce,contactless,recurring": rows.withColumn("channel", F.lit("fax")),
        "Completeness currency > 0.99": rows.withColumn("currency", F.when(F.col("transaction_id") != "T0001", "USD")),
        "Fresh transaction_timestamp within 3h": rows.withColumn("transaction_timestamp", F.lit(datetime(2020, 1, 1))),
        "References merchant_id": rows.withColumn("merchant_id", F.lit("ELSE")),
    }
    for rule, df in broken.items():
        assert rule in failed(df, "bronze", Q.bronze_rules(AS_OF, known)), rule
    assert "RowCount > 0" in failed(rows.limit(0), "bronze", Q.bronze_rules(AS_OF))


def test_exclusive_between_and_nulls_fail_by_default(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    nulls = spark.createDataFrame([(None,)], "x double")
    assert failed(df, "t", [Q.between("x", 0, 2)]) and not failed(df, "t", [Q.between("x", 0, 2, inclusive=True)])
    assert failed(nulls, "t", [Q.between("x", 0, 2)]) and not failed(nulls, "t", [Q.between("x", 0, 2, null_passes=True)])
    assert failed(nulls, "t", [Q.at_least("x", 0)]) and not failed(nulls, "t", [Q.never("negative", F.col("x") < 0)])


def test_report_and_gate(spark):
    df = spark.createDataFrame([(None,)], "x int")
    outcomes = Q.evaluate(df, "t", [Q.is_complete("x"), Q.has_rows()])
    report = Q.report(outcomes, "t").first().asDict(recursive=True)
    assert (report["total_rules"], report["failed_count"], report["pass_rate_pct"], report["passed"]) == (2, 1, 50.0, False)
    assert [r["rule"] for r in report["failed_rules"]] == ["IsComplete x"]
    none = Q.report(outcomes, "other").first()
    assert (none["total_rules"], none["pass_rate_pct"]) == (0, 0.0)
    assert Q.gate(None, "t")["passed"] is False and Q.gate(None, "t")["failed_count"] == -1
    many = {"passed": False, "failed_rules": list(range(25)), "failed_count": 25}
    assert len(Q.gate(many, "t")["failed_rules"]) == 25 and Q.gate({}, "t")["passed"] is False


def test_health_checks(spark):
    rows = bronze(spark, {})
    assert M.freshness(rows, AS_OF).first()["alarm"] is False
    assert M.freshness(rows, AS_OF + timedelta(hours=9)).first()["alarm"] is True
    assert M.freshness(spark.createDataFrame([], S.BRONZE), AS_OF).first()["alarm"] is True
    runs = spark.createDataFrame([("r1", "ensemble", 0.95), ("r2", "ensemble", 0.79), ("r2", "svm", 0.5)], "model_run_id string, model_name string, holdout_roc_auc double")
    assert M.drift(runs).first()["alarm"] is True and M.drift(runs.where("model_run_id = 'r1'")).first()["alarm"] is False
    intake = spark.createDataFrame([(95, 5, 5.0), (94, 6, 6.0)], "bronze_rows int, quarantine_rows int, quarantine_pct double")
    assert sorted(r["alarm"] for r in M.quarantine_pressure(intake).collect()) == [False, True]
