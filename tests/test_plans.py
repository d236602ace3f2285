"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from txnrisk.operators import bronze as B
from txnrisk.operators import history as H
from txnrisk.operators import online as O
from txnrisk.operators import silver as V
from txnrisk.plans import driver

SF = "/root/testdata/sf0.001"
PYTHON = re.compile(r"PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas")
USES_PYTHON = ("ensemble_scores", "ensemble_metrics", "stream_scores", "stream_customer_state")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in driver._QUERIES if n not in USES_PYTHON and not n.startswith("stream_")])
def test_relational_queries_stay_in_the_jvm_without_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert not PYTHON.search(text), name
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_copies_are_dropped_before_the_shuffle(spark):
    bronze = B.bronze(driver.Tables.of(spark, SF).raw())[0]
    lines = [line for line in plan(bronze).splitlines() if "Exchange" in line or "WindowGroupLimit" in line]
    assert "Final" in lines[0] and "Exchange" in lines[1] and "Partial" in lines[2]


def test_state_is_cut_to_sixty_before_the_shuffle(spark):
    events = spark.createDataFrame([("C", 1.0, 2.0)], "customer_id string, t double, a double")
    text = plan(O.state_of(events, F.lit(5.0)))
    assert "WindowGroupLimit" in text and "60, Partial" in text


def test_no_window_holds_a_whole_customer_of_rows(spark):
    """Row-level windows are split in time; per-customer ones see a row per block."""
    rows = driver.Tables.of(spark, SF).bronze()
    text = plan(H.customer_history(rows))
    ordered_within_customer = re.findall(r"windowspecdefinition\(customer_id#\d+, (\w+)#\d+L? ASC", text)
    assert set(ordered_within_customer) == {"block"}


def test_wide_rows_are_shuffled_once(spark):
    rows = driver.Tables.of(spark, SF).bronze()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(H.customer_history(rows))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [line for line in text.splitlines() if "Scan parquet" in line and "auth_response_code" in line]
    assert len(wide) == 1
    by_second = [line for line in text.splitlines() if re.search(r"Exchange hashpartitioning\(customer_id#\d+, second#", line)]
    assert by_second and "PythonUDF" not in text


def test_dimension_is_not_force_broadcast(spark):
    rows = driver.Tables.of(spark, SF).bronze()
    logical = V.silver(rows)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in logical and "strategy=broadcast" not in logical


def test_column_pruning_reaches_the_scan(spark):
    silver = driver.Tables.of(spark, SF).silver()
    text = plan(silver.groupBy("dt").agg(F.sum("amount")))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", text).group(1)
    assert schema == "struct<amount:decimal(12,2),dt:date>"
