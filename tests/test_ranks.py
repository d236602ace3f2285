from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import ranks as R


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_totals_and_ranks_in_order(spark, partitions):
    rng = random.Random(4)
    rows = [(None if i == 0 else f"k{i:04d}", rng.choice([None, 0, 3, 5])) for i in range(400)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "key string, n long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = R.running_totals(df, ["key"], {"n": "below"}).collect()
        places = R.ranked(df, ["key"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, total = {}, 0
    for key, n in rows:
        want[key] = total
        total += n or 0
    assert {r.key: r.below for r in got} == want
    assert {r.key: r["rank"] for r in places} == {key: i for i, (key, _) in enumerate(rows)}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "key string, n long")
    assert R.ranked(empty, ["key"]).columns == ["key", "n", "rank"] and R.ranked(empty, ["key"]).isEmpty()


def test_no_window_over_all_rows(spark):
    df = spark.range(1000).withColumn("n", F.lit(1))
    plan = R.running_totals(df, ["id"], {"n": "below"})._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert sum("_range" in line for line in windows) == len(windows)
