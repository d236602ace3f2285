from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.rows import START, bronze, by_id
from txnrisk import schemas as S
from txnrisk.operators import history as H


def test_counts_are_in_time_not_rows(spark):
    rows = bronze(spark, *[{"minutes": m} for m in (0, 10, 20, 110)])
    counts = by_id(H.velocity_features(rows), "txn_count_1h", "txn_count_24h")
    assert [counts[f"T{i:04d}"] for i in (1, 2, 3, 4)] == [(1, 1), (2, 2), (3, 3), (1, 4)]


def test_frame_ends_are_inside_and_peers_count(spark):
    rows = bronze(spark, *[{"seconds": s, "amount": 10} for s in (0, 0, 3600, 3601, 86400, 86401)])
    out = by_id(H.velocity_features(rows), "txn_count_1h", "txn_count_24h", "amount_sum_1h")
    assert out["T0001"] == out["T0002"] == (2, 2, 20.0)
    assert out["T0003"] == (3, 3, 30.0) and out["T0004"] == (2, 4, 20.0)
    assert out["T0005"] == (1, 5, 10.0) and out["T0006"] == (2, 4, 20.0)


def test_zscore_uses_only_the_past(spark):
    hours = [{"minutes": 60 * i, "amount": a} for i, a in enumerate((10, 12, 11, 9, 500))]
    out = by_id(H.amount_zscore(bronze(spark, *hours)), "prior_txn_count_30d", "amount_mean_30d", "amount_zscore_30d")
    assert out["T0005"][:2] == (4, 10.5) and out["T0005"][2] > 100
    assert [out[f"T000{i}"][2] for i in (1, 2, 3)] == [None, None, None]


def test_no_spread_is_no_score(spark):
    rows = bronze(spark, *[{"minutes": i, "amount": "19.99"} for i in range(5)])
    out = by_id(H.amount_zscore(rows), "amount_stddev_30d", "amount_zscore_30d")
    assert out["T0005"] == (0.0, None)


def test_travel(spark):
    new_york, los_angeles, moscow = ("40.7128", "-74.0060"), ("34.0522", "-118.2437"), ("55.7558", "37.6173")

    def places(*stops):
        rows = [{"lat": lat, "lon": lon, "minutes": m} for (lat, lon), m in stops]
        return by_id(H.geo_features(bronze(spark, *rows)), "geo_distance_from_prior_km", "implied_speed_kmh")

    out = places((new_york, 0), (los_angeles, 420))
    assert out["T0001"] == (None, None)
    assert abs(out["T0002"][0] - 3936) < 25 and out["T0002"][1] < 900
    km, speed = places((new_york, 0), (moscow, 8))["T0002"]
    assert km > 7000 and speed > 50_000
    assert places((new_york, 0), (new_york, 8))["T0002"] == (0.0, 0.0)
    assert places((new_york, 0), (moscow, 0))["T0002"][1] == S.SAME_SECOND_SPEED_KMH
    assert places((new_york, 0), (new_york, 0))["T0002"] == (0.0, None)


def test_device_change_and_missing_device(spark):
    rows = bronze(spark, *[{"minutes": i, "device_id": d} for i, d in enumerate(("DEV1", "DEV1", "DEV2", None, "DEV1"))])
    out = by_id(H.geo_features(rows), "device_change_flag")
    assert [out[f"T000{i}"] for i in range(1, 6)] == [False, False, True, False, False]


def busy(spark, days: int, n: int, seed: int):
    """One customer with a third of the rows, crowded seconds, gaps over many blocks."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        customer = "HOT" if i % 3 == 0 else f"C{rng.randrange(12)}"
        second = rng.randrange(days * S.DAY) if rng.random() < 0.7 else rng.choice((0, 3600, S.DAY, S.MONTH, 40 * S.DAY))
        rows.append(
            {
                "customer_id": customer, "seconds": second, "amount": rng.choice(("5.00", "17.35", "240.10", "0.99")),
                "merchant_id": f"M{rng.randrange(6)}", "lat": rng.randrange(60), "lon": rng.randrange(60),
                "device_id": f"D{rng.randrange(3)}",
            }
        )
    return bronze(spark, *rows).cache()


@pytest.mark.parametrize(("days", "n"), [(3, 500), (95, 700)])
def test_equals_plain_window_functions(spark, days, n):
    rows = busy(spark, days, n, days)
    second = F.unix_seconds("transaction_timestamp")
    customer = Window.partitionBy("customer_id").orderBy(second)
    hour, day, month = customer.rangeBetween(-3600, 0), customer.rangeBetween(-86400, 0), customer.rangeBetween(-2592000, -1)
    order = Window.partitionBy("customer_id").orderBy("transaction_timestamp", "transaction_id")
    usd = F.col("amount").cast("double")
    expected = rows.select(
        "transaction_id",
        F.count("*").over(hour).alias("txn_count_1h"),
        F.count("*").over(day).alias("txn_count_24h"),
        F.sum("amount").over(hour).cast("double").alias("amount_sum_1h"),
        F.sum("amount").over(day).cast("double").alias("amount_sum_24h"),
        F.size(F.collect_set("merchant_id").over(day)).cast("long").alias("distinct_merchants_24h"),
        F.count("*").over(month).alias("prior_txn_count_30d"),
        F.round(F.avg(usd).over(month), 3).alias("mean"),
        F.round(F.stddev_samp(usd).over(month), 3).alias("spread"),
        (second - F.lag(second).over(order)).alias("seconds_since_prior_txn"),
        F.coalesce(F.lag("device_id").over(order) != F.col("device_id"), F.lit(False)).alias("device_change_flag"),
    )
    ours = H.customer_history(rows)
    assert ours.count() == n
    got = ours.select(
        *[c for c in expected.columns if c not in ("mean", "spread")],
        F.round("amount_mean_30d", 3).alias("mean"),
        F.round("amount_stddev_30d", 3).alias("spread"),
    ).select(*expected.columns)
    exact = [c for c in expected.columns if c not in ("mean", "spread")]
    assert got.select(*exact).exceptAll(expected.select(*exact)).count() == 0
    both = got.alias("a").join(expected.alias("b"), "transaction_id")
    worst = both.select(
        F.max(F.abs(F.col("a.mean") - F.col("b.mean"))), F.max(F.abs(F.col("a.spread") - F.col("b.spread"))),
        F.count_if(F.col("a.mean").isNull() != F.col("b.mean").isNull()),
    ).first()
    assert worst[0] <= 0.0011 and worst[1] <= 0.0011 and worst[2] == 0


def test_row_order_and_partitioning_do_not_matter(spark):
    rows = busy(spark, 20, 200, 7)
    a = H.customer_history(rows).collect()
    b = H.customer_history(rows.repartition(7, "amount")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and START.year == 2026


def test_merchants_are_netted_by_second_before_the_running_sum(spark):
    """A customer with a new merchant in every row: no block holds more changes than it has seconds."""
    rows = bronze(spark, *[{"customer_id": "HOT", "merchant_id": f"M{i}", "seconds": i % 40, "amount": 5} for i in range(1200)])
    netted = H._merchant_changes(rows, F.lit(10**12))
    assert netted.count() == 80 and netted.agg(F.sum("n"), F.max("n")).first()[:] == (0, 30)
    counts = H.velocity_features(rows).select(F.col("distinct_merchants_24h").alias("n"), F.second("transaction_timestamp").alias("s"))
    wrong = counts.where(F.col("n") != (F.col("s") - counts.agg(F.min("s")).scalar() + 1) * 30)
    assert counts.count() == 1200 and wrong.isEmpty()
    plan = H.velocity_features(rows)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(sign" in plan


def test_blocks_are_added_up_on_the_map_side(spark):
    """What a block opens with comes from a row per cell and block, added up before the shuffle: changes are listed once."""
    plan = H.amount_zscore(busy(spark, 20, 50, 7))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum(cents_3") == 1
    rows = busy(spark, 20, 50, 7)
    sums = H._block_sums(H._cells(rows).withColumn("end", F.lit(10**12)), [(F.col("second"), 0, 0), (F.col("second"), 1, 1)], [(1, "n")])
    assert sums.agg(F.sum("n_1")).first()[0] == rows.where("customer_id IS NOT NULL AND transaction_timestamp IS NOT NULL").count()
