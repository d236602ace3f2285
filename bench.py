"""Headline timings, one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs to the end into a no-op sink. ``raw_to_bronze`` and ``bronze_to_silver`` are the
staged builds; queries named after an operator read the tables these leave behind, as they would
in a lake. ``raw_to_gold`` is the whole chain from the events with nothing built before.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from txnrisk.plans import driver

QUERIES = (
    "bronze_rejections", "bronze_valid", "dedupe_latest", "upsert_transactions", "velocity_features",
    "amount_zscore", "geo_features", "merchant_risk_scores", "silver_signals", "fraud_metrics_daily",
    "merchant_risk", "fraud_value_daily", "quality_bronze", "quality_silver", "dash_daily", "online_state",
    "feature_matrix", "stratified_split", "temporal_split", "threshold_f1", "auc_ap", "passage_chunks", "topk_cosine",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("txnrisk-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(run) -> float:
    start = time.perf_counter()
    out = run()
    if isinstance(out, DataFrame):
        out.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM's threads
    timings = {"raw_to_gold": seconds(lambda: driver.flagship(spark, sf_dir))}
    driver.Tables.forget()
    tables = driver.Tables.of(spark, sf_dir)
    timings["raw_to_bronze"] = seconds(lambda: tables.bronze().count())
    timings["bronze_to_silver"] = seconds(lambda: tables.silver().count())
    run = driver.queries()
    for name in QUERIES:
        timings[name] = seconds(lambda name=name: run[name](spark, sf_dir))
    line = {
        "metric": "total query time",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
