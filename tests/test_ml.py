from __future__ import annotations

import threading
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.ml import ensemble as EN
from txnrisk.ml import features as MF
from txnrisk.ml.isolation import expected_path, grow

SMALL = EN.Settings(rounds=4, forest_trees=8, isolation_trees=20, kernel_width=48, folds=2)


def silver(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        fraud = bool(rng.random() < 0.08)
        z = float(rng.normal(5, 1)) if fraud else float(rng.normal(0, 1))
        first = rng.random() < 0.12
        rows.append(
            (
                f"T{i}", float(rng.gamma(2, 400) if fraud else rng.gamma(2, 20)), int(rng.integers(3, 9) if fraud else rng.integers(1, 3)),
                None if rng.random() < 0.3 else z, None if first else float(rng.uniform(200, 5000) if fraud else rng.uniform(0, 100)),
                bool(fraud and rng.random() < 0.8), "ecommerce" if fraud else "card_present", fraud,
            )
        )
    return spark.createDataFrame(
        rows,
        "transaction_id string, amount double, txn_count_1h int, amount_zscore_30d double, implied_speed_kmh double, device_change_flag boolean, channel string, is_fraud boolean",
    )


@pytest.fixture(scope="module")
def trained(spark):
    return EN.train(silver(spark), SMALL)


def test_features_are_stateless_and_mark_what_is_missing(spark):
    row = MF.matrix(silver(spark, 5).withColumn("implied_speed_kmh", F.lit(1e9))).first().asDict()
    assert len(MF.NAMES) == 34 and list(row) == ["transaction_id", *MF.NAMES, "label"]
    assert row["implied_speed_kmh"] == 100_000.0 and row["implied_speed_kmh_missing"] == 0.0
    assert row["merchant_risk_score_missing"] == 1.0 and row["merchant_risk_score"] == 0.0


def test_guards(spark):
    with pytest.raises(ValueError, match="200"):
        EN.train(silver(spark, 50), SMALL)
    with pytest.raises(ValueError, match="single class"):
        EN.train(silver(spark, 300).withColumn("is_fraud", F.lit(False)), SMALL)


def test_members_learn_and_scores_are_complete(trained):
    auc = {r["model_name"]: r for r in trained.metrics.collect()}
    assert set(auc) == {*EN.SCORE_COLUMNS, "ensemble"}
    for name in ("lightgbm", "xgboost", "random_forest", "svm", "ensemble"):
        assert auc[name]["holdout_roc_auc"] > 0.85, name
    for name in ("isolation_forest", "autoencoder"):
        assert auc[name]["holdout_roc_auc"] > 0.6, name
    assert auc["lightgbm"]["cv5_auc_mean"] > 0.8 and auc["svm"]["cv5_auc_mean"] is None
    columns = [*EN.SCORE_COLUMNS.values(), EN.ENSEMBLE_SCORE]
    bad = trained.scores.where(" OR ".join(f"{c} IS NULL OR {c} < 0 OR {c} > 1" for c in columns)).count()
    assert bad == 0 and trained.scores.count() == 1500
    held = trained.scores.where("in_holdout").count()
    assert abs(held - 375) <= 1 and 0.05 <= trained.ensemble.threshold <= 0.95


def test_reasons_name_features(trained):
    told = trained.scores.where("predicted_is_fraud").select(F.explode(F.split("top_risk_factors", ", "))).distinct()
    assert {r[0] for r in told.collect()} <= {*MF.NAMES, "none"}
    assert trained.scores.where(F.size(F.split("top_risk_factors", ", ")) > 3).count() == 0


def test_saved_model_scores_the_same(spark, trained, folder):
    trained.ensemble.save(spark, folder, "run1")
    again = EN.Ensemble.load(spark, folder).score(silver(spark))
    worst = again.alias("a").join(trained.scores.alias("b"), "transaction_id").select(
        F.max(F.abs(F.col(f"a.{EN.ENSEMBLE_SCORE}") - F.col(f"b.{EN.ENSEMBLE_SCORE}"))), F.count("*")
    ).first()
    assert worst[0] <= 1e-6 and worst[1] == 1500


def test_a_tree_isolates_the_outlier_first():
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(size=(255, 2)), [[50.0, 50.0]]])
    depth = []
    for seed in range(30):
        nodes = {n: (f, c, length) for n, f, c, length in grow(points, np.random.default_rng(seed))}

        def path(x, nodes=nodes):
            n = 1
            while nodes[n][0] >= 0:
                n = 2 * n + (x[nodes[n][0]] > nodes[n][1])
            return nodes[n][2]

        depth.append((path(points[-1]), np.mean([path(p) for p in points[:50]])))
    lone, usual = np.mean(depth, axis=0)
    assert lone < usual / 2 and expected_path(256) == pytest.approx(10.244, abs=1e-2)


def test_model_job_publishes_scores_metrics_models_and_value(spark, folder):
    from datetime import datetime

    from txnrisk.plans import driver
    from txnrisk.plans import medallion as P

    lake = P.Lake(folder)
    driver.Tables.of(spark, "/root/testdata/sf0.001").silver().write.partitionBy("dt").parquet(lake.path("silver"))
    confirmed = spark.createDataFrame([("T1", False, "2024-02-01"), ("T2", True, "2024-02-01"), ("NONE", True, "2024-02-01")], "transaction_id string, confirmed_is_fraud boolean, confirmed_at string")
    confirmed.write.json(lake.path("feedback"))
    as_of = datetime(2024, 1, 31)
    quick = EN.Settings(rounds=2, forest_trees=3, isolation_trees=5, kernel_width=16, folds=0)
    P.run_model(spark, lake, as_of, "run-1", quick)
    rows = spark.read.parquet(lake.path("silver")).count()
    scores = spark.read.parquet(lake.path("transaction_risk_scores"))
    assert scores.count() == rows and scores.select("model_run_id").distinct().count() == 1
    metrics = spark.read.parquet(lake.path("model_metrics"))
    assert metrics.count() == 7
    first = metrics.first()
    assert (first["feedback_rows"], first["feedback_labels_confirmed"], first["training_rows"]) == (3, 2, rows)
    value = spark.read.parquet(lake.path("fraud_value_daily"))
    assert value.agg(F.sum("transaction_count")).first()[0] == rows
    assert EN.Ensemble.load(spark, lake.path("models")).score(spark.read.parquet(lake.path("silver"))).count() == rows


def test_a_run_of_the_history_says_what_it_learned_from(spark):
    rated = spark.createDataFrame([("a", 0.5)], "model_name STRING, holdout_roc_auc DOUBLE")
    row = EN.stamped_metrics(rated, "r1", datetime(2026, 3, 1), 8, 3, {"feedback_rows": 2}).first()
    assert (row["training_rows"], row["fraud_rate_in_training_pct"], row["feedback_rows"], row["feedback_labels_changed"]) == (8, 37.5, 2, 0)
    assert EN.stamped_metrics(rated, "r1", datetime(2026, 3, 1), 0, 0).first()["fraud_rate_in_training_pct"] is None


def test_fits_run_side_by_side_and_keep_their_names(spark):
    """Each task waits for the other: one after the other they would never end."""
    both = threading.Barrier(2, timeout=60)

    def task(n):
        both.wait()
        return spark.range(n).count()

    assert EN.side_by_side(spark, {"a": lambda: task(3), ("b", 1): lambda: task(5)}) == {"a": 3, ("b", 1): 5}
    assert EN.side_by_side(spark, {}) == {}
    with pytest.raises(ZeroDivisionError):
        EN.side_by_side(spark, {"a": lambda: 1 / 0})
