from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.operators import evaluate as E
from txnrisk.operators import splits as SP


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    fraud = rng.random(800) < 0.1
    score = np.round(np.clip(rng.normal(0.35 + 0.25 * fraud, 0.2), 0, 1), 2)
    df = spark.createDataFrame([(f"T{i}", bool(f), float(s)) for i, (f, s) in enumerate(zip(fraud, score))], "transaction_id string, is_fraud boolean, score double").cache()
    return df, fraud, score


def cut_points():
    return [i / 100.0 for i in range(5, 96)]


def test_best_f1_and_min_cost_against_a_loop(sample):
    df, fraud, score = sample

    def counts(t):
        flagged = score >= t
        return (flagged & fraud).sum(), (flagged & ~fraud).sum(), (~flagged & fraud).sum()

    f1 = [2 * tp / (2 * tp + fp + fn) for tp, fp, fn in map(counts, cut_points())]
    best = E.best_f1_threshold(df).first()
    assert best["threshold"] == cut_points()[int(np.argmax(f1))] and best["f1"] == pytest.approx(max(f1))
    cost = [1.0 * fp + 15.0 * fn for _, fp, fn in map(counts, cut_points())]
    cheapest = E.min_cost_threshold(df, 1.0, 15.0).first()
    assert cheapest["threshold"] == cut_points()[int(np.argmin(cost))] and cheapest["cost"] == min(cost)


def test_ranking_metrics_against_pairs(sample):
    df, fraud, score = sample
    pos, neg = score[fraud], score[~fraud]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, seen = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        recall = (score[fraud] >= t).mean()
        ap += (recall - seen) * fraud[score >= t].mean()
        seen = recall
    row = E.ranking_metrics(df).first()
    assert row["roc_auc"] == pytest.approx(auc, abs=6e-5) and row["average_precision"] == pytest.approx(ap, abs=6e-5)


def test_one_class_has_no_auc(spark):
    row = E.ranking_metrics(spark.createDataFrame([(0.3, False)], "score double, is_fraud boolean")).first()
    assert row["roc_auc"] is None and row["average_precision"] is None


def test_decisions_without_denominator_are_zero(spark):
    row = E.decision_metrics(spark.createDataFrame([(0.3, False)], "score double, is_fraud boolean"), 0.5).first()
    assert tuple(row) == (0.0, 0.0, 0.0)


def test_stratified_split_is_exact(sample):
    df, fraud, _ = sample
    held = {r["transaction_id"] for r in SP.stratified_split(df).where("in_holdout").collect()}
    for label in (True, False):
        ids = [f"T{i}" for i in np.flatnonzero(fraud == label)]
        ids.sort(key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        assert held & set(ids) == set(ids[len(ids) - math.ceil(len(ids) * 0.25):])


def test_temporal_split_is_exact_with_ties(spark):
    df = spark.range(0, 103).select(
        F.concat(F.lit("T"), F.lpad("id", 3, "0")).alias("transaction_id"), (F.col("id") % 4 == 0).alias("is_fraud"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 40) * 90_000).alias("transaction_timestamp"),
    )
    held = sorted(r["transaction_id"] for r in SP.temporal_split(df).where("in_holdout").collect())
    assert held == [f"T{i:03d}" for i in range(math.floor(103 * 0.75), 103)]


def test_temporal_falls_back_when_a_side_has_one_class(spark):
    df = spark.range(0, 400).select(
        F.concat(F.lit("T"), "id").alias("transaction_id"), (F.col("id") >= 390).alias("is_fraud"),
        F.timestamp_seconds(F.col("id")).alias("transaction_timestamp"),
    )
    sides = SP.train_holdout(df, "temporal").groupBy("in_holdout").agg(F.count_if("is_fraud")).collect()
    assert all(row[1] > 0 for row in sides)


def test_the_split_takes_its_share_and_seed(spark):
    rows = spark.range(400).selectExpr("concat('T', id) AS transaction_id", "id % 10 = 0 AS is_fraud", "date_add(DATE '2024-01-01', int(id / 40)) AS dt")
    half = SP.train_holdout(rows, "random", holdout=0.5, seed=7)
    assert half.where("in_holdout").count() == 200 and half.where("in_holdout AND is_fraud").count() == 20
    other = SP.train_holdout(rows, "random", holdout=0.5, seed=8)
    assert half.where("in_holdout").join(other.where("in_holdout"), "transaction_id").count() < 200
    by_day = SP.train_holdout(rows, "temporal", holdout=0.4)  # no event time: the day decides
    assert by_day.where("in_holdout").count() == 160 and by_day.where("in_holdout AND dt <= '2024-01-06'").isEmpty()


def test_exact_ranks_keep_what_six_decimals_lose(spark, sample):
    """Scores a billionth apart, two models of unequal size, one of a single class, a missing score."""
    rng = np.random.default_rng(8)
    score, fraud = np.round(rng.random(600), 2) * 1e-8, rng.random(600) < 0.3
    rows = [("a", bool(f), float(s)) for f, s in zip(fraud, score)] + [("b", False, 0.5), ("b", None, 0.25), ("b", True, None)]
    df = spark.createDataFrame(rows, "model_name string, is_fraud boolean, score double")
    pos, neg = score[fraud], score[~fraud]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, seen = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        recall = (score[fraud] >= t).mean()
        ap += (recall - seen) * fraud[score >= t].mean()
        seen = recall
    got = {r["model_name"]: r for r in E.exact_ranking_metrics(df, by=["model_name"]).collect()}
    assert got["a"]["roc_auc"] == pytest.approx(auc, abs=6e-5) and got["a"]["average_precision"] == pytest.approx(ap, abs=6e-5)
    assert got["b"]["roc_auc"] is None and got["b"]["average_precision"] is None
    assert E.ranking_metrics(df.where("model_name = 'a'")).first()["roc_auc"] == 0.5
    assert E.exact_ranking_metrics(sample[0]).collect() == E.ranking_metrics(sample[0]).collect()
    assert E.exact_ranking_metrics(df.limit(0), by=["model_name"]).isEmpty()


def test_folds_are_dealt_in_turn_within_a_label(spark, sample):
    df, fraud, _ = sample
    got = {r["transaction_id"]: r["fold"] for r in SP.stratified_folds(df.withColumn("_n", F.lit(1)), 5).collect()}
    for label in (True, False):
        ids = sorted((f"T{i}" for i in np.flatnonzero(fraud == label)), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        assert [got[i] for i in ids] == [n % 5 for n in range(len(ids))]
    repeated = SP.stratified_folds(df.limit(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(10)))), 5).groupBy("fold").count()
    assert sorted(map(tuple, repeated.collect())) == [(i, 2) for i in range(5)]
    assert SP.stratified_folds(df.limit(0), 5).columns == [*df.columns, "fold"] and SP.stratified_folds(df.limit(0), 5).isEmpty()


def test_stability_is_the_mean_and_spread_of_the_folds(sample):
    df, _, _ = sample
    dealt = SP.stratified_folds(df, 4).withColumn("model_name", F.lit("m"))
    areas = [E.ranking_metrics(dealt.where(F.col("fold") == k), digits=8).first()["roc_auc"] for k in range(4)]
    row = E.fold_stability(dealt).first()
    assert row["folds"] == 4 and row["cv_auc_mean"] == pytest.approx(np.mean(areas), abs=6e-5) and row["cv_auc_std"] == pytest.approx(np.std(areas), abs=6e-5)


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_temporal_split_descends_into_ids_when_all_rows_share_a_moment(spark, monkeypatch, kind):
    """No more than three rows may be ordered in one place; ids of unequal length, below zero, repeated, missing."""
    monkeypatch.setattr(SP, "FEW", 3)
    ids = [None, *range(-40, 60), 70_000, 70_001, 5_000_000_000, 7, 7, 7, 7, 7]
    df = spark.createDataFrame([(i,) for i in ids], "n bigint").select(
        F.col("n").cast(kind).alias("transaction_id"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("transaction_timestamp")
    )
    order = sorted(ids, key=lambda i: (i is not None, (str(i) if kind == "string" else i) if i is not None else 0))
    train = int(len(ids) * 0.75)
    want = sorted(map(str, [i for i in order[train:] if i != order[train - 1]]))
    assert sorted(str(r["transaction_id"]) for r in SP.temporal_split(df).where("in_holdout").collect()) == want
