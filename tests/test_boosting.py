from __future__ import annotations

import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_ml import silver
from txnrisk.ml import boosting as BO
from txnrisk.ml import ensemble as EN
from txnrisk.ml import features as MF
from txnrisk.ml import members as M
from txnrisk.plans import driver
from txnrisk.sources import scratch


@pytest.fixture(scope="module")
def learn(spark):
    rows = MF.vectors(silver(spark, 600), ["transaction_id"]).withColumn("fold", F.pmod(F.hash("transaction_id"), F.lit(2)))
    counts = rows.agg(F.count("*"), F.count_if(F.col("label") == 1.0)).first()
    return scratch.stage(EN._weighted(rows, *counts), "learn")


def test_the_training_queries_take_the_default_settings(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(EN, "train", lambda rows, settings=EN.Settings(): asked.append(settings))
    monkeypatch.setattr(driver.Tables, "silver", lambda self: None)
    driver._training(driver.Tables(spark, "none"))
    assert asked == [EN.Settings()] and asked[0].rounds == 300


def test_the_first_tree_cuts_where_every_cut_tried_says(learn):
    kind = BO.Kind("a", M.BALANCED, 2)
    models, judged = BO.fit(learn, [kind], 0, 1, 42)
    rows = learn.select(MF.VECTOR, "label", M.BALANCED).collect()
    x, y, w = (np.array([r[i] for r in rows]) for i in range(3))
    cuts, slope, bend = BO.cuts_of(learn), w * (0.5 - y), w * 0.25
    _, feature, cut, value = models["a"].trees[0]

    def worth(some):
        return slope[some].sum() ** 2 / (bend[some].sum() + BO.SHRINK)

    def best(inside):
        tried = [(0.0, -1, 0.0)]
        for f, at in enumerate(cuts):
            for c in at:
                left, right = inside & (x[:, f] <= c), inside & (x[:, f] > c)
                if min(bend[left].sum(), bend[right].sum()) >= BO.LEAST:
                    tried.append((worth(left) + worth(right) - worth(inside), f, c))
        return max(tried)

    whole = np.ones(len(x), bool)
    left = x[:, feature[0]] <= cut[0]
    gains = {0: (whole, whole & left, whole & ~left), 1: (left, left & (x[:, feature[1]] <= cut[1]), left & ~(x[:, feature[1]] <= cut[1]))}
    for inside, low, high in gains.values():
        assert worth(low) + worth(high) - worth(inside) == pytest.approx(best(inside)[0], rel=1e-4)
    leaf = gains[1][1]
    assert value[0] == pytest.approx(-BO.RATE * slope[leaf].sum() / (bend[leaf].sum() + BO.SHRINK), rel=1e-4)
    assert judged.count() == 0


def test_a_fold_is_scored_by_trees_that_gave_it_no_weight(learn):
    """The other fold's labels turned: its own scores turn with what it learned from, not with its own labels."""
    kind = BO.Kind("a", M.BALANCED, 3)
    turned = learn.withColumn("label", F.when(F.col("fold") == 0, 1.0 - F.col("label")).otherwise(F.col("label")))

    def scores(rows):
        _, judged = BO.fit(rows, [kind], 2, 3, 42)
        return {fold: sorted(r["score"] for r in judged.where(F.col("fold") == fold).collect()) for fold in (0, 1)}

    plain, other = scores(learn), scores(turned)
    assert plain[0] == pytest.approx(other[0], abs=1e-6) and plain[1] != pytest.approx(other[1], abs=1e-3)
    assert len(plain[0]) + len(plain[1]) == 600


def test_margins_do_not_depend_on_what_a_worker_kept(learn):
    models, _ = BO.fit(learn, [BO.Kind("a", M.BALANCED, 3)], 0, 4, 42)
    rows = learn.select(MF.VECTOR, models["a"].score().alias("score")).collect()
    codes = BO.Codes(BO.cuts_of(learn))
    block = codes.of(np.array([r[0] for r in rows]))
    place = {(f, c): i for i, (f, c) in enumerate(zip(codes.feature.tolist(), codes.cut.tolist(), strict=True))}
    trees = []
    for _, feature, cut, value in models["a"].trees:
        at = [place[f, int(np.searchsorted(codes.cuts[f], c)) if c != float("inf") else BO.BINS] for f, c in zip(feature, cut, strict=True)]
        trees.append(([np.array(at[(1 << level) - 1 : (2 << level) - 1]) for level in range(3)], np.array(value, "f4")))
    fresh, steady = BO.Kept(len(rows)), BO.Kept(len(rows))
    fresh.follow(codes, block, trees, [])
    for done, (splits, _) in enumerate(trees):
        for level in range(3):
            steady.follow(codes, block, trees[:done], splits[:level])
    steady.follow(codes, block, trees, [])
    assert (fresh.margin == steady.margin).all()
    assert BO.logistic(fresh.margin.astype(float)) == pytest.approx([r["score"] for r in rows], abs=1e-6)


def test_a_forest_is_grown_in_parts_where_the_draws_would_be_many(learn, monkeypatch):
    whole = M.Forest.fit(learn, 600, 7, 42)
    monkeypatch.setattr(M, "DRAWS_HELD", 2000)
    parted = M.Forest.fit(learn, 600, 7, 42)
    assert [len(f.parts) for f in (whole, parted)] == [1, 3]
    assert [model.getNumTrees for model in parted.parts] == [3, 2, 2]
    seen = parted.score(learn, "vote")
    for part, model in enumerate(parted.parts):
        seen = M.probability(model, seen, f"part{part}")
    apart = F.abs(F.col("vote") - (3 * F.col("part0") + 2 * F.col("part1") + 2 * F.col("part2")) / 7)
    assert seen.agg(F.max(apart)).first()[0] < 1e-9


def test_the_margin_stores_no_row_and_settles(spark, learn):
    home = Path(scratch.root(spark)) / "txnrisk"
    before = set(home.iterdir())
    margin = M.KernelMargin.fit(learn, 32, 42)
    assert set(home.iterdir()) == before
    weights, lifted = np.array(margin.weights), margin.lift()
    rows = learn.select(MF.VECTOR, "label", M.BALANCED).collect()
    x, y, w = (np.array([r[i] for r in rows]) for i in range(3))
    waves, sign = lifted(x), 2 * y - 1

    def loss(at):
        return (w * np.maximum(0, 1 - sign * (waves @ at)) ** 2).sum() / 2 / w.sum() + M.RIDGE * (at[:-1] ** 2).sum() / 2

    rng = np.random.default_rng(0)
    assert all(loss(weights) <= loss(weights + rng.normal(scale=s, size=len(weights))) + 1e-7 for s in (1e-3, 1e-2, 0.1))


def test_fits_side_by_side_share_no_local_properties(spark):
    both, context = threading.Barrier(2, timeout=60), spark.sparkContext

    def task(name):
        context.setLocalProperty("fit", name)
        both.wait()
        return context.getLocalProperty("fit")

    assert EN.side_by_side(spark, {name: lambda name=name: task(name) for name in "ab"}) == {"a": "a", "b": "b"}
