"""Thresholds and ranking metrics from score histograms.

Scores are published with six decimals, so a histogram over distinct scores has at most
1 000 001 rows per model however many transactions it summarises. Everything below works on it, except
that :func:`exact_ranking_metrics` takes scores as they are, in ranges of the score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions import scalars as X
from txnrisk.operators import ranks as RK

# --- fixed values: 91 cut points .05, .06 ... .95; 0.5 when none is better ---------------
FIRST_CUT, LAST_CUT = 5, 95
DEFAULT_CUT = 0.5
# ----------------------------------------------------------------------------------------


def _histogram(scored: DataFrame, by: list[str], bin_: Column, label: str) -> DataFrame:
    fraud = X.labelled(F.col(label))
    return scored.groupBy(*by, bin_.alias("bin")).agg(
        X.tally(fraud).alias("pos"), X.tally(~fraud).alias("neg")
    )


def _cuts_reached(score: Column) -> Column:
    """How many cut points are at or below ``score``. The product with 100 can miss by one, so
    it is checked against the very doubles the cut points are."""
    guess = F.floor(score * 100)
    cut = (
        F.when(score >= (guess + 1) / F.lit(100.0), guess + 1)
        .when(score < guess / F.lit(100.0), guess - 1)
        .otherwise(guess)
    )
    below = FIRST_CUT - 1
    return F.coalesce(F.greatest(F.least(cut, F.lit(LAST_CUT)), F.lit(below)) - below, F.lit(0))


def _cut_table(scored: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Per model and cut point: tp, fp, fn of "score >= cut". One pass over the rows; the cut
    points come from a bounded sequence, so also those no score falls between are present."""
    bins = _histogram(scored, by, _cuts_reached(F.col(score)), label)
    by_model = bins.groupBy(*by).agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.collect_list(F.struct("bin", "pos", "neg")).alias("bins")
    )
    # bins holds at most 92 entries.
    ranks = F.sequence(F.lit(1), F.lit(LAST_CUT - FIRST_CUT + 1))

    def above(rank: Column, what: str) -> Column:
        # Rows that reached the cut of this rank.
        chosen = F.filter("bins", lambda b: b["bin"] >= rank)
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda total, b: total + b[what])

    points = F.transform(
        ranks,
        lambda rank: F.struct(
            rank.alias("rank"), above(rank, "pos").alias("tp"), above(rank, "neg").alias("fp")
        ),
    )
    exploded = by_model.select(*by, "all_pos", "all_neg", F.inline(points))
    return exploded.select(
        *by,
        ((F.col("rank") + (FIRST_CUT - 1)) / F.lit(100.0)).alias("threshold"),
        "tp",
        "fp",
        (F.col("all_pos") - F.col("tp")).alias("fn"),
        (F.col("all_neg") - F.col("fp")).alias("tn"),
    )


def _best(cuts: DataFrame, by: list[str], merit: Column) -> DataFrame:
    """The first cut point of greatest merit."""
    rated = cuts.withColumn("merit", merit)
    pick = F.max_by("threshold", F.struct("merit", -F.col("threshold")))
    return rated.groupBy(*by).agg(
        F.coalesce(pick, F.lit(DEFAULT_CUT)).alias("threshold"), F.max("merit").alias("merit")
    )


def best_f1_threshold(
    scored: DataFrame, score: str = "score", label: str = "is_fraud", by: list[str] | None = None
) -> DataFrame:
    """``threshold`` and its ``f1``; 0 where nothing is both flagged and fraud."""
    by = by or []
    f1 = X.ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))
    best = _best(_cut_table(scored, score, label, by), by, F.coalesce(f1, F.lit(0.0)))
    return best.withColumnRenamed("merit", "f1")


def min_cost_threshold(
    scored: DataFrame,
    false_positive_cost: float,
    false_negative_cost: float,
    score: str = "score",
    label: str = "is_fraud",
    by: list[str] | None = None,
) -> DataFrame:
    """``threshold`` and its ``cost``: what false alarms and missed fraud come to."""
    by = by or []
    cost = F.col("fp") * F.lit(float(false_positive_cost)) + F.col("fn") * F.lit(float(false_negative_cost))
    best = _best(_cut_table(scored, score, label, by), by, -cost)
    return best.select(*by, "threshold", (-F.col("merit")).alias("cost"))


def ranking_metrics(
    scored: DataFrame, score: str = "score", label: str = "is_fraud", by: list[str] | None = None, digits: int = 4
) -> DataFrame:
    """``roc_auc`` (ties count half) and ``average_precision``, rounded to ``digits`` decimals, NULL
    when a class is missing. Scores count with six decimals."""
    by = by or []
    hist = _histogram(scored, by, X.rounded(F.col(score).cast("double"), 6), label)
    # Two-level running counts: within a thousandth of the score range, plus what lies above it.
    hist = hist.withColumn("slab", F.floor(F.col("bin") * 1000).cast("long"))
    inside = Window.partitionBy(*by, "slab").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*by).orderBy(F.desc("slab")).rowsBetween(Window.unboundedPreceding, -1)
    slabs = hist.groupBy(*by, "slab").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    slabs = slabs.select(
        *by,
        "slab",
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("q").over(above), F.lit(0)).alias("neg_above"),
    )
    keys = [*by, "slab"]
    ranked = hist.join(slabs, keys).withColumns(
        {
            "p0": F.col("pos_above") + F.coalesce(F.sum("pos").over(inside), F.lit(0)),
            "q0": F.col("neg_above") + F.coalesce(F.sum("neg").over(inside), F.lit(0)),
        }
    )
    return _areas(ranked, by, digits)


def exact_ranking_metrics(
    scored: DataFrame, score: str = "score", label: str = "is_fraud", by: list[str] | None = None, digits: int = 4
) -> DataFrame:
    """:func:`ranking_metrics` of the scores as they are: two scores tie only if they are the same double.

    There may be as many distinct scores as rows, so they are dealt by ranges of (model, score), each with
    the totals of the ranges before it; a model's own running counts are the global ones less those at its
    first score. Rows without a score are left out. One model may hold any share of the rows.
    """
    by = by or []
    value = F.col(score).cast("double")
    fraud = X.labelled(F.col(label))
    hist = scored.where(value.isNotNull()).groupBy(*by, value.alias("_score")).agg(X.tally(fraud).alias("pos"), X.tally(~fraud).alias("neg"))
    down = hist.select(*by, (-F.col("_score")).alias("_down"), "pos", "neg")
    totals = RK.running_totals(down, [*by, "_down"], {"pos": "_p", "neg": "_q"})
    # One row a model: a bounded broadcast. Running counts only grow, so the least are those at the first score.
    least = [F.min("_p").alias("_p1"), F.min("_q").alias("_q1")]
    names = [f"_by{i}" for i in range(len(by))]
    first = totals.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(*least)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)]
    both = totals.join(F.broadcast(first), same or F.lit(True))
    ranked = both.select(*by, "pos", "neg", (F.col("_p") - F.col("_p1")).alias("p0"), (F.col("_q") - F.col("_q1")).alias("q0"))
    return _areas(ranked, by, digits)


def _areas(ranked: DataFrame, by: list[str], digits: int) -> DataFrame:
    """Both metrics from a row per score: ``pos`` and ``neg`` at it, ``p0`` and ``q0`` above it."""
    wide = F.col("pos").cast("decimal(20,0)")
    wins = wide * (F.col("q0") * 2 + F.col("neg"))  # twice the negatives ranked above or level
    precision = X.ratio(F.col("p0") + F.col("pos"), F.col("p0") + F.col("pos") + F.col("q0") + F.col("neg"))
    positives, negatives = F.sum("pos"), F.sum("neg")
    lost = X.ratio(F.sum(wins), positives.cast("double") * negatives * 2)
    return ranked.groupBy(*by).agg(
        F.when((positives > 0) & (negatives > 0), X.rounded(1.0 - lost, digits)).alias("roc_auc"),
        F.when(positives > 0, X.rounded(X.ratio(F.sum(precision * F.col("pos")), positives), digits)).alias(
            "average_precision"
        ),
    )


def fold_stability(scored: DataFrame, fold: str = "fold", score: str = "score", label: str = "is_fraud", by: list[str] | None = None) -> DataFrame:
    """``cv_auc_mean`` and ``cv_auc_std`` (of the whole population of folds) per model, over the folds that
    hold both classes, and how many ``folds`` these are."""
    by = by or ["model_name"]
    areas = ranking_metrics(scored, score, label, [*by, fold], digits=8)
    return areas.groupBy(*by).agg(
        F.count("roc_auc").alias("folds"),
        X.rounded(F.avg("roc_auc"), 4).alias("cv_auc_mean"),
        X.rounded(F.stddev_pop("roc_auc"), 4).alias("cv_auc_std"),
    )


def decision_metrics(
    scored: DataFrame,
    threshold: Column | float,
    score: str = "score",
    label: str = "is_fraud",
    by: list[str] | None = None,
) -> DataFrame:
    """Precision, recall and F1 of "score >= threshold"; 0, not NULL, without denominator."""
    flagged = F.col(score) >= threshold
    fraud = X.labelled(F.col(label))
    tp, fp, fn = X.tally(flagged & fraud), X.tally(flagged & ~fraud), X.tally(~flagged & fraud)

    def share(part: Column, whole: Column) -> Column:
        return X.rounded(F.coalesce(X.ratio(part, whole), F.lit(0.0)), 4)

    return scored.groupBy(*(by or [])).agg(
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def holdout_metrics(
    scored: DataFrame,
    threshold: Column | float,
    score: str = "score",
    label: str = "is_fraud",
    by: list[str] | None = None,
    ranking: Callable[..., DataFrame] = ranking_metrics,
) -> DataFrame:
    """The published row per model. ``ranking`` is one of the two above."""
    by = by or ["model_name"]
    ranks = ranking(scored, score, label, by)
    decisions = decision_metrics(scored, threshold, score, label, by)
    return ranks.join(decisions, by).select(
        *by,
        F.col("roc_auc").alias("holdout_roc_auc"),
        F.col("average_precision").alias("holdout_average_precision"),
        F.col("precision").alias("holdout_precision"),
        F.col("recall").alias("holdout_recall"),
        F.col("f1").alias("holdout_f1"),
    )
