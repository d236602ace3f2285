"""Training, evaluation, persistence and scoring of the six-member ensemble."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import PCAModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.functions import scalars as X
from txnrisk.ml import boosting as BO
from txnrisk.ml import features as MF
from txnrisk.ml import members as M
from txnrisk.ml.isolation import NODE_DDL, IsolationForest
from txnrisk.operators import evaluate as E
from txnrisk.operators import splits as SP
from txnrisk.sources import scratch, writers

# --- fixed values: published member names and columns ------------------------------------
SCORE_COLUMNS = {
    "lightgbm": "lightgbm_fraud_probability",
    "xgboost": "xgboost_fraud_probability",
    "random_forest": "random_forest_fraud_probability",
    "svm": "svm_fraud_probability",
    "isolation_forest": "isolation_forest_anomaly_score",
    "autoencoder": "autoencoder_reconstruction_score",
}
ENSEMBLE_SCORE = "ensemble_fraud_score"
MIN_ROWS = 200
AT_ONCE = 4  # fits side by side, fewer where the rows they hold between them would be more than
ROWS_AT_ONCE = 4_000_000
# ----------------------------------------------------------------------------------------

KEY = "transaction_id"
BOOSTED = {
    "lightgbm": BO.Kind("lightgbm", M.BALANCED, 5),
    "xgboost": BO.Kind("xgboost", M.POSITIVE, 6, share=0.7),
}


def plain_mean(columns: list[str]) -> Column:
    """The ensemble's score: every member counts the same."""
    return sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)


def decided(columns: list[str], threshold: float | Column) -> list[Column]:
    """The published columns of a scored row: scores with six decimals, decision, label."""
    return [
        *[F.round(c, 6).alias(c) for c in columns],
        (F.col(ENSEMBLE_SCORE) >= threshold).alias("predicted_is_fraud"),
        (F.col("label") == 1.0).alias("actual_is_fraud"),
    ]


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    forest_trees: int = 300
    forest_depth: int = 10
    isolation_trees: int = 300
    kernel_width: int = 256
    folds: int = 5
    seed: int = SP.SEED
    holdout: float = SP.HOLDOUT
    split: str = "random"
    false_positive_cost: float | None = None
    false_negative_cost: float | None = None


@dataclass(frozen=True)
class Ensemble:
    lightgbm: BO.Boosted
    xgboost: BO.Boosted
    random_forest: M.Forest
    svm: M.KernelMargin
    isolation_forest: IsolationForest
    autoencoder: M.Reconstruction
    explanation: M.Explanation
    threshold: float = 0.5
    feature_names: tuple[str, ...] = field(default=MF.NAMES)

    def members(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with the six scores and their plain mean. Row-local, so it also runs on
        a stream."""
        boosted = {SCORE_COLUMNS[name]: getattr(self, name).score() for name in BOOSTED}
        out = vectors.withColumns(boosted)
        out = self.random_forest.score(out, SCORE_COLUMNS["random_forest"])
        out = self.svm.score(out, SCORE_COLUMNS["svm"])
        isolated = self.isolation_forest.score(vectors.sparkSession)
        out = out.withColumn(SCORE_COLUMNS["isolation_forest"], isolated)
        out = self.autoencoder.score(out, SCORE_COLUMNS["autoencoder"])
        return out.withColumn(ENSEMBLE_SCORE, plain_mean(list(SCORE_COLUMNS.values())))

    def score(self, silver: DataFrame, keep: tuple[str, ...] = (KEY,)) -> DataFrame:
        """Scores, decision and reasons for rows that carry the feature columns."""
        scored = self.members(MF.vectors(silver, list(keep)))
        return self.published(scored, list(keep))

    def published(self, scored: DataFrame, keep: list[str]) -> DataFrame:
        explained = self.explanation.factors(scored, "top_risk_factors")
        columns = [*SCORE_COLUMNS.values(), ENSEMBLE_SCORE]
        return explained.select(*keep, *decided(columns, self.threshold), "top_risk_factors")

    # ------------------------------------------------------------------ persistence

    def _models(self) -> dict:
        return {
            **{f"random_forest_{part}": model for part, model in enumerate(self.random_forest.parts)},
            "svm_calibration": self.svm.calibration,
            "autoencoder_plane": self.autoencoder.plane,
            "explanation_surrogate": self.explanation.surrogate,
        }

    def save(self, spark: SparkSession, path: str, run_id: str) -> None:
        """Models under ``path/run_id``, then the manifest at ``path/latest`` that names them,
        written last so that it never points at half a run."""
        home = f"{path.rstrip('/')}/{run_id}"
        for name, model in self._models().items():
            model.write().overwrite().save(f"{home}/{name}")
        tables = {"isolation_forest": (self.isolation_forest.nodes, NODE_DDL)}
        tables |= {name: (getattr(self, name).trees, BO.TREE_DDL) for name in BOOSTED}
        for name, (rows, layout) in tables.items():
            spark.createDataFrame(rows, layout).coalesce(1).write.mode("overwrite").parquet(f"{home}/{name}")
        manifest = {
            "model_run_id": run_id,
            "threshold": self.threshold,
            "feature_names": list(self.feature_names),
            "models": {name: f"{run_id}/{name}" for name in [*self._models(), *tables]},
            "scaling": {
                "svm": asdict(self.svm.scaler),
                "autoencoder": asdict(self.autoencoder.scaler),
                "explanation": asdict(self.explanation.scaler),
            },
            "svm": {"width": self.svm.width, "seed": self.svm.seed, "weights": self.svm.weights},
            "random_forest": {"parts": len(self.random_forest.parts)},
            "isolation_forest": {"low": self.isolation_forest.low, "high": self.isolation_forest.high},
            "autoencoder": {"low": self.autoencoder.low, "high": self.autoencoder.high},
        }
        line = spark.createDataFrame([(run_id, json.dumps(manifest))], "model_run_id STRING, manifest STRING")
        writers.write_json_line(line, f"{path.rstrip('/')}/latest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        base = path.rstrip("/")
        line = spark.read.schema("model_run_id STRING, manifest STRING").json(f"{base}/latest").first()
        manifest = json.loads(line["manifest"])
        at = {name: f"{base}/{where}" for name, where in manifest["models"].items()}
        scaling = {name: M.Scaling(**values) for name, values in manifest["scaling"].items()}
        layouts = {"isolation_forest": NODE_DDL} | dict.fromkeys(BOOSTED, BO.TREE_DDL)
        tables = {n: [tuple(r) for r in spark.read.schema(layout).parquet(at[n]).collect()] for n, layout in layouts.items()}
        svm = M.KernelMargin(
            scaler=scaling["svm"], calibration=LogisticRegressionModel.load(at["svm_calibration"]), **manifest["svm"]
        )
        parts = range(manifest["random_forest"]["parts"])
        return cls(
            *[BO.Boosted(tables[name]) for name in BOOSTED],
            M.Forest([RandomForestClassificationModel.load(at[f"random_forest_{part}"]) for part in parts]),
            svm,
            IsolationForest(tables["isolation_forest"], **manifest["isolation_forest"]),
            M.Reconstruction(
                scaling["autoencoder"],
                PCAModel.load(at["autoencoder_plane"]),
                **manifest["autoencoder"],
            ),
            M.Explanation(
                scaling["explanation"],
                LogisticRegressionModel.load(at["explanation_surrogate"]),
            ),
            manifest["threshold"],
            tuple(manifest["feature_names"]),
        )


@dataclass(frozen=True)
class Training:
    ensemble: Ensemble
    scores: DataFrame
    """One row per input row: six scores, the ensemble's, decision, reasons, ``in_holdout``."""
    metrics: DataFrame
    """One row per member and one for the ensemble, on the holdout."""


def _guard(df: DataFrame) -> tuple[int, int]:
    fraud = X.tally(X.labelled(F.col("is_fraud")))
    rows, positives = df.agg(F.count("*"), fraud).first()
    if rows < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} rows to train, got {rows}")
    if positives in (0, rows):
        raise ValueError("the label has a single class")
    return rows, positives


def _weighted(split: DataFrame, train_rows: int, positives: int) -> DataFrame:
    negatives = train_rows - positives
    fraud = F.col("label") == 1.0
    return split.withColumns(
        {
            M.BALANCED: F.when(fraud, train_rows / (2.0 * positives)).otherwise(train_rows / (2.0 * negatives)),
            M.POSITIVE: F.when(fraud, negatives / positives).otherwise(1.0),
        }
    )


def side_by_side(spark: SparkSession, tasks: dict, at_once: int = AT_ONCE) -> dict:
    """The results of independent tasks by name, a few at a time: a fit is a row of small jobs, each of which leaves
    cores idle until its last task is done. Each has local properties of its own: Spark keeps the number of the running
    query there."""
    calls = [inheritable_thread_target(spark)(task) for task in tasks.values()]
    with ThreadPool(at_once) as pool:
        return dict(zip(tasks, pool.map(lambda call: call(), calls, chunksize=1), strict=True))


def train(silver: DataFrame, settings: Settings = Settings()) -> Training:
    """Fit on the training side, choose the threshold there, measure on the holdout, score all.

    The model input is written once to shared storage; every iteration of every member reads
    that table.
    """
    spark = silver.sparkSession
    _guard(silver)
    divided = SP.train_holdout(silver, settings.split, holdout=settings.holdout, seed=settings.seed)
    kept = [KEY, *(["dt"] if "dt" in silver.columns else []), "in_holdout"]
    staged = scratch.stage(MF.vectors(divided, kept), "model_input")
    sides = staged.where("NOT in_holdout").agg(F.count("*"), F.count_if(F.col("label") == 1.0)).first()
    table = _weighted(staged, sides[0], sides[1])
    learn = table.where("NOT in_holdout")

    divided = _folds(learn, settings.folds)
    folds = settings.folds if settings.folds > 1 else 0
    boosted, judged = BO.fit(divided, list(BOOSTED.values()), folds, settings.rounds, settings.seed)
    forest = partial(M.Forest.fit, trees=settings.forest_trees, seed=settings.seed, depth=settings.forest_depth)
    margin = M.KernelMargin.fit(learn, settings.kernel_width, settings.seed)
    fits = {
        "random_forest": partial(forest, learn, sides[0]),
        "isolation_forest": lambda: IsolationForest.fit(learn, KEY, settings.isolation_trees, settings.seed, sides[0]),
        "autoencoder": lambda: M.Reconstruction.fit(learn.where("label = 0")),
        "explanation": lambda: M.Explanation.fit(learn),
    }
    # the folds' forests are needed for their scores only, which are written by the task that fits them
    by_fold = {fold: partial(_fold_scores, partial(forest, rows=sides[0]), divided, fold) for fold in range(folds)}
    done = side_by_side(spark, fits | by_fold, max(1, min(AT_ONCE, ROWS_AT_ONCE // sides[0])))
    done |= boosted | {"svm": margin}
    draft = Ensemble(**{name: done[name] for name in [*fits, *boosted, "svm"]})
    scored = scratch.stage(draft.members(staged), "model_scores")
    threshold = chosen_threshold(scored.where("NOT in_holdout"), settings)
    ensemble = Ensemble(**{**_fields(draft), "threshold": threshold})
    scores = ensemble.published(scored, kept)
    metrics = holdout_rows(scored.where("in_holdout"), {**SCORE_COLUMNS, "ensemble": ENSEMBLE_SCORE}, threshold)
    stability = _cross_validated([judged, *[done[fold] for fold in by_fold]])
    return Training(ensemble, scores, metrics.join(F.broadcast(stability), "model_name", "left"))


def _fields(ensemble: Ensemble) -> dict:
    return {name: getattr(ensemble, name) for name in ensemble.__dataclass_fields__}


def chosen_threshold(learned: DataFrame, settings: Settings) -> float:
    """The cut of best F1 on rows with ``label`` and the ensemble's score, or of least cost where costs are set."""
    judged = learned.select(F.col(ENSEMBLE_SCORE).alias("score"), (F.col("label") == 1.0).alias("is_fraud"))
    costs = (settings.false_positive_cost, settings.false_negative_cost)
    best = E.best_f1_threshold(judged) if None in costs else E.min_cost_threshold(judged, *costs)
    return float(best.first()["threshold"])


def holdout_rows(holdout: DataFrame, columns: dict[str, str], threshold: float) -> DataFrame:
    """One row per name in ``columns`` (name to score column), all judged at the ensemble's ``threshold``."""
    rows = [F.struct(F.lit(name).alias("model_name"), F.col(c).alias("score")) for name, c in columns.items()]
    long = holdout.select((F.col("label") == 1.0).alias("is_fraud"), F.inline(F.array(*rows)))
    rated = E.holdout_metrics(long, threshold, ranking=E.exact_ranking_metrics)
    return rated.withColumn("decision_threshold", F.lit(round(threshold, 4)))


def _folds(learn: DataFrame, folds: int) -> DataFrame:
    """The training side dealt into stratified folds, written once; as one when fewer than two are asked for."""
    if folds < 2:
        return learn.withColumn("fold", F.lit(0))
    labelled = learn.withColumn("is_fraud", F.col("label") == 1.0)
    return scratch.stage(SP.stratified_folds(labelled, folds, key=KEY), "folds")


def _fold_scores(fit, divided: DataFrame, fold: int) -> DataFrame:
    """The forest's scores of one fold by a model of the others."""
    model = fit(divided.where(F.col("fold") != fold))
    scored = model.score(divided.where(F.col("fold") == fold), "score")
    return scratch.stage(scored.select(F.lit("random_forest").alias("model_name"), "fold", "score", "is_fraud"), "fold_scores")


def _cross_validated(judged: list[DataFrame]) -> DataFrame:
    """Mean and deviation of the AUC over the folds' scores, for the tree members. All members and folds are
    judged in one pass over bounded histograms."""
    steady = E.fold_stability(reduce(DataFrame.unionByName, judged))
    return steady.select("model_name", F.col("cv_auc_mean").alias("cv5_auc_mean"), F.col("cv_auc_std").alias("cv5_auc_std"))


def stamped_scores(training: Training, run_id: str, scored_at: datetime) -> DataFrame:
    """Rows of the published score table."""
    return training.scores.withColumns(
        {"scored_at": F.lit(scored_at).cast("timestamp"), "model_run_id": F.lit(run_id)}
    )


def stamped_metrics(
    metrics: DataFrame, run_id: str, trained_at: datetime, training_rows: int, fraud_rows: int, feedback_stats: dict | None = None
) -> DataFrame:
    """Rows appended to the metrics history, with the rows and the share of fraud (NULL of no rows) the run
    learned from and what the feedback changed."""
    stats = feedback_stats or {}
    return metrics.withColumns(
        {
            "model_run_id": F.lit(run_id),
            "trained_at": F.lit(trained_at).cast("timestamp"),
            "training_rows": F.lit(training_rows).cast("long"),
            "fraud_rate_in_training_pct": X.percent(F.lit(fraud_rows), F.lit(training_rows), 4),
            "feedback_rows": F.lit(stats.get("feedback_rows", 0)).cast("long"),
            "feedback_labels_confirmed": F.lit(stats.get("labels_confirmed", 0)).cast("long"),
            "feedback_labels_changed": F.lit(stats.get("labels_changed", 0)).cast("long"),
        }
    )


