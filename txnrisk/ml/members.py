"""Three of the members and the reasons, each a fitted model that adds one column.

Stand-ins, where MLlib has no equal of what such ensembles usually hold: a linear margin (squared
hinge) over random Fourier features for the RBF kernel machine (same kernel in expectation, linear
cost, so no subsampling); a PCA bottleneck for the autoencoder (the linear case of it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.ml.features import NAMES, VECTOR

# --- fixed values -----------------------------------------------------------------------
BOTTLENECK = 8
ERROR_LOW, ERROR_HIGH = 0.01, 0.99
TOP_FACTORS = 3
DRAWS_HELD = 100_000_000  # a forest in training keeps a count per row and tree
PRIME = 1_000_003  # apart from the seeds MLlib makes of one by adding a partition's number
RIDGE, SETTLED = 1e-4, 1e-7
# ----------------------------------------------------------------------------------------

BALANCED, POSITIVE = "balanced_weight", "positive_weight"


def probability(model: Model, df: DataFrame, name: str) -> DataFrame:
    """``df`` with the fraud probability of a fitted classifier as column ``name``."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


@dataclass(frozen=True)
class Scaling:
    """Standardised features as ``z``. A feature that never varies in the fitted rows keeps its
    unit: one that is constant among legitimate rows and moves in fraud is the best sign there
    is, and MLlib's scaler would turn it into a constant 0."""

    mean: list[float]
    spread: list[float]

    @classmethod
    def fit(cls, rows: DataFrame) -> Scaling:
        summary = Summarizer.metrics("mean", "std").summary(F.col(VECTOR))
        mean, spread = rows.select(summary.alias("s")).select("s.mean", "s.std").first()
        return cls([float(m) for m in mean], [float(d) if d > 0 else 1.0 for d in spread])

    def apply(self, df: DataFrame) -> DataFrame:
        scaled = F.zip_with(vector_to_array(VECTOR), _array(self.mean), lambda x, m: x - m)
        return df.withColumn("z", array_to_vector(F.zip_with(scaled, _array(self.spread), lambda x, d: x / d)))


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


@dataclass(frozen=True)
class Forest:
    """A forest grown in parts; its vote is the mean of the trees' votes."""

    parts: list[RandomForestClassificationModel]

    @classmethod
    def fit(cls, train: DataFrame, rows: int, trees: int, seed: int, depth: int = 10) -> Forest:
        """MLlib keeps for every row how often each tree drew it. The parts are one if there is room for those counts,
        else as few as keep them within ``DRAWS_HELD``: what is held grows with the rows, not with rows times trees."""
        parts = min(trees, -(-rows * trees // DRAWS_HELD))
        sizes = [trees // parts + (part < trees % parts) for part in range(parts)]
        return cls([
            RandomForestClassifier(
                featuresCol=VECTOR, labelCol="label", weightCol=BALANCED, numTrees=size, maxDepth=depth, seed=seed + PRIME * part
            ).fit(train)
            for part, size in enumerate(sizes)
        ])

    def score(self, df: DataFrame, name: str) -> DataFrame:
        votes = [(model, f"{name}_{part}") for part, model in enumerate(self.parts)]
        out = reduce(lambda made, vote: probability(vote[0], made, vote[1]), votes, df)
        trees = sum(model.getNumTrees for model, _ in votes)
        mean = sum(F.col(vote) * (model.getNumTrees / trees) for model, vote in votes)
        return out.select(*df.columns, mean.alias(name))


@dataclass(frozen=True)
class KernelMargin:
    """A linear margin over waves of the standardised features: ``weights``, the last of them the intercept."""

    scaler: Scaling
    weights: list[float]
    calibration: LogisticRegressionModel
    width: int
    seed: int

    def lift(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows of features to waves, whose mean products approximate exp(-|x-y|^2 / 34), and a constant 1."""
        rng = np.random.default_rng(self.seed)
        gamma = 1.0 / len(NAMES)
        spread = rng.normal(scale=np.sqrt(2 * gamma), size=(len(NAMES), self.width))
        phase = rng.uniform(0, 2 * np.pi, size=self.width)
        mean, scale, width = np.array(self.scaler.mean), np.array(self.scaler.spread), self.width

        def lifted(x: np.ndarray) -> np.ndarray:
            out = np.ones((len(x), width + 1))
            np.cos(((x - mean) / scale) @ spread + phase, out=out[:, :width])
            out[:, :width] *= np.sqrt(2.0)
            return out

        return lifted

    @classmethod
    def fit(cls, train: DataFrame, width: int, seed: int, steps: int = 50) -> KernelMargin:
        """The waves are some 2 kB a row, so they are made anew at every step and never stored."""
        draft = cls(Scaling.fit(train), [], None, width, seed)
        weights = separated(train, draft.lift(), width + 1, steps)
        drawn = cls(draft.scaler, weights, None, width, seed)
        judged = train.select("label", drawn.raw())
        calibration = LogisticRegression(
            featuresCol="raw", labelCol="label", rawPredictionCol="logit", predictionCol="decided"
        ).fit(judged)
        return cls(draft.scaler, weights, calibration, width, seed)

    def raw(self) -> Column:
        lifted, weights = self.lift(), np.array(self.weights)

        @F.pandas_udf("double")
        def margin(points: pd.Series) -> pd.Series:
            if points.empty:
                return pd.Series([], dtype=float)
            return pd.Series(lifted(np.stack(points.to_numpy())) @ weights)

        return array_to_vector(F.array(margin(vector_to_array(VECTOR)))).alias("raw")

    def score(self, df: DataFrame, name: str) -> DataFrame:
        judged = self.calibration.transform(df.select(*df.columns, self.raw()))
        return judged.select(*df.columns, vector_to_array("probability")[1].alias(name))


def separated(train: DataFrame, lifted: Callable[[np.ndarray], np.ndarray], width: int, steps: int) -> list[float]:
    """The weights of least squared hinge loss and ridge, by Newton's method. A step is one pass over the rows, from which
    loss, slope and curvature come back: ``width`` squared numbers a task, whatever the rows."""
    rows = train.select(vector_to_array(VECTOR).alias("x"), "label", BALANCED).coalesce(train.sparkSession.sparkContext.defaultParallelism)

    def sums(weights: np.ndarray) -> np.ndarray:
        """Loss and weight of all rows, then slope, then curvature."""

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + width + width * width)
            for batch in batches:
                waves = lifted(batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES)))
                sign, weight = 2.0 * batch.column("label").to_numpy() - 1.0, batch.column(BALANCED).to_numpy()
                slack = np.maximum(0.0, 1.0 - sign * (waves @ weights))
                total[:2] += (weight * slack * slack).sum() / 2, weight.sum()
                wrong = slack > 0
                pull = waves[wrong] * weight[wrong, None]
                total[2 : 2 + width] -= pull.T @ (sign * slack)[wrong]
                total[2 + width :] += (pull.T @ waves[wrong]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

        told = rows.mapInArrow(one, "total BINARY").collect()
        return sum(np.frombuffer(row["total"]) for row in told)

    ridge = np.append(np.full(width - 1, RIDGE), 1e-12)  # the intercept is free
    weights, step, best = np.zeros(width), np.zeros(width), np.inf
    for _ in range(steps):
        total = sums(weights)
        loss = total[0] / total[1] + (ridge * weights * weights).sum() / 2
        if loss > best:
            step = step / 2
            weights = weights - step
            continue
        if best - loss <= SETTLED * loss:
            break
        best = loss
        slope = total[2 : 2 + width] / total[1] + ridge * weights
        bend = total[2 + width :].reshape(width, width) / total[1] + np.diag(ridge)
        step = -np.linalg.lstsq(bend, slope, rcond=None)[0]
        weights = weights + step
    return weights.tolist()


@dataclass(frozen=True)
class Reconstruction:
    """Distance of a row from the plane normal rows lie on; ``low`` and ``high`` are the errors
    of the training rows' 1st and 99th percentile."""

    scaler: Scaling
    plane: PCAModel
    low: float = 0.0
    high: float = 1.0

    @classmethod
    def fit(cls, legitimate: DataFrame) -> Reconstruction:
        scaler = Scaling.fit(legitimate)
        plane = PCA(k=BOTTLENECK, inputCol="z", outputCol="p").fit(scaler.apply(legitimate))
        raw = cls(scaler, plane)
        errors = raw._errors(legitimate)
        marks = errors.agg(F.percentile_approx("error", [ERROR_LOW, ERROR_HIGH], 100_000)).first()[0]
        return cls(scaler, plane, float(marks[0]), float(marks[1]))

    def _errors(self, df: DataFrame) -> DataFrame:
        """The components are orthonormal, so what the plane misses is |z|^2 - |p|^2."""
        projected = self.plane.transform(self.scaler.apply(df))

        def length(vector: str) -> Column:
            return F.aggregate(vector_to_array(vector), F.lit(0.0), lambda total, v: total + v * v)

        missed = F.greatest(length("z") - length("p"), F.lit(0.0)) / len(NAMES)
        return projected.select(*df.columns, missed.alias("error"))

    def score(self, df: DataFrame, name: str) -> DataFrame:
        span = max(self.high - self.low, 1e-9)
        scaled = (F.col("error") - F.lit(self.low)) / F.lit(span)
        clipped = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
        return self._errors(df).select(*df.columns, clipped.alias(name))


@dataclass(frozen=True)
class Explanation:
    """Why a score is high: a logistic surrogate's largest positive terms."""

    scaler: Scaling
    surrogate: LogisticRegressionModel

    @classmethod
    def fit(cls, train: DataFrame) -> Explanation:
        scaler = Scaling.fit(train)
        surrogate = LogisticRegression(
            featuresCol="z", labelCol="label", weightCol=BALANCED, regParam=1e-3, maxIter=50
        ).fit(scaler.apply(train))
        return cls(scaler, surrogate)

    def factors(self, df: DataFrame, name: str) -> DataFrame:
        weights = [float(c) for c in self.surrogate.coefficients]
        terms = F.arrays_zip(
            F.zip_with(vector_to_array("z"), _array(weights), lambda z, w: z * w).alias("term"),
            F.array(*[F.lit(n) for n in NAMES]).alias("name"),
        )
        raising = F.filter(terms, lambda t: t["term"] > 0)
        largest = F.slice(F.sort_array(raising, asc=False), 1, TOP_FACTORS)
        told = F.array_join(F.transform(largest, lambda t: t["name"]), ", ")
        explained = F.when(F.size(raising) > 0, told).otherwise("none")
        return self.scaler.apply(df).select(*df.columns, explained.alias(name))
