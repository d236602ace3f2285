"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams it holds, once each. The log ratio of an n-gram's share among
toxic texts to its share among the others scales its feature, the scaled vector is brought to unit
length, and a logistic regression learns a weight for each; models of parts of the sample judge the
rest of it to calibrate the scores. The model is learnt from a bounded sample of labelled rows,
whose size is a parameter, in one task; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import by_hash, id_bucket, rows
from txnrisk.llm.ngrams import grams


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (4, 5, 6, 7)
    bits: int = 20  # n-grams share 2**bits buckets: the bound of everything the model holds
    per_class: int = 3000  # labelled rows of either class that the model is learnt from, at most
    smoothing: float = 1.0
    least_texts: int = 6  # an n-gram in fewer sampled texts is not a feature
    least_ratio: float = 1.5  # nor is one whose log ratio is smaller
    epochs: int = 6
    rate: float = 0.5
    shrink: float = 1e-5
    folds: int = 3  # of the sample, each judged by a model of the others, to calibrate the scores


@dataclass
class Model:
    """For each bucket its log ratio, 0 where it is no feature, and the weight times the ratio."""

    ratio: np.ndarray
    scaled: np.ndarray
    intercept: float
    settings: Settings

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(text), -500, 500)))

    def margin(self, text: str | None) -> float:
        found = grams(text or "", self.settings.orders, self.settings.bits)
        found = np.unique(found[self.ratio[found] != 0])
        length = np.sqrt((self.ratio[found].astype(float) ** 2).sum())
        return self.intercept + (self.scaled[found].astype(float).sum() / length if len(found) else 0.0)


def sampled(texts: list[str], settings: Settings) -> list[np.ndarray]:
    """The distinct buckets of each text, of those that enough texts hold: read twice, so that the rest is never kept."""
    inside = np.zeros(1 << settings.bits, dtype=np.int32)
    for t in texts:
        inside[np.unique(grams(t, settings.orders, settings.bits))] += 1
    frequent = inside >= settings.least_texts
    out = []
    for t in texts:
        found = grams(t, settings.orders, settings.bits)
        out.append(np.unique(found[frequent[found]]).astype(np.int32))
    return out


def learn(texts: list[np.ndarray], toxic: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Ratio and weight times ratio by bucket, and the intercept. ``texts``: distinct buckets of each."""
    size = 1 << settings.bits
    if not len(texts) or toxic.all() or not toxic.any():  # nothing to tell apart
        return np.zeros(size), np.zeros(size), 0.0
    with_it = {c: np.zeros(size, dtype=np.int64) for c in (0, 1)}
    for t, y in zip(texts, toxic, strict=True):
        with_it[int(y)][t] += 1
    share = {c: (with_it[c] + settings.smoothing) / ((toxic == c).sum() + 2 * settings.smoothing) for c in (0, 1)}
    ratio = np.log(share[1] / share[0])
    ratio[(with_it[0] + with_it[1] < settings.least_texts) | (np.abs(ratio) < settings.least_ratio)] = 0
    vectors = []
    for t in texts:
        kept = t[ratio[t] != 0]
        x = ratio[kept]
        vectors.append((kept, x / max(np.sqrt((x**2).sum()), 1e-12)))
    weight, squares, bias, bias_squares = np.zeros(size), np.full(size, 1e-8), 0.0, 1e-8
    order = np.random.default_rng(7)
    balance = {1: 0.5 / toxic.mean(), 0: 0.5 / (1 - toxic.mean())}
    for _ in range(settings.epochs):
        for i in order.permutation(len(texts)):
            kept, x = vectors[i]
            off = (1.0 / (1.0 + np.exp(-(weight[kept] @ x + bias))) - toxic[i]) * balance[int(toxic[i])]
            step = off * x + settings.shrink * weight[kept]
            squares[kept] += step**2
            weight[kept] -= settings.rate * step / np.sqrt(squares[kept])
            bias_squares += off**2
            bias -= settings.rate * off / np.sqrt(bias_squares)
    return ratio, weight * ratio, float(bias)


def margins(texts: list[np.ndarray], ratio: np.ndarray, scaled: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    for i, t in enumerate(texts):
        kept = t[ratio[t] != 0]
        if len(kept):
            out[i] += scaled[kept].sum() / np.sqrt((ratio[kept] ** 2).sum())
    return out


def calibrated(margin: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the margin at which the labels are likeliest, classes weighted to ``prior``; Newton's method."""
    share = toxic.mean()
    weight = np.where(toxic == 1, prior / share, (1 - prior) / (1 - share))
    inputs = np.stack([margin, np.ones_like(margin)])
    at = np.array([1.0, np.log(prior / (1 - prior))])
    for _ in range(50):
        chance = 1.0 / (1.0 + np.exp(-np.clip(at @ inputs, -30, 30)))
        curve = (inputs * (weight * (chance * (1 - chance) + 1e-6))) @ inputs.T
        move = np.linalg.solve(curve + 1e-3 * np.eye(2), inputs @ (weight * (chance - toxic)) + 1e-3 * (at - [1.0, 0.0]))
        at = at - move
        if np.abs(move).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fitted(texts: list[np.ndarray], toxic: np.ndarray, prior: float, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(bucket, ratio, weight times ratio) and intercept, on a scale where scores are shares of toxic texts."""
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    ratio, scaled, bias = learn(texts, toxic, settings)
    if not ratio.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0), float(np.log(prior / (1 - prior)))
    fold = np.arange(len(texts)) % settings.folds
    margin = np.zeros(len(texts))
    for k in range(settings.folds):
        apart = np.flatnonzero(fold == k)
        rest = np.flatnonzero(fold != k)
        margin[apart] = margins([texts[i] for i in apart], *learn([texts[i] for i in rest], toxic[rest], settings))
    slope, shift = calibrated(margin, toxic, prior)
    held = np.flatnonzero((ratio != 0) & (scaled != 0))
    return held, ratio[held], slope * scaled[held], slope * bias + shift


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()
) -> Model:
    """Learn from the labelled rows whose crc32(id) mod 5 is not 0.

    The sample takes the rows of the smallest id hash, at most ``per_class`` of either label; its ids
    are broadcast, which ``per_class`` bounds. A null label or id teaches nothing. The share of toxic
    rows is counted over all labels.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (id_bucket(id_col, 5) != 0))
    usable = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = by_hash(usable, settings.per_class, "toxic", F.xxhash64("id"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("key"), "toxic", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sorted(row for part in rows(batches) for row in zip(*part, strict=True))
        held, ratio, scaled, bias = fitted(sampled([t for _, _, t in every], settings), np.array([y for _, y, _ in every]), prior, settings)
        bucket = np.concatenate(([-1], held)).astype(np.int64)
        values = (np.concatenate(([bias], ratio)), np.concatenate(([0.0], scaled)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, *values)], names=["bucket", "ratio", "scaled"])

    narrow = sample.select("key", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    table = narrow.repartition(1).mapInArrow(fit, "bucket long, ratio double, scaled double").toArrow()
    bucket, ratio, scaled = (table.column(c).to_numpy() for c in ("bucket", "ratio", "scaled"))
    if not len(bucket):  # no task ran: no rows at all
        bucket, ratio, scaled = np.array([-1]), np.array([0.0]), np.array([0.0])
    model = Model(np.zeros(1 << settings.bits, dtype=np.float32), np.zeros(1 << settings.bits, dtype=np.float32), float(ratio[bucket == -1][0]), settings)
    model.ratio[bucket[bucket >= 0]] = ratio[bucket >= 0]
    model.scaled[bucket[bucket >= 0]] = scaled[bucket >= 0]
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    A null or empty text scores as the share of toxic rows in training lets it. A null id counts as
    empty text for ``held_out``. Repeated rows all come out, an empty table gives an empty one, other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.scaled, model.intercept, model.settings))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(*shared.value)
        for batch in batches:
            scores = np.array([judge.score(t) for part in rows(iter([batch.select([2])])) for t in part[0]], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col), (id_bucket(id_col, 5) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return asked.mapInArrow(scored, f"{id_col} {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, all columns as they are, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.scaled, model.intercept, model.settings))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(*shared.value)
        for batch in batches:
            texts = batch.select([text_col])
            yield batch.filter(pa.array([judge.score(t) < threshold for part in rows(iter([texts])) for t in part[0]], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
