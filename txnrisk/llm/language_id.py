"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained row by row with follow-the-regularised-leader and an elastic-net penalty, which leaves most
weights at zero; a temperature fitted on rows apart from these calibrates the probabilities.
Document frequencies count every document one may learn from; the regression learns from a bounded
sample of labelled rows, whose size is a parameter. A term's frequency is its share of the text's
n-grams, so a text's score is the mean, over its n-grams, of idf times weight.
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

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16  # n-grams share 2**bits buckets
    per_language: int = 1500  # labelled rows of a language that the regression learns from, at most
    scale: float = 30.0  # of the feature vectors, so that steps are of the order of one
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    epochs: int = 4
    calibration: int = 5  # one sampled row in so many fits the temperature instead


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # idf times weight, a row per bucket
    bias: np.ndarray
    temperature: float
    settings: Settings

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language, the first by name among equals, and its calibrated probability."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        found = grams(text, self.settings.orders, self.settings.bits)
        logits = (self.bias + self.settings.scale * self.table[found].mean(axis=0, dtype=np.float64)) / self.temperature
        chance = np.exp(logits - logits.max())
        best = int(np.argmax(chance))
        return self.languages[best], float(chance[best] / chance.sum())


class Ftrl:
    """Follow the regularised leader, proximal form, one row of coordinates per bucket."""

    def __init__(self, size: int, classes: int, settings: Settings):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.s = settings

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pull = np.maximum(np.abs(z) - self.s.l1, 0)
        return -np.sign(z) * pull / ((self.s.beta + np.sqrt(n)) / self.s.alpha + self.s.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, answer: int) -> None:
        w = self.weights(at)
        logits = x @ w
        chance = np.exp(logits - logits.max())
        chance /= chance.sum()
        chance[answer] -= 1
        g = x[:, None] * chance
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] += g * g


def temperature(logits: np.ndarray, answers: np.ndarray) -> float:
    """The divisor of the logits at which the answers are likeliest, by golden section on its logarithm."""
    if not len(answers):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        top = x.max(axis=1)
        return float((np.log(np.exp(x - top[:, None]).sum(axis=1)) + top - x[np.arange(len(x)), answers]).mean())

    low, high, cut = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(learnable: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts: every row counts.

    A task adds its own counts up and hands on one row per bucket it met; 2**bits rows come to the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, n, met = np.zeros(1 << settings.bits, dtype=np.int64), 0, np.zeros(1 << settings.bits, dtype=bool)
        for (texts,) in rows(batches):
            for text in texts:
                met[grams(text or "", settings.orders, settings.bits)] = True
                at = np.flatnonzero(met)
                inside[at] += 1
                met[at] = False
                n += 1
        at = np.flatnonzero(inside)
        columns = (np.concatenate(([-1], at)), np.concatenate(([n], inside[at])))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["bucket", "texts"])

    per_task = learnable.select("text").mapInArrow(counted, "bucket long, texts long")
    table = per_task.groupBy("bucket").agg(F.sum("texts").alias("texts")).toArrow()
    bucket, texts = (table.column(c).to_numpy() for c in ("bucket", "texts"))
    out = np.zeros(1 << settings.bits, dtype=np.int64)
    out[bucket[bucket >= 0]] = texts[bucket >= 0]
    return out, int(texts[bucket == -1].sum())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """Learn from the documents with a language whose crc32(id) mod 4 is not 2.

    The sample takes the rows of the smallest id hash, at most ``per_language`` of each language; of
    rows that share an id or a hash, all that the last taken hash lets in. Without such rows the model
    knows no language and calls every text undetermined.
    """
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    learnable = docs.where(F.col(lang_col).isNotNull() & (id_bucket(id_col, 4) != 2)).select(
        key.alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    cut = by_hash(learnable.select("key", "lang").distinct(), settings.per_language, "lang", F.col("key"))
    cuts = cut.groupBy("lang").agg(F.max("key").alias("cut")).collect()  # a row per language
    languages = sorted(r["lang"] for r in cuts)
    frequency, total = document_frequencies(learnable, settings)
    idf = np.log((1 + total) / (1 + frequency)) * (frequency > 0)
    if not languages:
        return Model([], np.zeros((1 << settings.bits, 0), dtype=np.float32), np.zeros(0), 1.0, settings)
    spark = docs.sparkSession
    chosen = learnable.join(F.broadcast(spark.createDataFrame(cuts, "lang string, cut long")), "lang").where("key <= cut").select("key", "lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, langs, texts in rows(batches, 64):
            found = [np.unique(grams(t or "", settings.orders, settings.bits), return_counts=True) for t in texts]
            columns = [[f[i].astype(np.int32).tobytes() for f in found] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(langs, pa.string()), *(pa.array(c, pa.binary()) for c in columns)], names=["key", "lang", "at", "n"]
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sorted(row for part in rows(batches) for row in zip(*part, strict=True))
        number = {name: i for i, name in enumerate(languages)}
        bias_at = 1 << settings.bits
        vectors, answers = [], np.array([number[lang] for _, lang, _, _ in every])
        for _, _, at, n in every:
            at, n = np.frombuffer(at, dtype=np.int32), np.frombuffer(n, dtype=np.int32)
            vectors.append((np.append(at, bias_at), np.append(settings.scale * idf[at] * n / max(1, n.sum()), 1.0)))
        order = np.random.default_rng(7).permutation(len(every))
        apart = order[:: settings.calibration] if len(every) >= 5 * settings.calibration else order[:0]
        taught = np.setdiff1d(order, apart)
        leader = Ftrl(bias_at + 1, len(languages), settings)
        for epoch in range(settings.epochs):
            for i in np.random.default_rng(epoch).permutation(taught):
                leader.learn(*vectors[i], answers[i])
        weight = leader.weights(slice(None))
        logits = np.array([x @ weight[at] for at, x in (vectors[i] for i in apart)]).reshape(-1, len(languages))
        warmth = temperature(logits, answers[apart])
        held = np.flatnonzero((weight != 0).any(axis=1))
        table = np.concatenate((np.full((1, len(languages)), warmth), weight[held]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(([-1], held)).astype(np.int64)), pa.array([r.tobytes() for r in table], pa.binary())], names=["bucket", "weights"]
        )

    fitted = chosen.mapInArrow(features, "key long, lang string, at binary, n binary").repartition(1)
    table = fitted.mapInArrow(fit, "bucket long, weights binary").toArrow().to_pydict()
    weight, warmth = np.zeros(((1 << settings.bits) + 1, len(languages))), 1.0
    for bucket, data in zip(table["bucket"], table["weights"], strict=True):
        values = np.frombuffer(data)
        if bucket < 0:
            warmth = float(values[0])
        else:
            weight[bucket] = values
    return Model(languages, (weight[:-1] * idf[:, None]).astype(np.float32), weight[-1], warmth, settings)


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    ``und`` with score 0 for a null text and one without a letter, and for all if nothing was learnt.
    A null id counts as empty text for ``held_out``. Repeated rows all come out, an empty table gives
    an empty one, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature, model.settings))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(*shared.value)
        for batch in batches:
            found = [judge.predict(t) for part in rows(iter([batch.select([2])])) for t in part[0]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[id_col, "held_out", "lang_pred", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col), (id_bucket(id_col, 4) == 2).alias("held_out"), F.col(text_col).alias("text"))
    return asked.mapInArrow(predicted, f"{id_col} {kind}, held_out boolean, lang_pred string, score double")
