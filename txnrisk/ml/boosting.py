"""Boosted trees on binned features; all models of a training grow side by side, level by level.

Features become bytes once, by cuts at quantiles of the training rows, in blocks of rows. A level is one job over the
blocks: per model, node and cut it adds up gradients and curvatures of the rows left of the cut. A row that a model holds
out has no weight in it but a margin, so a fold's scores come out of the training itself.

Margins follow from the trees. A Python worker keeps those of the blocks it saw and applies the trees it missed; a worker
that has none applies all. Nothing is written from tree to tree.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.ml.features import NAMES, VECTOR
from txnrisk.sources import scratch

# --- fixed values -----------------------------------------------------------------------
BINS = 64
BLOCK = 50_000  # rows
OLD = 20  # rounds after which trees are shared once for all later jobs
PER_BYTE = 6  # features of a single cut that share a column of codes
RATE = 0.05
SHRINK = 1.0  # added to the curvature of a leaf
LEAST = 1.0  # curvature on either side of a cut
# ----------------------------------------------------------------------------------------

TREE_DDL = "tree INT, feature ARRAY<INT>, cut ARRAY<DOUBLE>, value ARRAY<DOUBLE>"
BLOCK_DDL = "codes BINARY, label BINARY, fold BINARY, weights BINARY"
SCORED_DDL = "model_name STRING, fold INT, score DOUBLE, is_fraud BOOLEAN"


@dataclass(frozen=True)
class Kind:
    """How the trees of a member grow."""

    name: str
    weight: str
    depth: int
    share: float = 1.0
    """Of the rows, drawn anew for every tree."""


def logistic(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


@dataclass(frozen=True)
class Boosted:
    """``trees``: rows of (tree, feature, cut, value). Splits lie in heap order, then the values of the leaves; a row above
    the cut goes right. A node that is no split has an infinite cut."""

    trees: list[tuple]

    def score(self) -> Column:
        held = [(np.array(f), np.array(c), np.array(v)) for _, f, c, v in sorted(self.trees)]

        @F.pandas_udf("double")
        def score(points: pd.Series) -> pd.Series:
            if points.empty:
                return pd.Series([], dtype=float)
            x = np.ascontiguousarray(np.stack(points.to_numpy()).T).ravel()
            rows = np.arange(len(points))
            margin = np.zeros(len(rows))
            for feature, cut, value in held:
                place = np.zeros(len(rows), dtype=np.int64)
                for level in range(len(value).bit_length() - 1):
                    node = place + (1 << level) - 1
                    place = 2 * place + (x[feature[node] * len(rows) + rows] > cut[node])
                margin += value[place]
            return pd.Series(logistic(margin))

        return score(vector_to_array(F.col(VECTOR)))


def cuts_of(rows: DataFrame) -> list[np.ndarray]:
    """Per feature the values at which a tree may cut: quantiles, but for the largest value."""
    at = [i / (BINS - 1) for i in range(BINS)]
    x = rows.select(vector_to_array(VECTOR).alias("x"))
    marks = x.agg(*[F.percentile_approx(F.col("x")[i], at, 10_000) for i in range(len(NAMES))]).first()
    return [np.unique(np.array(mark, dtype=float))[:-1] for mark in marks]


class Codes:
    """Features as bytes, how many cuts lie below the value, and what their sums are taken from: the codes of a feature of
    many cuts, and columns in which some features of one cut are a bit each. ``left`` says which codes of a column lie left
    of each of its cuts."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        code, places = np.arange(BINS), []
        self.many = [f for f, at in enumerate(cuts) if len(at) > 1]
        single = [f for f, at in enumerate(cuts) if len(at) == 1]
        self.shared = [single[at : at + PER_BYTE] for at in range(0, len(single), PER_BYTE)]
        self.columns = [*self.many, *range(len(cuts), len(cuts) + len(self.shared))]
        self.left = [(code[:, None] <= np.arange(len(cuts[f]))).astype(float) for f in self.many]
        self.left += [1.0 - (code[:, None] >> np.arange(len(some)) & 1) for some in self.shared]
        places += [(f, cut) for f in self.many for cut in range(len(cuts[f]))]
        places += [(f, 0) for some in self.shared for f in some]
        self.feature, self.cut = np.array([*places, (0, BINS)]).T  # the last stands for no cut

    def of(self, x: np.ndarray) -> np.ndarray:
        """A row per feature and shared column."""
        plain = np.stack([np.searchsorted(at, x[:, i]) for i, at in enumerate(self.cuts)]).astype("u1")
        bits = [sum(plain[f] << bit for bit, f in enumerate(some)).astype("u1") for some in self.shared]
        return np.stack([*plain, *bits])

    def sums(self, codes: np.ndarray, rows: np.ndarray, node: np.ndarray, weights: tuple, nodes: int) -> np.ndarray:
        """By weight, node and cut the sum left of the cut, and last the sum of the node."""
        parts, start = [], node * BINS
        for column, left in zip(self.columns, self.left, strict=True):
            at = start + codes[column][rows]
            parts.append(np.stack([np.bincount(at, w, nodes * BINS).reshape(nodes, BINS) @ left for w in weights]))
        whole = np.stack([np.bincount(node, w, nodes) for w in weights])
        return np.concatenate([*parts, whole[:, :, None]], axis=2)

    def right(self, codes: np.ndarray, node: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Whether each row lies right of its node's cut."""
        n = codes.shape[1]
        return codes.ravel()[self.feature[chosen][node] * n + np.arange(n)] > self.cut[chosen][node]


@dataclass
class Growing:
    """A model between two jobs: its trees, as (chosen cuts by level, values), and the tree that grows."""

    kind: Kind
    out: int
    """The fold held out, -1 for none."""

    def __post_init__(self):
        self.trees: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.begin()

    def begin(self) -> None:
        self.splits: list[np.ndarray] = []
        self.lighter = None

    def split(self, told: np.ndarray) -> None:
        """One level more, from the sums of all rows in the root, else in the lighter child of every node. The heavier is
        its parent without the lighter."""
        if self.lighter is None:
            full = told
        else:
            parents = np.arange(len(self.lighter))
            full = np.empty((2, 2 * len(parents), told.shape[2]))
            full[:, 2 * parents + self.lighter] = told
            full[:, 2 * parents + 1 - self.lighter] = self.full - told
        whole, left = full[:, :, -1:], full[:, :, :-1]
        right = whole - left
        gain = _worth(left) + _worth(right) - _worth(whole)
        gain[np.minimum(left[1], right[1]) < LEAST] = 0.0
        gain = np.append(gain, np.full((len(gain), 1), 1e-6), axis=1)  # the last is no cut: nothing goes right
        chosen, nodes = gain.argmax(axis=1), np.arange(len(gain))
        below = full[:, nodes, chosen]
        self.full, self.leaves = full, np.stack([below, full[:, :, -1] - below], axis=2).reshape(2, -1)
        self.lighter = (self.leaves[1, 1::2] <= self.leaves[1, ::2]).astype("u1")
        self.splits.append(chosen.astype("i4"))

    def end(self) -> None:
        self.trees.append((self.splits, (-RATE * self.leaves[0] / (self.leaves[1] + SHRINK)).astype("f4")))
        self.begin()

    def table(self, codes: Codes) -> list[tuple]:
        rows = []
        for tree, (splits, value) in enumerate(self.trees):
            chosen = np.concatenate(splits)
            feature, cut = codes.feature[chosen], codes.cut[chosen]
            at = [float(codes.cuts[f][c]) if c < BINS else float("inf") for f, c in zip(feature, cut, strict=True)]
            rows.append((tree, feature.tolist(), at, value.astype(float).tolist()))
        return rows


def _worth(sums: np.ndarray) -> np.ndarray:
    return sums[0] ** 2 / (sums[1] + SHRINK)


class Kept:
    """What a worker keeps of a block for a model: the margins after ``done`` trees, and the nodes of the rows in the next one
    after ``levels`` of its splits."""

    def __init__(self, n: int):
        self.margin, self.node = np.zeros(n, dtype="f4"), np.zeros(n, dtype="u1")
        self.done = self.levels = 0

    def follow(self, codes: Codes, block: np.ndarray, trees: list[tuple], splits: list[np.ndarray]) -> None:
        for whole, value in trees[self.done :]:
            self._down(codes, block, whole)
            self.margin += value[self.node]
            self.node[:] = 0
            self.done, self.levels = self.done + 1, 0
        self._down(codes, block, splits)

    def _down(self, codes: Codes, block: np.ndarray, splits: list[np.ndarray]) -> None:
        for chosen in splits[self.levels :]:
            self.node = (2 * self.node + codes.right(block, self.node, chosen)).astype("u1")
            self.levels += 1


#: By training and block, in a Python worker; those of an earlier training go.
_KEPT: dict[str, dict[int, list[Kept]]] = {}


def _kept(training: str, block: int, models: int, n: int) -> list[Kept]:
    if training not in _KEPT:
        _KEPT.clear()
    blocks = _KEPT.setdefault(training, {})
    if block not in blocks:
        blocks[block] = [Kept(n) for _ in range(models)]
    return blocks[block]


def _blocks(rows: DataFrame, codes: Codes, weights: list[str]) -> DataFrame:
    """Coded rows, many in one, with a number."""

    def block(x: list, rest: dict[str, list]) -> pa.RecordBatch:
        label, fold, *weight = (np.concatenate(rest[name]) for name in ("label", "fold", *weights))
        parts = [np.concatenate(x, axis=1), label.astype("u1"), fold.astype("i2"), np.stack(weight).astype("f4")]
        return pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in parts], names=["codes", "label", "fold", "weights"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, rest, n = [], {name: [] for name in ("label", "fold", *weights)}, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x.append(codes.of(batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))))
            for name, parts in rest.items():
                parts.append(batch.column(name).to_numpy())
            n += batch.num_rows
            if n >= BLOCK:
                yield block(x, rest)
                x, rest, n = [], {name: [] for name in rest}, 0
        if n:
            yield block(x, rest)

    plain = rows.select(vector_to_array(VECTOR).alias("x"), "label", F.col("fold").cast("int").alias("fold"), *weights)
    return plain.mapInArrow(made, BLOCK_DDL).withColumn("block", F.monotonically_increasing_id())


def fit(rows: DataFrame, kinds: list[Kind], folds: int, rounds: int, seed: int) -> tuple[dict[str, Boosted], DataFrame]:
    """A model of all rows for each kind, by name, and the score of every row by a model of the other folds
    (model_name, fold, score, is_fraud). ``rows`` carry ``fold``, 0 to ``folds`` - 1."""
    spark = rows.sparkSession
    codes, weights, training = Codes(cuts_of(rows)), sorted({kind.weight for kind in kinds}), uuid.uuid4().hex
    models = [Growing(kind, out) for kind in kinds for out in (-1, *range(folds))]
    stored = scratch.stage(_blocks(rows, codes, weights), "blocks")
    tasks = max(1, min(spark.sparkContext.defaultParallelism, stored.count()))
    blocks = stored.repartition(tasks).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    coding, shared, shared_upto, many = spark.sparkContext.broadcast(codes), spark.sparkContext.broadcast([[] for _ in models]), 0, len(models)

    def followed(given: tuple, recent: list, growing: list) -> tuple:
        """A block's codes, labels, folds and weights, and its rows' margins and nodes as they are now."""
        held, label, fold, weight, number = given
        label, fold = np.frombuffer(label, "u1"), np.frombuffer(fold, "i2")
        n = len(label)
        held, weight = np.frombuffer(held, "u1").reshape(-1, n), np.frombuffer(weight, "f4").reshape(-1, n)
        kept = _kept(training, number, many, n)
        for one, before, late, splits in zip(kept, shared.value, recent, growing, strict=True):
            one.follow(coding.value, held, before + late, splits)
        return held, label, fold, weight, number, kept

    def level_of(plans: list[tuple], recent: list, growing: list, tree: int):
        def job(given: Iterator[tuple]) -> Iterator[np.ndarray]:
            total = None
            for one in given:
                held, label, fold, weight, number, kept = followed(one, recent, growing)
                draw = np.random.default_rng([seed, number, tree]).random(len(label), dtype="f4")
                parts = []
                for i, kind, out, lighter in plans:
                    node, taken = kept[i].node, fold != out
                    if kind.share < 1:
                        taken &= draw < kind.share
                    if lighter is not None:
                        taken &= lighter[node >> 1] == (node & 1)
                    mine = np.flatnonzero(taken)
                    fraud = logistic(kept[i].margin[mine].astype(float))
                    w = weight[weights.index(kind.weight)][mine]
                    both = w * (fraud - label[mine]), w * fraud * (1 - fraud)
                    nodes = 1 if lighter is None else len(lighter)
                    parts.append(coding.value.sums(held, mine, node[mine].astype(np.int64) >> (lighter is not None), both, nodes).ravel())
                sums = np.concatenate(parts)
                total = sums if total is None else total + sums
            if total is not None:
                yield total.astype("f4")

        return job

    for tree in range(rounds):
        recent = [model.trees[shared_upto:] for model in models]
        for level in range(max(kind.depth for kind in kinds)):
            asked = [model for model in models if level < model.kind.depth]
            plans = [(i, model.kind, model.out, model.lighter) for i, model in enumerate(models) if level < model.kind.depth]
            growing = [list(model.splits) for model in models]
            told = blocks.mapPartitions(level_of(plans, recent, growing, tree)).collect()
            total, at = sum(part.astype(float) for part in told), 0
            for model in asked:
                shape = (2, 1 if model.lighter is None else len(model.lighter), len(codes.feature))
                size = int(np.prod(shape))
                model.split(total[at : at + size].reshape(shape))
                at += size
        for model in models:
            model.end()
        if (tree + 1) % OLD == 0:
            shared, shared_upto = spark.sparkContext.broadcast([list(model.trees) for model in models]), tree + 1
    recent = [model.trees[shared_upto:] for model in models]
    held_out = [(i, model.kind.name, model.out) for i, model in enumerate(models) if model.out >= 0]

    def scored(given: Iterator[tuple]) -> Iterator[tuple]:
        for one in given:
            _, label, fold, _, _, kept = followed(one, recent, [[] for _ in recent])
            for i, name, out in held_out:
                mine = np.flatnonzero(fold == out)
                scores = logistic(kept[i].margin[mine].astype(float))
                yield from ((name, out, score, fraud) for score, fraud in zip(scores.tolist(), (label[mine] == 1).tolist(), strict=True))

    judged = scratch.stage(spark.createDataFrame(blocks.mapPartitions(scored), SCORED_DDL), "fold_scores")
    blocks.unpersist()
    return {model.kind.name: Boosted(model.table(codes)) for model in models if model.out < 0}, judged
