"""Isolation forest: small random trees built in parallel, scored a batch at a time.

Only the trees are Python: each is grown from at most 256 rows, one Spark group per tree, and
comes back as a table of nodes. A forest has at most 511 nodes a tree, so it is broadcast whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnrisk.ml.features import VECTOR

# --- fixed values -----------------------------------------------------------------------
ROWS_PER_TREE = 256
EULER_GAMMA = 0.5772156649015329
# ----------------------------------------------------------------------------------------

NODE_DDL = "tree INT, node INT, feature INT, cut DOUBLE, length DOUBLE, rows INT"
SPARE_DRAWS = 1.3


def expected_path(rows: int) -> float:
    """Mean depth at which a random search tree of ``rows`` rows ends a failed search."""
    if rows < 2:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1.0) + EULER_GAMMA) - 2.0 * (rows - 1.0) / rows


def grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int, float, float]]:
    """(node, feature, cut, length) in heap numbering: the root is 1, children 2n and 2n+1.
    A leaf has feature -1 and the path length its rows still stand for."""
    deepest = math.ceil(math.log2(max(len(points), 2)))
    nodes, waiting = [], [(1, points)]
    while waiting:
        node, rows = waiting.pop()
        depth = node.bit_length() - 1
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= deepest or len(rows) < 2 or varying.size == 0:
            nodes.append((node, -1, 0.0, depth + expected_path(len(rows))))
            continue
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        right = rows[:, feature] > cut
        nodes.append((node, feature, cut, 0.0))
        waiting += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
    return nodes


def _samples(train: DataFrame, key: str, trees: int, seed: int, n: int) -> DataFrame:
    """(tree, point): up to 256 distinct rows per tree, chosen by hash, so reruns agree.

    Each row gets ``draws`` chances to land in some tree, together about 1.3 times what the
    trees need; on big tables that is one chance with a tiny probability, which filters the
    scan before anything moves.
    """
    per_row = SPARE_DRAWS * trees * min(ROWS_PER_TREE, n) / n
    draws = max(1, math.ceil(per_row))
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    chance = F.pmod(F.xxhash64(key, "draw", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    taken = (
        train.select(key, VECTOR, draw.alias("draw"))
        .where(chance < per_row / draws)
        .withColumn("tree", F.pmod(F.xxhash64("draw", key, F.lit(seed + 1)), F.lit(trees)).cast("int"))
        .dropDuplicates([key, "tree"])
    )
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64(key, "tree"), key))
    limited = taken.withColumn("place", place).where(F.col("place") <= ROWS_PER_TREE)
    return limited.select("tree", "place", vector_to_array(VECTOR).alias("point"))


@dataclass(frozen=True)
class IsolationForest:
    """``nodes`` as plain rows, ``low`` and ``high`` the raw scores of the training rows that
    map to 0 and 1."""

    nodes: list[tuple]
    low: float = 0.0
    high: float = 1.0

    @classmethod
    def fit(cls, train: DataFrame, key: str, trees: int, seed: int, n: int) -> IsolationForest:
        def build(group: pd.DataFrame) -> pd.DataFrame:
            tree = int(group["tree"].iloc[0])
            ordered = group.sort_values("place")
            points = np.stack(ordered["point"].to_numpy())
            grown = grow(points, np.random.default_rng([seed, tree]))
            out = pd.DataFrame(grown, columns=["node", "feature", "cut", "length"])
            return out.assign(tree=tree, rows=len(points))[["tree", "node", "feature", "cut", "length", "rows"]]

        samples = _samples(train, key, trees, seed, n)
        table = samples.groupBy("tree").applyInPandas(build, NODE_DDL)
        raw = cls([tuple(row) for row in table.collect()])  # at most 511 rows a tree
        bounds = train.select(raw.raw_score(train.sparkSession).alias("s")).agg(F.min("s"), F.max("s")).first()
        return cls(raw.nodes, float(bounds[0]), float(bounds[1]))

    def raw_score(self, spark: SparkSession) -> Column:
        """Higher is easier to isolate, between 0 and 1."""
        frame = pd.DataFrame(self.nodes, columns=["tree", "node", "feature", "cut", "length", "rows"])
        trees = []
        for _, one in frame.groupby("tree"):
            width = int(one["node"].max()) + 1
            feature, cut, length = np.full(width, -1), np.zeros(width), np.zeros(width)
            at = one["node"].to_numpy()
            feature[at], cut[at], length[at] = one["feature"], one["cut"], one["length"]
            trees.append((feature, cut, length, expected_path(int(one["rows"].iloc[0]))))
        shared = spark.sparkContext.broadcast(trees)

        @F.pandas_udf("double")
        def score(points: pd.Series) -> pd.Series:
            if points.empty:
                return pd.Series([], dtype=float)
            x = np.stack(points.to_numpy())
            rows = np.arange(len(x))
            share = np.zeros(len(x))
            for feature, cut, length, usual in shared.value:
                node = np.ones(len(x), dtype=np.int64)
                for _ in range(len(feature).bit_length()):
                    f = feature[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    child = 2 * node + (x[rows, np.maximum(f, 0)] > cut[node])
                    node = np.where(inner, child, node)
                share += length[node] / max(usual, 1e-9)
            return pd.Series(np.exp2(-share / len(shared.value)))

        return score(vector_to_array(F.col(VECTOR)))

    def score(self, spark: SparkSession) -> Column:
        span = max(self.high - self.low, 1e-9)
        scaled = (self.raw_score(spark) - F.lit(self.low)) / F.lit(span)
        return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
