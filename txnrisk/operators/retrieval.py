"""Passages and nearest vectors as batch jobs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions import scalars as X

CHUNK_TOKENS = 300
OVERLAP_PCT = 20
TOP_K = 5
WHITESPACE = r"[ \t\n\x0B\f\r]+"
BLOCK = 512  # vectors a block: small enough for many pairs of blocks in an Arrow batch
SLACK = 1e-9  # more than a matrix product's rounding


def chunk(
    documents: DataFrame,
    text: str = "text",
    tokens: int = CHUNK_TOKENS,
    overlap_pct: int = OVERLAP_PCT,
) -> DataFrame:
    """Overlapping windows of whitespace-separated tokens: ``chunk_no``, ``chunk``, ``n_tokens``.
    The last window is the one that reaches the end; a text without tokens has none."""
    step = tokens - tokens * overlap_pct // 100
    words = F.filter(F.split(F.col(text), WHITESPACE), lambda w: w != "")
    length = F.size("words")
    last_start = F.greatest(F.ceil((length - tokens) / step), F.lit(0)) * step
    starts = F.sequence(F.lit(0), last_start.cast("int"), F.lit(step))
    others = [c for c in documents.columns if c != text]
    return (
        documents.withColumn("words", words)
        .where(length > 0)
        .select(*others, "words", F.posexplode(starts).alias("chunk_no", "start"))
        .withColumn("piece", F.slice("words", F.col("start") + 1, F.lit(tokens)))
        .select(*others, "chunk_no", F.array_join("piece", " ").alias("chunk"), F.size("piece").alias("n_tokens"))
    )


def _blocks(df: DataFrame, id_col: str, size: int, side: str) -> DataFrame:
    """Rows of at most ``size`` vectors: their ids, their number of dimensions and all their values in a row.

    A block holds vectors of one length; missing vectors, or vectors with a missing value, have length 0.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, values = held.pop(dim)
            columns = [pa.array([ids], schema.field(0).type), pa.array([dim], pa.int32()), pa.array([np.concatenate(values)], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([(f"{side}ids", pa.list_(batch.schema.field(0).type)), (f"{side}dim", pa.int32()), (f"{side}values", pa.list_(pa.float64()))])
            for name, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vector = vector if vector is not None and None not in vector else []
                ids, values = held.setdefault(len(vector), ([], []))
                ids.append(name)
                values.append(np.array(vector, dtype=np.float64))
                if len(ids) == size:
                    yield out(len(vector))
        for dim in list(held):
            yield out(dim)

    vectors = df.select(F.col(id_col), F.col("vector").cast("array<double>"))
    return vectors.mapInArrow(gather, f"{side}ids array<{kind}>, {side}dim int, {side}values array<double>")


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with those of ``b``, each added up in the order of the dimensions."""
    dot, one, other = (np.zeros(len(a)) for _ in range(3))
    for x, y in zip(a.T, b.T, strict=True):
        dot, one, other = dot + x * y, one + x * x, other + y * y
    size = np.sqrt(one) * np.sqrt(other)
    return np.divide(dot, size, out=np.full(len(a), np.nan), where=size > 0)


def nearest_in_block(questions: np.ndarray, corpus: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, score) of the ``k`` rows of ``corpus`` closest to each question; ties by ``place``.

    One matrix product finds which rows can be among them; only those are scored again, in a fixed order
    of additions, so that equal vectors have equal scores wherever they stand. No score (NaN) comes last.
    """
    if questions.shape[1] == corpus.shape[1] > 0:
        unit = [np.divide(m, n, out=np.zeros_like(m), where=n > 0) for m in (questions, corpus) for n in [np.linalg.norm(m, axis=1, keepdims=True)]]
        rough = unit[0] @ unit[1].T
        rough[:, ~unit[1].any(axis=1)] = -2.0
        least = np.partition(rough, -k, axis=1)[:, [-k]] if k < len(corpus) else np.full((len(questions), 1), -3.0)
        asked, row = np.nonzero(rough >= least - SLACK)
        score = _cosine(questions[asked], corpus[row])
    else:
        asked, row = (x.ravel() for x in np.indices((len(questions), len(corpus))))
        score = np.full(len(asked), np.nan)
    order = np.lexsort((place[row], -np.nan_to_num(score, nan=-2.0), asked))
    asked, row, score = asked[order], row[order], score[order]
    first = np.searchsorted(asked, asked, "left")
    kept = np.arange(len(asked)) - first < k
    return asked[kept], row[kept], score[kept]


def top_k_cosine(
    queries: DataFrame, corpus: DataFrame, k: int = TOP_K, query_id: str = "query_id", item_id: str = "item_id", block: int = BLOCK
) -> DataFrame:
    """The ``k`` corpus rows closest to each query: ``query_id, rank, item_id, score``.

    ``queries`` and ``corpus`` hold an id and ``vector``. Both come in blocks of ``block`` vectors, and every
    block of questions meets every block of the corpus as one matrix product that leaves ``k`` rows a
    question; those are merged by a top-k, cut to ``k`` per task before the shuffle. Any number of questions
    is asked in one pass: neither side is counted, collected or exploded. A tie goes to the smaller id. Vectors
    of unlike lengths, empty ones and zeros have no score and come last.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, query_id), (corpus, item_id))]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a_ids, a_dim, a), (b_ids, b_dim, b) = ([batch.column(c)[i] for c in cs] for cs in ((0, 1, 2), (3, 4, 5)))
                a_ids, b_ids = a_ids.values, b_ids.values
                place = np.empty(len(b_ids), dtype=np.int64)
                place[pc.sort_indices(b_ids).to_numpy()] = np.arange(len(b_ids))
                one, other = (v.values.to_numpy().reshape(len(ids), d.as_py()) for v, ids, d in ((a, a_ids, a_dim), (b, b_ids, b_dim)))
                asked, row, score = nearest_in_block(one, other, place, k)
                columns = [a_ids.take(pa.array(asked)), b_ids.take(pa.array(row)), pa.array(score, mask=np.isnan(score))]
                yield pa.RecordBatch.from_arrays(columns, names=["asked", "found", "exact"])

    # a grid with a cell per core: a block of questions goes to the cells of its row, one of the corpus to its column's
    side = math.isqrt(max(0, queries.sparkSession.sparkContext.defaultParallelism - 1)) + 1
    line = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    own_row, own_column = (F.pmod(F.xxhash64(f"{x}ids", f"{x}dim"), F.lit(side)).cast("int") for x in "ab")
    asked = _blocks(queries, query_id, block, "a").withColumn("x", own_row).withColumn("y", line)
    rows = _blocks(corpus, item_id, block, "b").withColumn("y", own_column).withColumn("x", line)
    pairs = asked.join(rows, ["x", "y"]).select("aids", "adim", "avalues", "bids", "bdim", "bvalues")
    scored = pairs.mapInArrow(product, f"asked {kinds[0]}, found {kinds[1]}, exact double")
    order = Window.partitionBy("asked").orderBy(F.desc("exact"), "found")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("asked").alias(query_id), "rank", F.col("found").alias(item_id), X.rounded(F.col("exact"), 4).alias("score"))


def citations(ranked: DataFrame, document: str, score: str = "score", rank: str = "rank") -> DataFrame:
    """Adds ``citation``, the numbered marker an answer can quote."""
    marker = F.format_string("[%d] source: %s (relevance %s)", F.col(rank), F.col(document), F.col(score).cast("string"))
    return ranked.withColumn("citation", marker)
