"""Small helpers the operators share."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.sources import scratch


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    return scratch.stage(df, f"llm-{name}")


def id_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def by_hash(df: DataFrame, per_class: int, label: str, key: Column) -> DataFrame:
    """At most ``per_class`` rows of each label, those of the smallest hash: the same at any layout."""
    from pyspark.sql import Window

    order = Window.partitionBy(label).orderBy(key, *[c for c in df.columns if c != label])
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class).drop("_n")


def rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[list[list]]:
    """Columns of at most ``size`` rows at a time as Python lists."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield [column.to_pylist() for column in part.columns]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


# --- neighbours in a global order -------------------------------------------------------------


ROUNDS = 32  # ranges per core of the cluster at most


class Ranges:
    """Consecutive ranges of a sort key, with the keys at their ends.

    Only the ends, two keys per range, come to the driver. There are as many ranges as tasks of the wanted
    size need, but no more than a number of rounds of the cluster's cores: the driver's part grows with the
    cluster, not with the data. A range is sorted on disk and read once, so it may be larger than memory.
    """

    def __init__(self, ends: list[tuple[tuple, tuple]]):
        self.first = [lo for lo, _ in ends]
        self.last = [hi for _, hi in ends]

    @classmethod
    def of(cls, keys: DataFrame, columns: list[str], n: int) -> Ranges:
        """``columns`` must hold no nulls; they are compared as Spark sorts them, ascending."""
        key = F.struct(*columns)
        n = max(1, min(n, ROUNDS * keys.sparkSession.sparkContext.defaultParallelism))
        ends = (
            keys.select(*columns)
            .repartitionByRange(n, *columns)
            .groupBy(F.spark_partition_id())
            .agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
            .collect()
        )
        return cls(sorted((comparable(r["lo"]), comparable(r["hi"])) for r in ends))

    def __len__(self) -> int:
        return len(self.first)

    def range_of(self, key: tuple) -> int:
        return bisect.bisect_left(self.last, key)


def comparable(key) -> tuple:
    """Spark compares strings by their UTF-8 bytes."""
    return tuple(v.encode("utf-8") if isinstance(v, str) else v for v in key)


def spread(df: DataFrame, columns: list[str], ranges: Ranges) -> DataFrame:
    """``df`` dealt by range and sorted by ``columns`` within it, with ``range`` and ``halo``.

    Every range also gets copies of the row before its first (halo -1, sorted first) and of the row
    after its last (halo 1, sorted last); the row after the very last is the very first, and the
    other way round.
    """
    n = len(ranges)
    # an end key -> the ranges that see it from outside
    outside: dict[tuple, list[tuple[int, int]]] = {}
    for i in range(n):
        outside.setdefault(ranges.first[i], []).append(((i - 1) % n, 1))
        outside.setdefault(ranges.last[i], []).append(((i + 1) % n, -1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            rows_at, to, halo = [], [], []
            for row, key in enumerate(comparable(k) for k in keys):
                places = [(ranges.range_of(key), 0), *outside.get(key, ())]
                for place, side in places:
                    rows_at.append(row)
                    to.append(place)
                    halo.append(side)
            taken = batch.take(pa.array(rows_at, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(to, pa.int32()), pa.array(halo, pa.int32())], names=[*batch.schema.names, "range", "halo"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    dealt = df.mapInArrow(deal, f"{fields}, range int, halo int")
    return dealt.repartition(max(1, n), "range").sortWithinPartitions("range", "halo", *columns)
