"""Running totals in a global order, without one task seeing all rows.

Rows are dealt by ranges of the order; each range totals its own rows, and the totals of the ranges before
it (one row a range) are its opening balance. This is what a window without PARTITION BY computes, except
that a task holds one range only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.sources import scratch


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str]) -> DataFrame:
    """``df`` with, for every ``totals`` pair (column, new name), the sum of the column over all rows before.

    ``order`` must tell all rows apart; nulls come first. A null adds nothing, the first row has 0. The
    ranges are dealt once and written down, so that both readings see the same ones.
    """
    dealt = scratch.stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    sums = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{name}") for c, name in totals.items()])
    opening = sums.select("_range", *[F.sum(f"_sum_{name}").over(earlier).alias(f"_open_{name}") for name in totals.values()])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("*", *[F.sum(c).over(inside).alias(f"_in_{name}") for c, name in totals.items()]).join(opening, "_range")
    zero = F.lit(0)
    return placed.select(*df.columns, *[(F.coalesce(f"_open_{n}", zero) + F.coalesce(f"_in_{n}", zero)).alias(n) for n in totals.values()])


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the number of rows before each, from 0; ``order`` must tell all rows apart."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, {"_one": name}).drop("_one")
