"""When a query takes its next micro-batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: one run per partition and quarter of an hour ---------------------------
BUCKET = "15 minutes"
LATENESS = "1 day"
# ----------------------------------------------------------------------------------------

_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def trigger(once: bool, every: str) -> dict:
    """``once`` drains what is there and stops."""
    return {"availableNow": True} if once else {"processingTime": every}


@contextmanager
def draining(spark: SparkSession) -> Iterator[None]:
    """Start queries with processing-time timeouts in here to drain them. Such a query always
    has a reason for another empty batch (some state may expire), so "all available" would
    never be reached."""
    before = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        yield
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)


def wanted_runs(arrivals: DataFrame, partition: Column, arrived: Column, bucket: str = BUCKET, lateness: str = LATENESS) -> DataFrame:
    """(``partition``, ``bucket``) once for all arrivals of a stream in that partition and stretch of time:
    the runs to start, however often a file is announced.

    State holds one key per run until ``lateness`` behind the newest bucket. An arrival later than that is
    dropped and starts nothing; so does one without a time. A NULL partition is a partition.
    """
    placed = arrivals.select(partition.alias("partition"), F.window(arrived, bucket)["start"].alias("bucket"))
    timed = placed.where("bucket IS NOT NULL").withWatermark("bucket", lateness)
    return timed.dropDuplicatesWithinWatermark(["partition", "bucket"])
