"""Raw zone into bronze and quarantine, file by file as they land."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from txnrisk import schemas as S
from txnrisk.operators import bronze as B
from txnrisk.sources import writers
from txnrisk.streaming.triggers import trigger

# --- fixed value: at most one run a quarter of an hour ------------------------------------
EVERY = "15 minutes"
# ----------------------------------------------------------------------------------------


def start(
    spark: SparkSession,
    raw_path: str,
    bronze_path: str,
    quarantine_path: str,
    checkpoint: str,
    now: datetime | None = None,
    once: bool = False,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """The checkpoint hands over each file once. A micro-batch may still be retried, so both
    writes are repeatable: bronze is an upsert that never goes back to an older delivery, and a
    batch's rejects replace those of its earlier attempt.

    On plain Parquet an upsert rewrites bronze, which suits modest tables; on a format with
    MERGE the same frame is merged.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        # Both sinks need the rows; held on disk so that the files are parsed once.
        batch.persist()
        try:
            clean, rejected = B.split(batch, now)
            rejected.drop("rejection_reasons").write.mode("overwrite").partitionBy("dt").parquet(
                f"{quarantine_path.rstrip('/')}/batch={batch_id}"
            )
            writers.upsert_table(B.deduplicate(clean), bronze_path, ["transaction_id"], newer_by="ingest_timestamp")
        finally:
            batch.unpersist()

    raw = spark.readStream.schema(S.RAW).option("maxFilesPerTrigger", files_per_batch).json(raw_path)
    # Arrival folders are found by listing; their day is not part of a transaction.
    return (
        raw.select(*S.RAW_COLUMNS)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(once, EVERY))
        .start()
    )
