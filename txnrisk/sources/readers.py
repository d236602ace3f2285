"""Scans."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk import schemas as S

SILVER_LOOKBACK_DAYS = 31
GOLD_LOOKBACK_DAYS = 7

MODEL_INPUT = (
    "transaction_id", "dt", "transaction_timestamp", "amount", "txn_count_1h", "txn_count_24h",
    "amount_sum_1h", "amount_sum_24h", "distinct_merchants_24h", "amount_zscore_30d",
    "prior_txn_count_30d", "merchant_risk_score", "geo_distance_from_prior_km",
    "implied_speed_kmh", "seconds_since_prior_txn", "fraud_signal_count", "device_change_flag",
    "is_high_velocity", "is_amount_outlier", "is_impossible_travel", "channel", "is_fraud",
)


def _or_empty(spark: SparkSession, path: str, schema: T.StructType, load) -> DataFrame:
    """``load()``, or no rows when nothing was ever written under ``path``. Any other failure
    (permissions, corruption) still raises."""
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def raw_json(spark: SparkSession, path: str, arrival_day: date | None = None) -> DataFrame:
    """Landed JSON lines (gzip or plain), every field a string.

    The fixed schema saves the inference pass over the data and yields NULL for fields a
    producer does not send. Lines that are not JSON become rows of NULLs, which validation
    then quarantines. With ``arrival_day`` only that folder is listed.
    """
    folder = f"{path.rstrip('/')}/ingest_dt={arrival_day}" if arrival_day else path
    read = spark.read.schema(S.RAW).option("mode", "PERMISSIVE")
    return _or_empty(spark, folder, S.RAW, lambda: read.json(folder))


def raw_view(spark: SparkSession, path: str) -> DataFrame:
    """The landing zone as analysts see it: arrival day as a column, ``timestamp`` renamed so it
    need not be quoted."""
    schema = T.StructType([*S.RAW.fields, T.StructField("ingest_dt", T.DateType())])
    frame = _or_empty(spark, path, schema, lambda: spark.read.schema(schema).json(path))
    return frame.withColumnRenamed("timestamp", "txn_timestamp")


def recent(table: DataFrame, as_of: date, days: int) -> DataFrame:
    """The partitions of the ``days`` before ``as_of`` and later. The bound is a literal, so
    older partitions are never listed."""
    return table.where(F.col("dt") >= F.lit(as_of - timedelta(days=days)))


def model_input(silver: DataFrame) -> DataFrame:
    """The columns training needs, the event time for a temporal split included."""
    return silver.select(*MODEL_INPUT)


def feedback(spark: SparkSession, path: str) -> DataFrame:
    """Confirmed labels; none yet is an empty table."""
    return _or_empty(
        spark, path, S.FEEDBACK, lambda: spark.read.schema(S.FEEDBACK).json(path)
    )


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Stored rejected rows; none yet is an empty table."""
    schema = T.StructType(
        [
            *S.RAW.fields,
            T.StructField("rejection_reason", T.StringType()),
            T.StructField("rejected_at", T.TimestampType()),
            T.StructField("dt", T.DateType()),
        ]
    )
    return _or_empty(spark, path, schema, lambda: spark.read.schema(schema).parquet(path).select(*schema.fieldNames()))
