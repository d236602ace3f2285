"""Table layouts, bounds and enumerations.

Everything two layers must agree on (a validator bound and the quality rule about the same
column, say) is stated here once.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------
AMOUNT_FLOOR = "0.01"
AMOUNT_CEILING = "25000.00"
CHANNELS = ("card_present", "ecommerce", "contactless", "recurring")
RISK_TIERS = ("low", "medium", "high", "unknown")
DEFAULT_CURRENCY = "USD"
APPROVED_CODE = "00"
HIGH_RISK = 0.05
MEDIUM_RISK = 0.02
UNKNOWN_MERCHANT_RISK = 0.02
RISK_PRIOR_WEIGHT = 20
BURST_PER_HOUR = 5
BURST_PER_DAY = 20
OUTLIER_SIGMAS = 3.0
TRAVEL_LIMIT_KMH = 900.0
SAME_SECOND_SPEED_KMH = 99999.0
HOUR = 3_600
DAY = 86_400
MONTH = 30 * DAY
# ----------------------------------------------------------------------------------------

RAW_COLUMNS = (
    "transaction_id",
    "customer_id",
    "merchant_id",
    "mcc",
    "amount",
    "currency",
    "timestamp",
    "lat",
    "lon",
    "device_id",
    "channel",
    "is_fraud",
    "ingest_timestamp",
    "schema_version",
    "anomaly_type",
    "auth_response_code",
)

RAW = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

BRONZE_DDL = """
    transaction_id STRING, customer_id STRING, merchant_id STRING, mcc STRING,
    amount DECIMAL(12,2), currency STRING, transaction_timestamp TIMESTAMP,
    lat DOUBLE, lon DOUBLE, device_id STRING, channel STRING, is_fraud BOOLEAN,
    auth_response_code STRING, ingest_timestamp TIMESTAMP, schema_version INT,
    anomaly_type STRING, dt DATE
"""

MERCHANT_DIM_DDL = """
    merchant_id STRING, merchant_txn_count BIGINT, merchant_fraud_count BIGINT,
    merchant_avg_amount DOUBLE, merchant_risk_score DOUBLE, merchant_risk_tier STRING
"""

FEATURE_DDL = """
    txn_count_1h BIGINT, txn_count_24h BIGINT, amount_sum_1h DOUBLE, amount_sum_24h DOUBLE,
    distinct_merchants_24h BIGINT, amount_mean_30d DOUBLE, amount_stddev_30d DOUBLE,
    prior_txn_count_30d BIGINT, amount_zscore_30d DOUBLE, seconds_since_prior_txn BIGINT,
    geo_distance_from_prior_km DOUBLE, implied_speed_kmh DOUBLE, device_change_flag BOOLEAN
"""

SIGNAL_DDL = """
    is_high_velocity BOOLEAN, is_amount_outlier BOOLEAN, is_impossible_travel BOOLEAN,
    fraud_signal_count INT
"""

DAILY_METRICS_DDL = """
    dt DATE, mcc STRING, channel STRING, transaction_count BIGINT,
    distinct_customer_count BIGINT, distinct_merchant_count BIGINT,
    fraud_transaction_count BIGINT, total_amount_usd DOUBLE, fraud_loss_amount_usd DOUBLE,
    avg_transaction_amount_usd DOUBLE, approved_transaction_count BIGINT,
    total_fraud_signals BIGINT, fraud_rate_pct DOUBLE, approval_rate_pct DOUBLE,
    fraud_loss_rate_pct DOUBLE
"""

MERCHANT_RISK_DDL = """
    merchant_id STRING, mcc STRING, transaction_count BIGINT, fraud_transaction_count BIGINT,
    total_amount_usd DOUBLE, fraud_loss_amount_usd DOUBLE, avg_transaction_amount_usd DOUBLE,
    distinct_customer_count BIGINT, merchant_risk_score DOUBLE, merchant_risk_tier STRING,
    first_seen_date DATE, last_seen_date DATE, fraud_rate_pct DOUBLE
"""

VALUE_DDL = """
    dt DATE, transaction_count BIGINT, total_amount_usd DOUBLE, actual_fraud_count BIGINT,
    actual_fraud_amount_usd DOUBLE, flagged_count BIGINT, caught_fraud_count BIGINT,
    caught_fraud_amount_usd DOUBLE, missed_fraud_count BIGINT, missed_fraud_amount_usd DOUBLE,
    false_alarm_count BIGINT, false_alarm_amount_usd DOUBLE, capture_rate_pct DOUBLE,
    dollar_capture_rate_pct DOUBLE, flag_precision_pct DOUBLE
"""

FEEDBACK_DDL = "transaction_id STRING, confirmed_is_fraud BOOLEAN, confirmed_at STRING"


_TYPES = {
    "STRING": T.StringType(),
    "DOUBLE": T.DoubleType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "DATE": T.DateType(),
    "DECIMAL(12,2)": T.DecimalType(12, 2),
}


def layout(*ddl: str) -> T.StructType:
    """One StructType out of several column lists. (StructType.fromDDL needs a running
    session, which a module constant cannot assume.)"""
    columns = re.findall(r"(\w+) ([A-Z]+(?:\(\d+,\d+\))?)", " ".join(ddl))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])


BRONZE = layout(BRONZE_DDL)
MERCHANT_DIM = layout(MERCHANT_DIM_DDL)
# The dimension's key is already in the fact, so only its measures are added.
SILVER = layout(BRONZE_DDL, FEATURE_DDL, MERCHANT_DIM_DDL.replace("merchant_id STRING,", ""), SIGNAL_DDL)
DAILY_METRICS = layout(DAILY_METRICS_DDL)
MERCHANT_RISK = layout(MERCHANT_RISK_DDL)
VALUE = layout(VALUE_DDL)
FEEDBACK = layout(FEEDBACK_DDL)


def conform(df, target: T.StructType):
    """Project ``df`` onto ``target``: its columns, order and types."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in target.fields])
