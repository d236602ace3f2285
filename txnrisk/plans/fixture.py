"""Raw card transactions derived, row for row, from the ``events`` table.

The mapping injects every kind of defect, re-deliveries, bursts and far-away purchases. The
same text runs on any engine that has ``strftime``-like formatting; see ``raw_sql_duckdb``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnrisk import schemas as S

_RAW = """
WITH e AS (
  SELECT event_id, ts, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CASE WHEN event_id % 1000 < 6 THEN CAST(floor(event_id / 1000) AS BIGINT) % 10 ELSE user_id END AS cust,
         (event_id * 7919) % 500 AS m
  FROM {events}),
r AS (
  SELECT event_id,
    CASE WHEN event_id % 101 = 0 THEN NULL ELSE concat('T', CAST(event_id AS {text})) END AS transaction_id,
    CASE WHEN event_id % 103 = 0 THEN '  ' ELSE concat('CUST', CAST(cust AS {text})) END AS customer_id,
    CASE WHEN event_id % 131 = 0 THEN 'MER999999' ELSE concat('MER', CAST(m AS {text})) END AS merchant_id,
    CASE m % 6 WHEN 0 THEN '5411' WHEN 1 THEN '5812' WHEN 2 THEN '5541' WHEN 3 THEN '5732' WHEN 4 THEN '5944' ELSE '7995' END AS mcc,
    CASE WHEN event_id % 107 = 0 THEN 'N/A'
         WHEN event_id % 109 = 0 THEN concat('-', CAST(CAST(value AS DECIMAL(12,2)) AS {text}))
         WHEN event_id % 139 = 0 THEN NULL
         ELSE CAST(CAST(value AS DECIMAL(12,2)) AS {text}) END AS amount,
    CASE WHEN event_id % 149 = 0 THEN NULL ELSE 'USD' END AS currency,
    CASE WHEN event_id % 113 = 0 THEN 'not-a-timestamp' ELSE {stamp} END AS timestamp,
    CASE WHEN event_id % 127 = 0 THEN '181.5' WHEN event_id % 211 = 0 THEN '55.7558' ELSE CAST(CAST(30 + cust % 16 AS INT) AS {text}) END AS lat,
    CASE WHEN event_id % 127 = 0 THEN '-420.0' WHEN event_id % 211 = 0 THEN '37.6173' ELSE CAST(CAST(-120 + 2 * (cust % 16) AS INT) AS {text}) END AS lon,
    CASE WHEN event_id % 29 = 0 THEN concat('DEVX', CAST(event_id AS {text})) ELSE concat('DEV', CAST(cust AS {text})) END AS device_id,
    CASE WHEN event_id % 137 = 0 THEN 'carrier_pigeon' WHEN event_type IN ('view','error') THEN 'card_present' WHEN event_type = 'click' THEN 'ecommerce' WHEN event_type = 'purchase' THEN 'contactless' ELSE 'recurring' END AS channel,
    CASE WHEN event_id % 211 = 0 OR event_id % 1000 < 6 OR m % 100 = 0 THEN 'true' ELSE 'false' END AS is_fraud,
    {stamp} AS ingest_timestamp,
    {stamp5} AS redelivered_at,
    CASE WHEN event_id % 2 = 0 THEN '1' ELSE '2' END AS schema_version,
    CASE WHEN event_id % 1000 < 6 THEN 'velocity' WHEN event_id % 211 = 0 THEN 'impossible_geo' END AS anomaly_type,
    CASE WHEN event_id % 2 = 0 THEN NULL WHEN k < 92 THEN '00' ELSE '05' END AS auth_response_code
  FROM e)
"""

_COLUMNS = ", ".join(S.RAW_COLUMNS)
_REDELIVERED = _COLUMNS.replace("ingest_timestamp", "redelivered_at")

_UNION = f"""
SELECT {_COLUMNS} FROM r
UNION ALL
SELECT {_REDELIVERED} FROM r WHERE event_id % 50 = 7
"""

# One scan instead of two. As generated rows they also keep later filters from being rewritten
# in terms of the event columns, the way a filter on landed JSON could not be either.
_FIRST = ", ".join(f"'{c}', {c}" for c in S.RAW_COLUMNS)
_SECOND = _FIRST.replace(", ingest_timestamp,", ", redelivered_at,")
_GENERATE = f"""
SELECT inline(CASE WHEN event_id % 50 = 7
                   THEN array(named_struct({_FIRST}), named_struct({_SECOND}))
                   ELSE array(named_struct({_FIRST})) END)
FROM r
"""


def raw_sql_duckdb() -> str:
    form = "'%Y-%m-%dT%H:%M:%S.%g+00:00'"
    return (_RAW + _UNION).format(
        events="events",
        text="VARCHAR",
        stamp=f"strftime(ts, {form})",
        stamp5=f"strftime(ts + INTERVAL '5' MINUTE, {form})",
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "\"yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'\""
    text = (_RAW + _GENERATE).format(
        events="parquet.`" + sf_dir.rstrip("/") + "/events.parquet`",
        text="STRING",
        stamp=f"date_format(ts, {form})",
        stamp5=f"date_format(ts + INTERVAL '5' MINUTE, {form})",
    )
    return spark.sql(text)
