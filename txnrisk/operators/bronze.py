"""Raw strings to typed, de-duplicated transactions, with reasoned quarantine."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk import schemas as S
from txnrisk.functions import scalars as X


def with_raw_columns(raw: DataFrame) -> DataFrame:
    """Every expected raw column as a string; those the producer did not send are NULL.
    Columns beyond the expected ones are kept."""
    absent = [F.lit(None).cast("string").alias(c) for c in S.RAW_COLUMNS if c not in raw.columns]
    return raw.select("*", *absent)


def _defects() -> dict[str, Column]:
    amount, lat, lon = (X.number(F.col(c)) for c in ("amount", "lat", "lon"))
    floor, ceiling = float(S.AMOUNT_FLOOR), float(S.AMOUNT_CEILING)
    return {
        "null_transaction_id": X.blank(F.col("transaction_id")),
        "null_customer_id": X.blank(F.col("customer_id")),
        "null_merchant_id": X.blank(F.col("merchant_id")),
        "non_numeric_amount": amount.isNull() & F.col("amount").isNotNull(),
        "missing_amount": F.col("amount").isNull(),
        "amount_out_of_range": ~amount.between(floor, ceiling),
        "unparseable_timestamp": X.instant(F.col("timestamp")).isNull(),
        "lat_out_of_range": ~lat.between(-90, 90),
        "lon_out_of_range": ~lon.between(-180, 180),
        "unknown_channel": ~F.col("channel").isin(*S.CHANNELS),
    }


def _any_defect() -> Column:
    """Whether a row breaks any rule: plain booleans that stay in generated code and stop at
    the first hit, so clean rows never build a list of reasons."""
    return reduce(or_, [F.coalesce(broken, F.lit(False)) for broken in _defects().values()])


def flag_defects(raw: DataFrame) -> DataFrame:
    """Adds ``rejection_reasons``: the name of every rule a row breaks, empty when clean.

    A rule that cannot be decided because its value is NULL is not broken: text in ``lat``
    that is no number is later stored as NULL, and a missing channel is allowed.
    """
    names = [F.when(broken, F.lit(name)) for name, broken in _defects().items()]
    return with_raw_columns(raw).withColumn("rejection_reasons", F.array_compact(F.array(*names)))


def clean_rows(raw: DataFrame, now: datetime | None = None) -> DataFrame:
    """The rows without defects, typed. ``now`` stamps rows that carry no ingest time."""
    moment = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    event_time = X.instant(F.col("timestamp"))
    computed = {
        "currency": F.coalesce("currency", F.lit(S.DEFAULT_CURRENCY)),
        "transaction_timestamp": event_time,
        "ingest_timestamp": F.coalesce(X.instant(F.col("ingest_timestamp")), moment),
        "schema_version": F.coalesce(F.col("schema_version").try_cast("int"), F.lit(1)),
        "dt": F.to_date(event_time),
    }
    typed = []
    for field in S.BRONZE.fields:
        value = computed.get(field.name)
        if value is None:
            value = F.col(field.name).try_cast(field.dataType)
        typed.append(value.alias(field.name))
    return with_raw_columns(raw).where(~_any_defect()).select(*typed)


def rejected_rows(raw: DataFrame, now: datetime | None = None) -> DataFrame:
    """The rows with defects, as they arrived, plus the reasons and a day to file them under:
    the event's, else the arrival's, else today."""
    moment = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    day = F.coalesce(X.instant(F.col("timestamp")), X.instant(F.col("ingest_timestamp")), moment)
    broken = with_raw_columns(raw).where(_any_defect())
    return flag_defects(broken).select(
        "*",
        F.concat_ws(",", "rejection_reasons").alias("rejection_reason"),
        moment.alias("rejected_at"),
        F.to_date(day).alias("dt"),
    )


def split(raw: DataFrame, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean typed rows, rejected rows); each input row is in exactly one of the two."""
    return clean_rows(raw, now), rejected_rows(raw, now)


def keep_latest(df: DataFrame, keys: list[str], *latest_by: str) -> DataFrame:
    """One row per key: the greatest by ``latest_by``, NULLs lowest.

    Rows that tie are settled by a hash of the whole row, so a replay cannot change the
    survivor. Spark turns "rank = 1" into a group limit on both sides of the shuffle, so an id
    delivered a billion times sends one row per task; ``test_plans`` holds it to that.
    """
    newest_first = [F.desc_nulls_last(c) for c in latest_by]
    copies = Window.partitionBy(*keys).orderBy(*newest_first, F.xxhash64(*df.columns).desc())
    return df.withColumn("copy", F.row_number().over(copies)).where("copy = 1").drop("copy")


def deduplicate(transactions: DataFrame) -> DataFrame:
    """Latest delivery per ``transaction_id``."""
    return keep_latest(
        transactions, ["transaction_id"], "ingest_timestamp", "transaction_timestamp"
    )


def bronze(raw: DataFrame, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """raw -> (bronze, quarantine)."""
    clean, rejected = split(raw, now)
    return deduplicate(clean), rejected
