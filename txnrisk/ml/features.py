"""Model input from silver rows: row-local expressions, so training and serving cannot differ."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk import schemas as S

# --- fixed values -----------------------------------------------------------------------
NUMERIC = (
    "amount",
    "txn_count_1h",
    "txn_count_24h",
    "amount_sum_1h",
    "amount_sum_24h",
    "distinct_merchants_24h",
    "amount_zscore_30d",
    "prior_txn_count_30d",
    "merchant_risk_score",
    "geo_distance_from_prior_km",
    "implied_speed_kmh",
    "seconds_since_prior_txn",
    "fraud_signal_count",
)
FLAGS = ("device_change_flag", "is_high_velocity", "is_amount_outlier", "is_impossible_travel")
CEILINGS = {"implied_speed_kmh": 100_000.0, "seconds_since_prior_txn": float(S.MONTH)}
# ----------------------------------------------------------------------------------------

VECTOR = "features"


def columns(available: list[str]) -> dict[str, Column]:
    """The 34 features by name. Each number gives two: its value, 0 where NULL, and a flag for NULL.
    A column that ``available`` does not list is NULL on every row."""
    out: dict[str, Column] = {}
    for name in NUMERIC:
        value = F.col(name).cast("double") if name in available else F.lit(None).cast("double")
        filled = F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))
        out[f"{name}_missing"] = (value.isNull() | F.isnan(value)).cast("double")
        out[name] = F.least(filled, F.lit(CEILINGS[name])) if name in CEILINGS else filled
    for name in FLAGS:
        flag = F.col(name) if name in available else F.lit(False)
        out[name] = F.coalesce(flag.cast("double"), F.lit(0.0))
    for channel in S.CHANNELS:
        same = F.col("channel") == channel if "channel" in available else F.lit(False)
        out[f"channel_{channel}"] = F.coalesce(same, F.lit(False)).cast("double")
    return out


NAMES = tuple(
    [n for name in NUMERIC for n in (f"{name}_missing", name)]
    + list(FLAGS)
    + [f"channel_{c}" for c in S.CHANNELS]
)


def label(available: list[str]) -> Column:
    given = F.col("is_fraud") if "is_fraud" in available else F.lit(False)
    return F.coalesce(given, F.lit(False)).cast("double")


def matrix(silver: DataFrame) -> DataFrame:
    """``transaction_id``, the 34 features as columns, and ``label``."""
    made = [c.alias(name) for name, c in columns(silver.columns).items()]
    return silver.select("transaction_id", *made, label(silver.columns).alias("label"))


def vectors(silver: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``label`` and the features as one vector."""
    made = [c.alias(f"f_{name}") for name, c in columns(silver.columns).items()]
    wide = silver.select(*keep, label(silver.columns).alias("label"), *made)
    assembled = VectorAssembler(inputCols=[f"f_{n}" for n in NAMES], outputCol=VECTOR).transform(wide)
    return assembled.select(*keep, "label", VECTOR)
