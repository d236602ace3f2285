"""Declarative data-quality rules, evaluated for a whole layer in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk import schemas as S
from txnrisk.operators.monitor import STALE_AFTER_HOURS



@dataclass(frozen=True)
class Rule:
    """``measure`` gives one number for the table: an aggregate, or a scalar subquery. The rule
    passes when ``accept`` holds for it."""

    name: str
    measure: Callable[[DataFrame], Column]
    accept: Callable[[Column], Column]
    reason: str


def _none(name: str, bad: Column, what: str) -> Rule:
    return Rule(name, lambda _: F.count_if(bad), lambda v: v == 0, f"rows with {what}")


def _subquery(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


def is_complete(column: str) -> Rule:
    return _none(f"IsComplete {column}", F.col(column).isNull(), f"no {column}")


def completeness(column: str, above: float) -> Rule:
    share = F.try_divide(F.count(column), F.count("*").cast("double"))
    return Rule(
        f"Completeness {column} > {above}",
        lambda _: F.coalesce(share, F.lit(0.0)),
        lambda v: v > above,
        f"share of rows with {column}",
    )


def unique_grain(*columns: str) -> Rule:
    """No two rows share these values. A grouped count, so no set of keys is ever held in one
    place. Rows where a value is NULL do count."""

    def repeated(df: DataFrame) -> Column:
        return _subquery(df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1"))

    return Rule(f"IsUnique {','.join(columns)}", repeated, lambda v: v == 0, "repeated keys")


def satisfies(name: str, test: Column, null_passes: bool = False) -> Rule:
    """Every row meets ``test``. An undecided test fails unless ``null_passes``."""
    return _none(f"ColumnValues {name}", ~F.coalesce(test, F.lit(null_passes)), f"{name} violated")


def between(
    column: str, low: float, high: float, inclusive: bool = False, null_passes: bool = False
) -> Rule:
    value = F.col(column)
    test = value.between(low, high) if inclusive else (value > low) & (value < high)
    ends = "inclusive" if inclusive else "exclusive"
    return satisfies(f"{column} between {low} and {high} {ends}", test, null_passes)


def one_of(column: str, allowed: tuple[str, ...], null_passes: bool = False) -> Rule:
    return satisfies(f"{column} in {','.join(allowed)}", F.col(column).isin(*allowed), null_passes)


def at_least(column: str, low: float) -> Rule:
    return satisfies(f"{column} >= {low}", F.col(column) >= low)


def more_than(column: str, low: float) -> Rule:
    return satisfies(f"{column} > {low}", F.col(column) > low)


def never(name: str, bad: Column) -> Rule:
    """No row meets ``bad``; an undecided row is fine."""
    return _none(f"Never {name}", bad, name)


def has_rows() -> Rule:
    return Rule("RowCount > 0", lambda _: F.count("*"), lambda v: v > 0, "rows")


def fresh(column: str, as_of: datetime, hours: int = STALE_AFTER_HOURS) -> Rule:
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return Rule(
        f"Fresh {column} within {hours}h",
        lambda _: F.count_if(F.col(column) > limit),
        lambda v: v > 0,
        "recent rows",
    )


def refers_to(column: str, parent: DataFrame) -> Rule:
    """Each value exists in ``parent``. An anti join: rows without a match are counted where
    they are."""

    def orphans(df: DataFrame) -> Column:
        return _subquery(df.select(column).join(parent.select(column), column, "left_anti"))

    return Rule(f"References {column}", orphans, lambda v: v == 0, "rows without parent")


def bronze_rules(as_of: datetime, merchant_dim: DataFrame | None = None) -> list[Rule]:
    """Structure. The first run has no dimension yet and skips the reference check. Bounds and
    NULL handling are the validator's: both ends legal, position and channel optional."""
    rules = [refers_to("merchant_id", merchant_dim)] if merchant_dim is not None else []
    return rules + [
        is_complete("transaction_id"),
        is_complete("customer_id"),
        is_complete("merchant_id"),
        unique_grain("transaction_id"),
        is_complete("transaction_timestamp"),
        is_complete("amount"),
        between("amount", float(S.AMOUNT_FLOOR), float(S.AMOUNT_CEILING), inclusive=True),
        one_of("channel", S.CHANNELS, null_passes=True),
        between("lat", -90, 90, inclusive=True, null_passes=True),
        between("lon", -180, 180, inclusive=True, null_passes=True),
        completeness("currency", 0.99),
        fresh("transaction_timestamp", as_of),
        has_rows(),
    ]


def silver_rules() -> list[Rule]:
    """Rules for silver: one row per transaction, features within their ranges."""
    return [
        is_complete("transaction_id"),
        unique_grain("transaction_id"),
        at_least("txn_count_1h", 1),
        at_least("txn_count_24h", 1),
        is_complete("txn_count_1h"),
        is_complete("txn_count_24h"),
        completeness("amount_zscore_30d", 0.30),
        between("merchant_risk_score", -0.001, 1.001),
        is_complete("merchant_risk_score"),
        one_of("merchant_risk_tier", S.RISK_TIERS),
        never("negative distance", F.col("geo_distance_from_prior_km") < 0),
        is_complete("fraud_signal_count"),
        between("fraud_signal_count", -1, 5),
        is_complete("is_high_velocity"),
        has_rows(),
    ]


def gold_rules() -> list[Rule]:
    """Are the published numbers possible?"""
    return [
        is_complete("dt"),
        is_complete("transaction_count"),
        more_than("transaction_count", 0),
        between("fraud_rate_pct", -0.001, 100.001),
        between("approval_rate_pct", -0.001, 100.001),
        at_least("fraud_loss_amount_usd", 0),
        at_least("total_amount_usd", 0),
        unique_grain("dt", "mcc", "channel"),
        has_rows(),
    ]


def evaluate(df: DataFrame, layer: str, rules: list[Rule]) -> DataFrame:
    """(layer, rule, outcome, actual, reason), one row per rule.

    All row-level rules are aggregates of one scan; uniqueness and references are scalar
    subqueries of the same plan.
    """
    measures = [rule.measure(df).cast("double").alias(f"m{i}") for i, rule in enumerate(rules)]
    lines = []
    for i, rule in enumerate(rules):
        value = F.col(f"m{i}")
        passed = F.coalesce(rule.accept(value), F.lit(False))
        lines.append(
            F.struct(
                F.lit(layer).alias("layer"),
                F.lit(rule.name).alias("rule"),
                F.when(passed, "Passed").otherwise("Failed").alias("outcome"),
                value.alias("actual"),
                F.when(~passed, F.concat(F.lit(f"{rule.reason}: "), value.cast("string"))).alias("reason"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*lines)))


def report(outcomes: DataFrame, layer: str) -> DataFrame:
    """One row per layer; no rules at all is a pass rate of 0."""
    failed = F.col("outcome") != "Passed"
    n = F.count("*")
    return outcomes.where(F.col("layer") == layer).agg(
        F.lit(layer).alias("layer"),
        n.alias("total_rules"),
        (n - F.count_if(failed)).alias("passed_count"),
        F.count_if(failed).alias("failed_count"),
        F.when(n > 0, F.round((n - F.count_if(failed)) * 100.0 / n, 2)).otherwise(0.0).alias("pass_rate_pct"),
        (F.count_if(failed) == 0).alias("passed"),
        F.array_sort(F.collect_list(F.when(failed, F.struct("rule", "reason")))).alias("failed_rules"),
    )


def gate(document: dict | None, layer: str) -> dict:
    """The verdict of a stored report. ``None`` (absent or unreadable) counts as failed. The keys are
    fixed values of the verdict's layout."""
    if document is None:
        missing = {"rule": "report_available", "reason": "quality report not found or unreadable"}
        return {
            "layer": layer, "passed": False, "pass_rate_pct": 0.0, "failed_count": -1,
            "total_rules": 0, "failed_rules": [missing],
        }
    return {
        "layer": layer,
        "passed": bool(document.get("passed") or False),
        "pass_rate_pct": document.get("pass_rate_pct") or 0.0,
        "failed_count": document.get("failed_count") or 0,
        "total_rules": document.get("total_rules") or 0,
        "failed_rules": list(document.get("failed_rules") or []),
    }


def outcomes_of(layers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, layers)
