"""Null-safe, ANSI-safe column expressions. All of them stay inside generated JVM code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrisk import schemas as S

EARTH_RADIUS_KM = 6371.0


def instant(text: Column) -> Column:
    """ISO-8601 text to a timestamp; unreadable text becomes NULL, also under ANSI mode."""
    return F.try_to_timestamp(text)


def number(text: Column) -> Column:
    return text.try_cast("double")


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def whole_second(ts: Column) -> Column:
    # The inner cast admits TIMESTAMP_NTZ input.
    return F.unix_seconds(ts.cast("timestamp"))


def great_circle_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance. Any NULL coordinate gives NULL."""

    def half_angle_sq(degrees: Column) -> Column:
        return F.pow(F.sin(F.radians(degrees) / 2), F.lit(2))

    chord = half_angle_sq(lat_b - lat_a) + (
        F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_angle_sq(lon_b - lon_a)
    )
    # Rounding can lift the chord of antipodal points over 1, where asin is NaN. A NULL chord
    # fails the comparison and passes through, which least() would not do.
    inside = F.when(chord > 1.0, F.lit(1.0)).otherwise(chord)
    return F.asin(F.sqrt(inside)) * (2 * EARTH_RADIUS_KM)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL when the denominator is zero or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding of what the number means in decimal. 756.81 / 18 is 42.045, but as a
    binary double a hair less; ten digits take that noise away before the half is looked at."""
    return F.round(value.cast("decimal(38,10)"), digits).cast("double")


def percent(part: Column, whole: Column, digits: int) -> Column:
    """Rounded percentage, NULL (not 0) when there is nothing to take a share of."""
    return rounded(ratio(part.cast("double") * 100.0, F.when(whole > 0, whole)), digits)


def risk_tier(score: Column) -> Column:
    return (
        F.when(score >= S.HIGH_RISK, "high").when(score >= S.MEDIUM_RISK, "medium").otherwise("low")
    )


def labelled(flag: Column) -> Column:
    """A missing label counts as not fraud."""
    return F.coalesce(flag, F.lit(False))


def tally(flag: Column) -> Column:
    """Number of rows where ``flag`` is true; 0, not NULL, where it never is."""
    return F.count(F.when(flag, 1))


def money(amount: Column) -> Column:
    """Exact sum of a two-decimal amount, as a double: adding decimals makes the total
    independent of row order."""
    return F.coalesce(F.sum(amount.cast("decimal(12,2)")), F.lit(0)).cast("double")


def mean_money(amount: Column) -> Column:
    """Exact total over the count of amounts. An average of doubles would round a half cent up
    or down depending on the order of the rows."""
    return ratio(F.sum(amount.cast("decimal(12,2)")), F.count(amount))


def approved(code: Column) -> Column:
    return F.coalesce(code == S.APPROVED_CODE, F.lit(True))


def burst(per_hour: Column, per_day: Column) -> Column:
    return F.coalesce(
        (per_hour >= S.BURST_PER_HOUR) | (per_day >= S.BURST_PER_DAY), F.lit(False)
    )


def outlier(zscore: Column) -> Column:
    return F.coalesce(F.abs(zscore) >= S.OUTLIER_SIGMAS, F.lit(False))


def too_fast(speed_kmh: Column) -> Column:
    return F.coalesce(speed_kmh > S.TRAVEL_LIMIT_KMH, F.lit(False))


def signal_count(*flags: Column) -> Column:
    return reduce(add, [F.coalesce(flag, F.lit(False)).cast("int") for flag in flags])
