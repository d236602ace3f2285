"""Features of a transaction against its customer's own past.

Trailing windows are usually written as range frames over ``PARTITION BY customer_id``. That
puts a whole customer in one task and makes each row re-add its frame, so one busy customer
(a wallet, a test card, a shared account) costs the square of its rows. Here every trailing
window is a running sum over *changes* instead:

1. rows are first collapsed to one cell per (customer, second), which is exact because all
   frames are in whole seconds and include or exclude a second's rows together;
2. a cell is worth ``+v`` from the second it enters a frame and ``-v`` from the second it
   leaves it, and the running total of those changes at any second is the frame's sum;
3. running totals are taken per (customer, 5-day block), and each block starts from the sum of
   the customer's earlier blocks, which is found over one row per block.

A task's group is then bounded by the clock (one cell a second, 5 days) and not by the number
of transactions, the work is linear, and one customer's history is spread over many tasks.
Distinct merchants use the same sum: a merchant is worth 1 from a visit until 24 hours after it,
its visits of one day merged beforehand. What begins and ends in one second is netted before the
running sum, so that a customer with as many merchants as rows is bounded by the clock, too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk import schemas as S
from txnrisk.functions import scalars as X

KEY = "customer_id"
BLOCK_SECONDS = 5 * S.DAY


@dataclass(frozen=True)
class Frame:
    """A cell at second s counts for the seconds s+opens .. s+closes, both included."""

    code: int
    opens: int
    closes: int


LAST_HOUR = Frame(1, 0, S.HOUR)
LAST_DAY = Frame(2, 0, S.DAY)
PRIOR_MONTH = Frame(3, 1, S.MONTH)
MERCHANT = 4  # frame code of changes in the number of merchants, whose seconds are in the data


def _block(second: Column) -> Column:
    return F.floor(second / F.lit(BLOCK_SECONDS)).cast("long")


def _cells(df: DataFrame) -> DataFrame:
    """One row per (customer, second): rows, cents, cents squared."""
    cents = (F.col("amount").cast("decimal(12,2)") * 100).cast("long")
    return (
        df.where(F.col(KEY).isNotNull() & F.col("transaction_timestamp").isNotNull())
        .select(KEY, X.whole_second(F.col("transaction_timestamp")).alias("second"), cents.alias("cents"))
        .groupBy(KEY, "second")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"),
            F.coalesce(F.sum((F.col("cents").cast("decimal(19,0)") * F.col("cents")).cast("decimal(28,0)")), F.lit(0))
            .cast("decimal(38,0)")
            .alias("squares"),
        )
    )


def _merchant_changes(df: DataFrame, end: Column) -> DataFrame:
    """(customer, second, n): by how many the merchants seen within 24 hours change in that second.

    A merchant's spans are disjoint: it enters with a visit and leaves 24 hours after the last one.

    Two visits on one UTC day are never more than 24 hours apart, so a day reduces to its first
    and last visit before the shuffle. A span stops early where the next day's span begins.
    """
    second = X.whole_second(F.col("transaction_timestamp"))
    days = (
        df.where(F.col(KEY).isNotNull() & F.col("merchant_id").isNotNull())
        .select(KEY, "merchant_id", second.alias("second"))
        .where(F.col("second").isNotNull())
        .groupBy(KEY, "merchant_id", F.floor(F.col("second") / S.DAY).alias("day"))
        .agg(F.min("second").alias("from"), F.max("second").alias("last"))
    )
    following = F.lead("from").over(Window.partitionBy(KEY, "merchant_id").orderBy("day"))
    # least() skips the NULL of a merchant's final span.
    until = F.least(F.col("last") + S.DAY, following - 1)
    ends = F.array(
        F.struct(F.col("from").alias("second"), F.lit(1).alias("sign")),
        F.struct((F.col("until") + 1).alias("second"), F.lit(-1).alias("sign")),
    )
    # Summed on the map side first: a task sends one row per (customer, second), whatever the merchants.
    return (
        days.select(KEY, "from", until.alias("until"))
        .select(KEY, F.inline(ends))
        .where(F.col("second") <= end)
        .groupBy(KEY, "second")
        .agg(F.sum("sign").alias("n"))
        .where("n <> 0")
    )


def _spread(df: DataFrame, moments: list[tuple[Column, int, int]]) -> DataFrame:
    """A row per change: ``at``, ``frame`` and ``sign`` beside the columns of ``df``.

    Rows cross the network once per block they change, not once per change; the fan-out follows
    in the task that adds up. Neither projection nor explode disturbs the partitioning.
    """
    blocks = F.array_distinct(F.array(*[_block(at) for at, _, _ in moments]))
    changes = [
        F.when(
            _block(at) == F.col("block"),
            F.struct(
                at.alias("at"), F.lit(frame).cast("tinyint").alias("frame"), F.lit(sign).cast("tinyint").alias("sign")
            ),
        )
        for at, frame, sign in moments
    ]
    placed = df.withColumn("block", F.explode(blocks)).where(F.col("block") <= _block(F.col("end")))
    return (
        placed.drop("end")
        .repartition(KEY, "block")
        # A filter after the explode, not array_compact before it, which would not be compiled.
        .withColumn("change", F.explode(F.array(*changes)))
        .where("change IS NOT NULL")
        .select("*", "change.*")
        .drop("change")
    )


def _block_sums(df: DataFrame, moments: list[tuple[Column, int, int]], wanted: list[tuple[int, str]]) -> DataFrame:
    """What the changes of each row come to in each block, a row per (row, block) with a column per ``wanted``.

    A block's changes are counted, not listed, so that they are added up on the map side first.
    """
    blocks = F.array_distinct(F.array(*[_block(at) for at, _, _ in moments]))
    placed = df.withColumn("block", F.explode(blocks)).where(F.col("block") <= _block(F.col("end")))

    def net(code: int) -> Column:
        signs = [F.when(_block(at) == F.col("block"), sign).otherwise(0) for at, frame, sign in moments if frame == code]
        return reduce(add, signs, F.lit(0)).cast("tinyint")

    return placed.select(KEY, "block", *[F.when(net(code) != 0, F.col(value) * net(code)).alias(f"{value}_{code}") for code, value in wanted])


def trailing_sums(df: DataFrame, frames: list[Frame], merchants: bool) -> DataFrame:
    """Per (customer, second): for each frame ``n_<code>``, ``cents_<code>``,
    ``squares_<code>``, and with ``merchants`` also ``n_4``."""
    # Nothing is asked about after the last row, so what leaves a frame later is not moved.
    last = df.agg(F.max(X.whole_second(F.col("transaction_timestamp")))).scalar()
    end = last.alias("end")
    second = F.col("second")
    moments = [(second, 0, 0)]
    for frame in frames:
        moments += [(second + frame.opens, frame.code, 1), (second + frame.closes + 1, frame.code, -1)]
    shared = [KEY, "block", "at", "frame", "sign", "n", "cents", "squares"]
    cells = _cells(df).select("*", end)
    changes = _spread(cells, moments).select(*shared)
    if merchants:
        visits = _merchant_changes(df, last).select(
            "*",
            F.lit(0).cast("long").alias("cents"),
            F.lit(0).cast("decimal(38,0)").alias("squares"),
            end,
        )
        visited = [(second, MERCHANT, 1)]
        changes = changes.unionByName(_spread(visits, visited).select(*shared))

    wanted = [(frame.code, value) for frame in frames for value in _values(frame)]
    wanted += [(MERCHANT, "n")] if merchants else []

    def signed(code: int, value: str) -> Column:
        return F.sum(F.when(F.col("frame") == code, F.col(value) * F.col("sign")))

    inside = Window.partitionBy(KEY, "block").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"{value}_{code}" for code, value in wanted]
    blocks = _block_sums(cells, moments, wanted)
    if merchants:
        blocks = blocks.unionByName(_block_sums(visits, visited, wanted))
    blocks = blocks.groupBy(KEY, "block").agg(*[F.sum(n).alias(n) for n in names])
    opening = blocks.select(KEY, "block", *[F.sum(n).over(before).alias(f"before_{n}") for n in names])
    running = changes.select(
        KEY, "block", F.col("at").alias("second"), "frame", *[signed(*w).over(inside).alias(n) for w, n in zip(wanted, names, strict=True)]
    ).where(F.col("frame") == 0)
    zero = F.lit(0)
    return running.join(opening, [KEY, "block"]).select(
        KEY, "second", *[(F.coalesce(n, zero) + F.coalesce(f"before_{n}", zero)).alias(n) for n in names]
    )


def _values(frame: Frame) -> tuple[str, ...]:
    return ("n", "cents", "squares") if frame is PRIOR_MONTH else ("n", "cents")


def _velocity_columns() -> dict[str, Column]:
    return {
        "txn_count_1h": F.col("n_1"),
        "txn_count_24h": F.col("n_2"),
        "amount_sum_1h": F.col("cents_1") / 100.0,
        "amount_sum_24h": F.col("cents_2") / 100.0,
        "distinct_merchants_24h": F.col("n_4"),
    }


def _baseline_columns() -> dict[str, Column]:
    n = F.col("n_3")
    count = n.cast("decimal(19,0)")
    cents = F.col("cents_3").cast("decimal(19,0)")
    # n*sum(x^2) - (sum x)^2 is exact in integers, so equal amounts give a spread of exactly 0.
    # try_* turns a product beyond 38 digits into the double formula instead of an error.
    exact = F.try_subtract(F.try_multiply(F.col("squares_3"), count), cents * cents).cast("double")
    rough = F.col("squares_3").cast("double") * n - F.pow(F.col("cents_3").cast("double"), F.lit(2))
    scatter = F.coalesce(exact, rough)
    mean = F.when(n > 0, F.col("cents_3") / 100.0 / n)
    spread = F.when(n > 1, F.sqrt(F.greatest(scatter, F.lit(0.0)) / (n.cast("double") * (n - 1))) / 100.0)
    zscore = F.when(
        (n >= 3) & (spread > 0),
        X.rounded((F.col("amount").cast("double") - mean) / F.when(spread > 0, spread), 4),
    )
    return {
        "amount_mean_30d": X.rounded(mean, 4),
        "amount_stddev_30d": X.rounded(spread, 4),
        "prior_txn_count_30d": n,
        "amount_zscore_30d": zscore,
    }


def _last_of_second(df: DataFrame) -> DataFrame:
    """Per (customer, second) with rows: the position, time and device of the row just before
    that second, as ``before``. NULL for a customer's first second."""
    seen = F.struct("transaction_timestamp", "lat", "lon", "device_id")
    order = F.struct("transaction_timestamp", "transaction_id")
    cells = (
        df.where(F.col(KEY).isNotNull() & F.col("transaction_timestamp").isNotNull())
        .groupBy(KEY, X.whole_second(F.col("transaction_timestamp")).alias("second"))
        .agg(F.max_by(seen, order).alias("last"))
        .withColumn("block", _block(F.col("second")))
    )
    # Within a block the previous second is a lag; a block's first second takes the last row
    # of the customer's previous block, found over one row per block.
    ends = cells.groupBy(KEY, "block").agg(F.max_by("last", "second").alias("last"))
    carried = ends.select(
        KEY, "block", F.lag("last").over(Window.partitionBy(KEY).orderBy("block")).alias("carried")
    )
    inside = F.lag("last").over(Window.partitionBy(KEY, "block").orderBy("second"))
    return (
        cells.join(carried, [KEY, "block"], "left")
        .select(KEY, "second", F.coalesce(inside, F.col("carried")).alias("before"))
    )


def _geo_columns(prior: Column) -> dict[str, Column]:
    here, gone = X.whole_second(F.col("transaction_timestamp")), X.whole_second(prior["transaction_timestamp"])
    elapsed = here - gone
    distance = X.great_circle_km(prior["lat"], prior["lon"], F.col("lat"), F.col("lon"))
    hours = F.when(elapsed > 0, elapsed / 3600.0)
    return {
        "seconds_since_prior_txn": elapsed,
        "geo_distance_from_prior_km": X.rounded(distance, 3),
        "implied_speed_kmh": F.when(elapsed > 0, X.rounded(distance / hours, 2)).when(
            elapsed.isNotNull() & (distance > 1), F.lit(S.SAME_SECOND_SPEED_KMH)
        ),
        "device_change_flag": F.coalesce(prior["device_id"] != F.col("device_id"), F.lit(False)),
    }


def customer_history(
    df: DataFrame, velocity: bool = True, baseline: bool = True, travel: bool = True
) -> DataFrame:
    """Adds the chosen feature groups, all with one shuffle of the wide rows.

    The rows meet their features on (customer, second), a key that spreads a busy customer
    over all tasks.
    """
    frames = [LAST_HOUR, LAST_DAY] if velocity else []
    frames += [PRIOR_MONTH] if baseline else []
    columns: dict[str, Column] = {}
    out = df.withColumn("second", X.whole_second(F.col("transaction_timestamp")))
    if travel:
        peers = Window.partitionBy(KEY, "second").orderBy("transaction_timestamp", "transaction_id")
        seen = F.struct("transaction_timestamp", "lat", "lon", "device_id")
        out = out.withColumn("peer", F.lag(seen).over(peers))
        out = out.join(_last_of_second(df), [KEY, "second"], "left")
        out = out.withColumn("prior", F.coalesce("peer", "before"))
    if frames:
        out = out.join(trailing_sums(df, frames, merchants=velocity), [KEY, "second"], "left")
    if velocity:
        columns |= _velocity_columns()
    if baseline:
        columns |= _baseline_columns()
    if travel:
        columns |= _geo_columns(F.col("prior"))
    return out.select(*[out[c] for c in df.columns], *[c.alias(name) for name, c in columns.items()])


def velocity_features(df: DataFrame) -> DataFrame:
    """Counts, sums and distinct merchants over the last hour and the last 24 hours, the row
    itself and its same-second peers included."""
    return customer_history(df, baseline=False, travel=False)


def amount_zscore(df: DataFrame) -> DataFrame:
    """Amount against the previous 30 days, the current second excluded. No score with fewer
    than three earlier rows or without spread."""
    return customer_history(df, velocity=False, travel=False)


def geo_features(df: DataFrame) -> DataFrame:
    """Time, distance, speed and device change since the customer's previous transaction."""
    return customer_history(df, velocity=False, baseline=False)
