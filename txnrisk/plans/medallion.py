"""The batch pipeline over stored tables: raw -> bronze -> silver -> gold, gated per layer."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.functions import scalars as X
from txnrisk.ml import ensemble as EN
from txnrisk.operators import bronze as B
from txnrisk.operators import feedback as FB
from txnrisk.operators import gold as G
from txnrisk.operators import quality as Q
from txnrisk.operators import silver as V
from txnrisk.operators import value as VL
from txnrisk.sources import readers, scratch, writers


class GateClosed(RuntimeError):
    """A quality gate stopped the run; the later layers keep their previous content."""


@dataclass(frozen=True)
class Lake:
    """Where each table of one lake is stored."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def days_between(first: date, last: date) -> list[date]:
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def run_bronze(spark: SparkSession, lake: Lake, now: datetime, arrival_day: date | None = None) -> None:
    """Raw JSON into bronze and quarantine. Re-running a day adds no row to bronze: deliveries
    already there are replaced by themselves, and older ones never replace newer ones."""
    raw = readers.raw_json(spark, lake.path("raw"), arrival_day)
    clean, rejected = B.split(raw, now)
    writers.write_quarantine(rejected, lake.path("quarantine"), arrival_day)
    writers.upsert_table(
        B.deduplicate(clean), lake.path("bronze"), ["transaction_id"], newer_by="ingest_timestamp"
    )


def run_silver(
    spark: SparkSession, lake: Lake, as_of: date, process_days: int = 1, computed_at: datetime | None = None
) -> None:
    """Features for the last ``process_days`` days. The dimension is stamped with ``computed_at``, the
    beginning of ``as_of`` when not given.

    31 more days are read as history but not written back: their own history is cut off by the
    read, so writing them would replace good features with poor ones.
    """
    bronze = readers.recent(
        spark.read.parquet(lake.path("bronze")), as_of, readers.SILVER_LOOKBACK_DAYS + process_days
    )
    scored = G.stamped(V.merchant_risk_scores(bronze), "dim_computed_at", computed_at or datetime.combine(as_of, time()))
    writers.upsert_table(scored, lake.path("merchant_dim"), ["merchant_id"], partition_by=None)
    dim = spark.read.parquet(lake.path("merchant_dim")).drop("dim_computed_at")
    featured = V.silver(bronze, dim)
    fresh = featured.where(F.col("dt") >= F.lit(as_of - timedelta(days=process_days)))
    writers.upsert_table(fresh, lake.path("silver"), ["transaction_id"])


def run_gold(
    spark: SparkSession,
    lake: Lake,
    as_of: date,
    days: int = readers.GOLD_LOOKBACK_DAYS,
    merchant_days: int | None = None,
    computed_at: datetime | None = None,
) -> None:
    """Recompute the daily metrics of the last ``days`` days, days that lost all rows included,
    and the merchant snapshot over ``merchant_days`` (all history when None). Both are stamped with
    ``computed_at``, the beginning of ``as_of`` when not given."""
    moment = computed_at or datetime.combine(as_of, time())
    silver = spark.read.parquet(lake.path("silver"))
    recent = readers.recent(silver, as_of, days)
    asked = days_between(as_of - timedelta(days=days), as_of)
    daily = G.stamped(G.fraud_metrics_daily(recent), "gold_computed_at", moment)
    writers.overwrite_days(daily, lake.path("fraud_metrics_daily"), asked)
    scope = silver if merchant_days is None else readers.recent(silver, as_of, merchant_days)
    writers.overwrite_snapshot(G.stamped(G.merchant_risk(scope), "gold_computed_at", moment), lake.path("merchant_risk"))


def run_value(spark: SparkSession, lake: Lake, run_id: str, computed_at: datetime) -> None:
    """Re-price every day that has scores. Late labels change past days, so this is an upsert."""
    silver = spark.read.parquet(lake.path("silver"))
    scores = spark.read.parquet(lake.path("transaction_risk_scores"))
    stamped = VL.fraud_value_daily(silver, scores).withColumns(
        {"model_run_id": F.lit(run_id), "computed_at": F.lit(computed_at).cast("timestamp")}
    )
    writers.upsert_table(stamped, lake.path("fraud_value_daily"), ["dt"], partition_by=None)


def labelled_silver(spark: SparkSession, lake: Lake, as_of: date) -> DataFrame:
    """Model input of the last month with confirmed labels applied."""
    recent = readers.recent(spark.read.parquet(lake.path("silver")), as_of, readers.SILVER_LOOKBACK_DAYS)
    return FB.apply_feedback(readers.model_input(recent), readers.feedback(spark, lake.path("feedback")))


def run_model(
    spark: SparkSession, lake: Lake, as_of: datetime, run_id: str, settings: EN.Settings = EN.Settings()
) -> EN.Training:
    """Train on the last month with confirmed labels, publish scores and metrics, save the models,
    and price the days that were scored."""
    recent = readers.recent(spark.read.parquet(lake.path("silver")), as_of.date(), readers.SILVER_LOOKBACK_DAYS)
    feedback = readers.feedback(spark, lake.path("feedback"))
    stats = FB.feedback_stats(recent, feedback).first().asDict()
    labelled = scratch.stage(labelled_silver(spark, lake, as_of.date()), "labelled")
    training = EN.train(labelled, settings)
    writers.upsert_table(
        EN.stamped_scores(training, run_id, as_of), lake.path("transaction_risk_scores"), ["transaction_id"]
    )
    rows, fraud = labelled.agg(F.count("*"), X.tally(X.labelled(F.col("is_fraud")))).first()
    history = EN.stamped_metrics(training.metrics, run_id, as_of, rows, fraud, stats)
    writers.append(history, lake.path("model_metrics"), partition_by=None)
    training.ensemble.save(spark, lake.path("models"), run_id)
    run_value(spark, lake, run_id, as_of)
    return training


def check(spark: SparkSession, lake: Lake, layer: str, table: str, rules: list[Q.Rule]) -> dict:
    """Evaluate, store the report, and read the verdict back from what was stored."""
    outcomes = scratch.stage(Q.evaluate(spark.read.parquet(lake.path(table)), layer, rules), "quality")
    report = Q.report(outcomes, layer)
    path = f"{lake.path('quality')}/{layer}"
    writers.write_json_line(report, path)
    return Q.gate(writers.read_json_line(spark, path, report.schema), layer)


def _require(verdict: dict) -> dict:
    if not verdict["passed"]:
        raise GateClosed(f"{verdict['layer']}: {verdict['failed_rules']}")
    return verdict


def run(
    spark: SparkSession, lake: Lake, as_of: datetime, process_days: int = 1, gold_days: int | None = None, arrival_day: date | None = None
) -> list[dict]:
    """One pipeline run over the raw files of ``arrival_day``, or all. Raises GateClosed at the first
    layer that fails its rules."""
    day = as_of.date()
    run_bronze(spark, lake, as_of, arrival_day)
    known = writers.exists(spark, lake.path("merchant_dim"))
    dim = spark.read.parquet(lake.path("merchant_dim")) if known else None
    verdicts = [_require(check(spark, lake, "bronze", "bronze", Q.bronze_rules(as_of, dim)))]
    run_silver(spark, lake, day, process_days, as_of)
    verdicts.append(_require(check(spark, lake, "silver", "silver", Q.silver_rules())))
    run_gold(spark, lake, day, gold_days if gold_days is not None else readers.GOLD_LOOKBACK_DAYS, computed_at=as_of)
    verdicts.append(_require(check(spark, lake, "gold", "fraud_metrics_daily", Q.gold_rules())))
    return verdicts
