"""Queries over stored tables: a lake is filled from raw files by the pipeline, run twice in part, and read back."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk import schemas as S
from txnrisk.functions import scalars as X
from txnrisk.ml import ensemble as EN
from txnrisk.operators import feedback as FB
from txnrisk.operators import gold as G
from txnrisk.operators import quality as Q
from txnrisk.operators import splits as SP
from txnrisk.plans import medallion as P
from txnrisk.plans.portable import portable
from txnrisk.sources import readers, scratch, writers
from txnrisk.streaming import landing

# --- fixed values: days within the month of the events -------------------------------------
REPLAYED = date(2024, 1, 12)
REWRITTEN_FROM, EMPTIED = date(2024, 1, 20), date(2024, 1, 25)
SNAPSHOT_DAYS = 14
# ----------------------------------------------------------------------------------------

VERDICT = "layer STRING, passed BOOLEAN, pass_rate_pct DOUBLE, failed_count BIGINT, total_rules BIGINT, failed_rules STRING"


def queries(as_of: datetime, early_dim: Callable) -> dict[str, Callable]:
    """Name to query, each of the staged tables of one data folder."""
    day = as_of.date()

    def lake(t) -> P.Lake:
        """Bronze, silver and gold of all raw files; then one arrival day is delivered to bronze again."""
        if t.lake is None:
            home = P.Lake(scratch.new_path(t.spark, "lake"))
            arrived = F.to_date(X.instant(F.col("ingest_timestamp")))
            t.raw().withColumn("ingest_dt", arrived).write.partitionBy("ingest_dt").option("compression", "gzip").json(home.path("raw"))
            P.run_bronze(t.spark, home, as_of)
            P.run_bronze(t.spark, home, as_of, REPLAYED)
            month = readers.SILVER_LOOKBACK_DAYS
            P.run_silver(t.spark, home, day, month, as_of)
            P.run_gold(t.spark, home, day, month, computed_at=as_of)
            t.lake = home
        return t.lake

    def table(t, name: str) -> DataFrame:
        return t.spark.read.parquet(lake(t).path(name))

    def raw(t) -> DataFrame:
        return readers.raw_json(t.spark, lake(t).path("raw")).select(*S.RAW_COLUMNS)

    def arrival_day(t) -> DataFrame:
        return readers.raw_json(t.spark, lake(t).path("raw"), REPLAYED).select(*S.RAW_COLUMNS)

    def quarantine(t) -> DataFrame:
        return portable(readers.quarantine(t.spark, lake(t).path("quarantine")).drop("rejected_at"))

    def bronze(t) -> DataFrame:
        return portable(table(t, "bronze").select(*S.BRONZE.fieldNames()))

    def recent_input(t) -> DataFrame:
        """What training reads of the last week."""
        return portable(readers.model_input(readers.recent(table(t, "silver"), day, readers.GOLD_LOOKBACK_DAYS)))

    def feedback(t) -> DataFrame:
        path = scratch.new_path(t.spark, "feedback")
        t.feedback().write.json(path)
        return readers.feedback(t.spark, path)

    def days_overwritten(t) -> DataFrame:
        """Daily metrics after the last days were computed again without one channel; one of these days has lost
        all rows."""
        path = scratch.new_path(t.spark, "days-overwritten")
        writers.append(t.metrics(), path)
        left = t.silver().where((F.col("dt") >= F.lit(REWRITTEN_FROM)) & (F.col("dt") != F.lit(EMPTIED)) & (F.col("channel") != "recurring"))
        writers.overwrite_days(G.fraud_metrics_daily(left), path, P.days_between(REWRITTEN_FROM, day))
        return t.spark.read.parquet(path)

    def snapshot(t) -> DataFrame:
        """The merchant snapshot of all history, replaced by that of two weeks."""
        path = scratch.new_path(t.spark, "snapshot")
        writers.overwrite_snapshot(t.risk(), path)
        recent = readers.recent(t.silver(), day, SNAPSHOT_DAYS)
        writers.overwrite_snapshot(G.stamped(G.merchant_risk(recent), "gold_computed_at", as_of), path)
        return portable(t.spark.read.parquet(path))

    def history(t) -> DataFrame:
        """Three runs, each over the days up to its own, appended to one table that is created empty."""
        path, table_ = scratch.new_path(t.spark, "model-history"), None
        for back in (14, 7, 0):
            upto = day - timedelta(days=back)
            seen = members(t).where(F.col("dt") <= F.lit(upto))
            rows, fraud = seen.agg(F.count("*"), F.count_if(F.col("label") == 1.0)).first()
            stats = FB.feedback_stats(t.silver().where(F.col("dt") <= F.lit(upto)), t.feedback()).first().asDict()
            threshold = EN.chosen_threshold(seen.where("NOT in_holdout"), EN.Settings())
            rated = EN.holdout_rows(seen.where("in_holdout"), judged, threshold)
            run = EN.stamped_metrics(rated, str(upto), as_of - timedelta(days=back), rows, fraud, stats)
            table_ = writers.create_table(t.spark, path, run.schema, partition_by=None) if table_ is None else table_
            writers.append(run.select(*table_.columns), path, partition_by=None)
        return portable(t.spark.read.schema(table_.schema).parquet(path))

    names = ["amount", "merchant", "signals"]
    judged = {n: n for n in names} | {"ensemble": EN.ENSEMBLE_SCORE}

    def members(t) -> DataFrame:
        """Three deterministic members and their plain mean, with the side of the split: written once, as in training,
        since the threshold and every metric read it again."""
        return t._table("members", lambda: scored_members(t.silver()))

    def scored_members(silver: DataFrame) -> DataFrame:
        split = SP.train_holdout(silver)
        return split.select(
            "transaction_id", "dt", "in_holdout", X.labelled(F.col("is_fraud")).cast("double").alias("label"),
            X.rounded(F.col("amount").cast("double") / 1000.0, 6).alias("amount"),
            F.col("merchant_risk_score").alias("merchant"), (F.col("fraud_signal_count") / F.lit(4.0)).alias("signals"),
        ).withColumn(EN.ENSEMBLE_SCORE, EN.plain_mean(names))

    def decisions(t) -> DataFrame:
        scored = members(t)
        threshold = EN.chosen_threshold(scored.where("NOT in_holdout"), EN.Settings())
        return scored.select("transaction_id", "in_holdout", *EN.decided([*names, EN.ENSEMBLE_SCORE], threshold))

    def holdout(t) -> DataFrame:
        scored = members(t)
        threshold = EN.chosen_threshold(scored.where("NOT in_holdout"), EN.Settings())
        return EN.holdout_rows(scored.where("in_holdout"), judged, threshold)

    def verdicts(t) -> DataFrame:
        """The gates' verdicts, read back from stored reports: bronze on a first run (nothing to refer to) and on a
        later one, silver, gold, and a layer without a report."""
        rules = {
            "bronze, first run": (t.bronze(), Q.bronze_rules(as_of)),
            "bronze": (t.bronze(), Q.bronze_rules(as_of, early_dim(t))),
            "silver": (t.silver(), Q.silver_rules()),
            "gold": (t.metrics(), Q.gold_rules()),
        }
        home, found = scratch.new_path(t.spark, "reports"), []
        for i, (layer, (rows, asked)) in enumerate(rules.items()):
            report = Q.report(Q.evaluate(rows, layer, asked), layer)
            writers.write_json_line(report, f"{home}/{i}")
            found.append(Q.gate(writers.read_json_line(t.spark, f"{home}/{i}", report.schema), layer))
        found.append(Q.gate(writers.read_json_line(t.spark, f"{home}/absent", report.schema), "absent"))
        flat = [v | {"failed_rules": ";".join(r["rule"] for r in v["failed_rules"])} for v in found]
        return t.spark.createDataFrame(flat, VERDICT)

    def landed_kinds(t) -> DataFrame:
        """Lines of the raw zone and of its error sink by arrival day, where every tenth id's line is cut short."""
        home = scratch.new_path(t.spark, "landing-errors")
        line = F.to_json(F.struct(*S.RAW_COLUMNS))
        cut = F.when(F.col("transaction_id").endswith("7"), F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
        sent = t.raw().withColumn("line", line).select(cut.alias("value"), F.col("ingest_timestamp").alias("arrived"))
        sent.write.parquet(f"{home}/lines")
        lines = t.spark.readStream.schema(sent.schema).parquet(f"{home}/lines")
        for query in landing.start(lines, X.instant(F.col("arrived")), f"{home}/raw", f"{home}/errors", f"{home}/checkpoint", once=True):
            query.awaitTermination()
        kinds = [t.spark.read.text(f"{home}/{kind}").withColumn("kind", F.lit(kind)) for kind in ("raw", "errors")]
        both = kinds[0].unionByName(kinds[1])
        return both.groupBy("kind", "ingest_dt").agg(F.count("*").alias("lines"))

    return {
        "lake_raw": raw,
        "lake_arrival_day": arrival_day,
        "lake_quarantine": quarantine,
        "lake_bronze": bronze,
        "lake_recent_input": recent_input,
        "lake_daily_metrics": lambda t: portable(table(t, "fraud_metrics_daily")),
        "lake_merchant_dim": lambda t: portable(table(t, "merchant_dim").withColumn("merchant_avg_amount", X.rounded(F.col("merchant_avg_amount"), 6))),
        "lake_feedback": feedback,
        "lake_days_overwritten": days_overwritten,
        "lake_merchant_snapshot": snapshot,
        "lake_model_history": history,
        "gate_verdicts": verdicts,
        "landing_kinds": landed_kinds,
        "ensemble_decisions": decisions,
        "ensemble_holdout": holdout,
    }
