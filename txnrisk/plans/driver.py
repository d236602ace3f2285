"""Every operator as a query over the given tables.

The transactions are the rows of :mod:`txnrisk.plans.fixture`. As in a real lake, bronze, silver
and the daily metrics are written tables that the queries on later layers read; they are built on
first use and kept for the session.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk import schemas as S
from txnrisk.functions import scalars as X
from txnrisk.ml import ensemble as EN
from txnrisk.ml import features as MF
from txnrisk.operators import bronze as B
from txnrisk.operators import evaluate as E
from txnrisk.operators import feedback as FB
from txnrisk.operators import gold as G
from txnrisk.operators import history as H
from txnrisk.operators import monitor as M
from txnrisk.operators import online as O
from txnrisk.operators import quality as Q
from txnrisk.operators import retrieval as R
from txnrisk.operators import silver as V
from txnrisk.operators import splits as SP
from txnrisk.operators import value as VL
from txnrisk.plans import dashboards as D
from txnrisk.plans import goldsql as GS
from txnrisk.plans import stored
from txnrisk.plans.fixture import raw_transactions
from txnrisk.plans.medallion import Lake
from txnrisk.plans.portable import portable
from txnrisk.sources import readers, scratch, writers
from txnrisk.streaming import bronze_stream, customer_state, landing, scoring
from txnrisk.streaming.triggers import draining, wanted_runs

# --- fixed values: the events end on 2024-01-30 ------------------------------------------
AS_OF = datetime(2024, 1, 31)
FP_COST, FN_COST = 1.0, 20.0
SMALL_CAP = 10
# ----------------------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The staged tables of one data folder in one session."""

    _built: dict[tuple[str, str], Tables] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._staged: dict[str, DataFrame] = {}
        self.training: EN.Training | None = None
        self.lake: Lake | None = None

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Tables:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._built or cls._built[key].spark is not spark:
            cls._built[key] = cls(spark, sf_dir)
        return cls._built[key]

    @classmethod
    def forget(cls) -> None:
        cls._built.clear()

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def raw(self) -> DataFrame:
        return raw_transactions(self.spark, self.sf_dir)

    def _table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._staged:
            self._staged[name] = scratch.stage(build(), name)
        return self._staged[name]

    def bronze(self) -> DataFrame:
        return self._table("bronze", lambda: B.bronze(self.raw(), AS_OF)[0])

    def dim(self) -> DataFrame:
        return self._table("merchant_dim", lambda: V.merchant_risk_scores(self.bronze()))

    def silver(self) -> DataFrame:
        return self._table("silver", lambda: V.silver(self.bronze(), self.dim()))

    def metrics(self) -> DataFrame:
        return self._table("fraud_metrics_daily", lambda: G.fraud_metrics_daily(self.silver()))

    def risk(self) -> DataFrame:
        return self._table("merchant_risk", lambda: G.merchant_risk(self.silver()))

    def value(self) -> DataFrame:
        return self._table(
            "fraud_value_daily", lambda: VL.fraud_value_daily(self.silver(), rule_scores(self.silver()))
        )

    def model_metrics(self) -> DataFrame:
        return self._table("model_metrics", lambda: rule_model_metrics(self.silver(), self.feedback()))

    def feedback(self) -> DataFrame:
        """Two rounds of review per labelled id, the second overruling the first."""
        reviewed = self.given("labels").select(
            F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("transaction_id"), "toxic", "quality"
        )
        rounds = F.array(
            F.struct((F.col("toxic") == 1).alias("confirmed_is_fraud"), F.lit("2024-02-01T00:00:00Z").alias("confirmed_at")),
            F.struct((F.col("quality") == 0).alias("confirmed_is_fraud"), F.lit("2024-02-02T00:00:00Z").alias("confirmed_at")),
        )
        return reviewed.select("transaction_id", F.inline(rounds))


def rule_scores(silver: DataFrame) -> DataFrame:
    """Verdicts of the simplest model there is: any signal at all."""
    return silver.select(
        "transaction_id",
        (F.col("fraud_signal_count") >= 1).alias("predicted_is_fraud"),
        X.labelled(F.col("is_fraud")).alias("actual_is_fraud"),
    )


def rule_models(silver: DataFrame) -> DataFrame:
    """Four deterministic scorers per transaction, one week being one run."""
    amount = X.rounded(F.col("amount").cast("double") / 1000.0, 6)
    merchant = F.col("merchant_risk_score")
    signals = F.col("fraud_signal_count") / F.lit(4.0)
    together = X.rounded((amount + merchant + signals) / 3.0, 6)
    scores = {"amount": amount, "merchant": merchant, "signals": signals, "ensemble": together}
    members = [F.struct(F.lit(n).alias("model_name"), s.alias("score")) for n, s in scores.items()]
    run = F.date_format(F.date_trunc("week", "dt"), "yyyy-MM-dd").alias("model_run_id")
    return silver.select(run, "is_fraud", F.inline(F.array(*members)))


def rule_model_metrics(silver: DataFrame, feedback: DataFrame) -> DataFrame:
    by = ["model_run_id", "model_name"]
    scored = rule_models(silver)
    threshold = E.best_f1_threshold(scored, by=by).select(*by, "threshold")
    rated = E.holdout_metrics(scored.join(threshold, by), F.col("threshold"), by=by)
    week = F.date_format(F.date_trunc("week", "dt"), "yyyy-MM-dd")
    confirmed = FB.latest_confirmation(feedback)
    runs = (
        silver.select("transaction_id", "is_fraud", week.alias("model_run_id"))
        .join(confirmed, "transaction_id", "left")
        .groupBy("model_run_id")
        .agg(
            F.count("*").alias("training_rows"),
            F.count("confirmed_is_fraud").alias("feedback_labels_confirmed"),
            F.count_if(F.col("confirmed_is_fraud") != F.col("is_fraud")).alias("feedback_labels_changed"),
        )
    )
    return (
        rated.join(threshold.withColumnRenamed("threshold", "decision_threshold"), by)
        .join(runs, "model_run_id")
        .withColumn("trained_at", F.col("model_run_id"))
    )


def _raw_with_day(t: Tables) -> DataFrame:
    return t.raw().withColumn("dt", F.to_date(X.instant(F.col("ingest_timestamp"))))


def _early_dim(t: Tables) -> DataFrame:
    """A dimension of seven merchants in eight, by the hash of their ids: the others are unknown to it."""
    return V.merchant_risk_scores(t.bronze().where(~F.substring(F.md5("merchant_id"), 1, 1).isin("0", "1")))


def _orphans(t: Tables) -> DataFrame:
    rows = t.bronze().join(_early_dim(t).select("merchant_id"), "merchant_id", "left_anti")
    return rows.groupBy("merchant_id").agg(F.count("*").alias("rows_without_parent"))


def _keep_latest_lines(t: Tables) -> DataFrame:
    lines = t.given("lineitem")
    rest = [c for c in lines.columns if c not in ("l_orderkey", "l_linenumber", "l_shipdate")]
    return B.keep_latest(lines, ["l_orderkey", "l_linenumber"], "l_shipdate", *rest).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"),
    )


def _upserted(t: Tables) -> DataFrame:
    """Rows of the first schema version as the standing table, of the second and of later days as the batch."""
    clean = B.clean_rows(t.raw(), AS_OF)
    standing = B.deduplicate(clean.where("schema_version = 1")).drop("auth_response_code")
    extra = B.deduplicate(clean.where("schema_version = 2 OR dt >= '2024-01-15'")).withColumn("amount", (F.col("amount") + 1).cast("decimal(12,2)"))
    merged = writers.upsert(standing, extra, ["transaction_id"], newer_by="ingest_timestamp")
    return portable(merged.select("transaction_id", "amount", "schema_version", "auth_response_code", "ingest_timestamp"))


def _replayed(t: Tables) -> DataFrame:
    """A stored table after a batch that corrects three days, moving some rows to the next day, and its replay."""
    bronze = t.bronze().select("transaction_id", "amount", "dt")
    path = scratch.new_path(t.spark, "upsert-replayed")
    writers.upsert_table(bronze, path, ["transaction_id"])
    later = F.when(F.expr("cast(substring(transaction_id, 2) AS bigint) % 3 = 0"), F.date_add("dt", 1)).otherwise(F.col("dt"))
    batch = bronze.where("dt BETWEEN '2024-01-10' AND '2024-01-12'").withColumns({"amount": (F.col("amount") + 1).cast("decimal(12,2)"), "dt": later})
    for _ in range(2):
        writers.upsert_table(batch, path, ["transaction_id"])
    return portable(t.spark.read.parquet(path).select("transaction_id", "amount", "dt"))


def _evolved(t: Tables) -> DataFrame:
    """Old rows without the newer column beside new rows with it."""
    bronze = t.bronze()
    old = bronze.where("schema_version = 1").drop("auth_response_code")
    new = bronze.where("schema_version = 2")
    both = writers.add_columns(old, new).unionByName(new)
    return M.schema_version_mix(both)


def _outcomes(df: DataFrame) -> DataFrame:
    return df.select("layer", "rule", "outcome", "actual")


def _quality_bronze(t: Tables) -> DataFrame:
    return _outcomes(Q.evaluate(t.bronze(), "bronze", Q.bronze_rules(AS_OF, _early_dim(t))))


def _quality_silver(t: Tables) -> DataFrame:
    return _outcomes(Q.evaluate(t.silver(), "silver", Q.silver_rules()))


def _quality_gold(t: Tables) -> DataFrame:
    return _outcomes(Q.evaluate(t.metrics(), "gold", Q.gold_rules()))


def _quality_report(t: Tables) -> DataFrame:
    outcomes = Q.evaluate(t.bronze(), "bronze", Q.bronze_rules(AS_OF, _early_dim(t)))
    return Q.report(outcomes, "bronze").withColumn("failed_rules", F.array_join(F.transform("failed_rules", lambda r: r["rule"]), ";"))


def _health(t: Tables) -> DataFrame:
    intake = M.intake_metrics(B.flag_defects(t.raw()))
    checks = [M.freshness(t.bronze(), AS_OF), M.drift(t.model_metrics()), M.quarantine_pressure(intake)]
    return Q.outcomes_of(checks)


def _labelled(t: Tables) -> DataFrame:
    return FB.apply_feedback(t.silver(), t.feedback()).select("transaction_id", "is_fraud")


def _now():
    return F.lit(AS_OF).cast("timestamp").cast("double")


def _events(t: Tables) -> DataFrame:
    return O.readable_events(t.raw(), X.instant(F.col("ingest_timestamp")))


def state_text(events) -> F.Column:
    """A state as text: milliseconds and cents, oldest first."""
    entry = lambda e: F.concat_ws(
        ":", F.round(e["t"] * 1000).cast("long").cast("string"), F.round(e["a"] * 100).cast("long").cast("string")
    )
    return F.array_join(F.transform(events, entry), ",")


def _online_state(t: Tables) -> DataFrame:
    return O.state_of(_events(t), _now()).select("customer_id", state_text("events").alias("events"))


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(
        *[X.rounded(F.col(f.name), digits).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name) for f in df.schema]
    )


def _online_features(t: Tables) -> DataFrame:
    return _rounded(O.online_features(O.state_of(_events(t), _now()), _now()))


def _layered(t: Tables) -> DataFrame:
    """Each customer's next event, an average transaction, scored with what is known of them."""
    state = O.state_of(_events(t), _now())
    asked = t.bronze().groupBy("customer_id").agg(
        F.max("transaction_id").alias("transaction_id"), F.max("amount").cast("double").alias("amount"), F.max("channel").alias("channel")
    )
    return _rounded(O.layer_features(asked, O.online_features(state, _now())))


def _split_counts(split: DataFrame) -> DataFrame:
    return split.select("transaction_id", "in_holdout")


def _scored(t: Tables) -> DataFrame:
    return rule_models(t.silver())


def _plain_scores(t: Tables) -> DataFrame:
    """Three scorers with nothing rounded away, for the exact ranks."""
    usd = F.col("amount").cast("double")
    scores = {
        "amount": usd / 7000.0,
        "speed": 1.0 - 1.0 / (1.0 + F.coalesce(F.col("seconds_since_prior_txn"), F.lit(0)).cast("double")),
        "busy": usd / (1.0 + F.col("txn_count_24h").cast("double")),
    }
    members = [F.struct(F.lit(n).alias("model_name"), s.alias("score")) for n, s in scores.items()]
    return t.silver().select("is_fraud", F.inline(F.array(*members)))


def _fold_scores(t: Tables) -> DataFrame:
    """The deterministic scorers on five stratified folds."""
    folds = SP.stratified_folds(t.silver().select("transaction_id", "is_fraud", "amount", "merchant_risk_score", "fraud_signal_count", "dt"), 5)
    amount = X.rounded(F.col("amount").cast("double") / 1000.0, 6)
    members = {"amount": amount, "merchant": F.col("merchant_risk_score"), "signals": F.col("fraud_signal_count") / F.lit(4.0)}
    return folds.select("fold", "is_fraud", F.inline(F.array(*[F.struct(F.lit(n).alias("model_name"), s.alias("score")) for n, s in members.items()])))


def _nearest(t: Tables) -> DataFrame:
    """The five closest vectors to every vector whose id is divisible by 20, itself among them."""
    vectors = t.given("embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return R.top_k_cosine(asked, corpus)


def _cited(t: Tables) -> DataFrame:
    named = t.given("documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("document"))
    found = _nearest(t).join(named, "item_id", "left")
    return R.citations(found, "document").select("query_id", "rank", "citation", "score")


_QUESTION = """WITH busy AS (SELECT mcc, sum(transaction_count) AS n FROM fraud_metrics_daily GROUP BY mcc)
           SELECT r.merchant_id, r.mcc, b.n AS category_transactions, r.fraud_rate_pct
           FROM merchant_risk r JOIN busy b ON r.mcc = b.mcc
           WHERE r.fraud_transaction_count > 0
           ORDER BY r.fraud_rate_pct DESC, r.merchant_id"""


def _desk(t: Tables, cap: int) -> GS.GoldDesk:
    paths = {"fraud_metrics_daily": t.metrics(), "merchant_risk": t.risk()}
    return GS.GoldDesk(t.spark, {n: d.inputFiles()[0].rsplit("/", 1)[0] for n, d in paths.items()}, "analyst", cap)


def _gold_question(t: Tables) -> DataFrame:
    """An analyst's question through the desk: only gold, only visible columns, capped."""
    return _desk(t, GS.AGENT_ROW_CAP).ask(_QUESTION)


def _gold_question_cut(t: Tables) -> DataFrame:
    """The same question under a cap that bites, with the place of each row and whether rows were cut."""
    return _desk(t, SMALL_CAP).answer(_QUESTION)


def _mccs(df: DataFrame) -> DataFrame:
    return df.select("mcc", "channel") if "channel" in df.columns else df.select("mcc")


def _listing(t: Tables) -> DataFrame:
    return D.model_listing(t.model_metrics())


def _trend(t: Tables) -> DataFrame:
    point = lambda p: F.concat_ws(
        ":", p["run"], F.coalesce((F.round(p["roc_auc"] * 10000)).cast("long").cast("string"), F.lit("none"))
    )
    return D.auc_trend(t.model_metrics()).select("model", F.array_join(F.transform("trend", point), ",").alias("trend"))


def _bronze_features(group: str) -> Callable[[Tables], DataFrame]:
    made = {"velocity": H.velocity_features, "baseline": H.amount_zscore, "travel": H.geo_features}[group]

    def query(t: Tables) -> DataFrame:
        bronze = t.bronze()
        added = made(bronze)
        return added.select("transaction_id", *[c for c in added.columns if c not in bronze.columns])

    return query


def _landed(t: Tables) -> str:
    """The raw zone, filled by the landing stream from lines of JSON text."""
    home = scratch.new_path(t.spark, "landing")
    t.raw().select(F.to_json(F.struct(*S.RAW_COLUMNS)).alias("value")).write.text(f"{home}/lines")
    lines = t.spark.readStream.schema("value STRING").text(f"{home}/lines")
    arrival = X.instant(F.get_json_object("value", "$.ingest_timestamp"))
    for query in landing.start(lines, arrival, f"{home}/raw", f"{home}/errors", f"{home}/checkpoint", once=True):
        query.awaitTermination()
    return home


def _stream_landing(t: Tables) -> DataFrame:
    landed = readers.raw_view(t.spark, f"{_landed(t)}/raw")
    return landed.groupBy("ingest_dt").agg(
        F.count("*").alias("records"), F.count("txn_timestamp").alias("with_time"), F.count("auth_response_code").alias("with_code")
    )


def _stream_bronze(t: Tables) -> DataFrame:
    home = _landed(t)
    bronze_stream.start(
        t.spark, f"{home}/raw", f"{home}/bronze", f"{home}/quarantine", f"{home}/bronze_checkpoint", AS_OF, once=True
    ).awaitTermination()
    return portable(t.spark.read.schema(S.BRONZE).parquet(f"{home}/bronze").select(*S.BRONZE.fieldNames()))


def _drained(t: Tables, frame: DataFrame, mode: str) -> DataFrame:
    """What a stateful query emits over all that is there, as a table."""
    home = scratch.new_path(t.spark, "stream")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={batch_id}")

    with draining(t.spark):
        query = (
            frame.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{home}/checkpoint")
            .trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return t.spark.read.parquet(f"{home}/rows")


def _arriving(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(S.RAW).json(f"{_landed(t)}/raw").select(*S.RAW_COLUMNS)


def _stream_runs(t: Tables) -> DataFrame:
    """The runs that the arrivals ask for: one per day of arrival and quarter of an hour."""
    arrived = X.instant(F.col("ingest_timestamp"))
    runs = wanted_runs(_arriving(t), F.to_date(arrived), arrived)
    return portable(_drained(t, runs, "append").drop("batch"))


def _stream_customer_state(t: Tables) -> DataFrame:
    events = O.readable_events(_arriving(t), X.instant(F.col("ingest_timestamp")))
    states = _drained(t, customer_state.customer_states(events, _now()), "update")
    newest = states.groupBy("customer_id").agg(F.max_by("events", "batch").alias("events"))
    return newest.select("customer_id", state_text("events").alias("events"))


def _training(t: Tables) -> EN.Training:
    if t.training is None:
        t.training = EN.train(t.silver())
    return t.training


def _stream_scores(t: Tables) -> DataFrame:
    """Every readable raw event, scored on arrival with what was known of its customer."""
    raw = B.clean_rows(_arriving(t), AS_OF)
    events = raw.select(
        "transaction_id", "customer_id", "channel", F.col("amount").cast("double").alias("amount"),
        F.col("transaction_timestamp").cast("double").alias("t"), F.col("amount").cast("double").alias("a"),
    )
    return _drained(t, scoring.scored(events, _training(t).ensemble), "append").drop("batch")


_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "raw_rows_per_day": lambda t: M.raw_rows_per_day(_raw_with_day(t)),
    "raw_fraud_mix": lambda t: M.raw_fraud_mix(_raw_with_day(t)),
    "bronze_rejections": lambda t: M.rejection_breakdown(B.flag_defects(t.raw())),
    "bronze_valid": lambda t: portable(B.clean_rows(t.raw(), AS_OF)),
    "bronze_quarantine": lambda t: portable(B.rejected_rows(t.raw(), AS_OF)).drop("rejection_reasons", "rejected_at"),
    "bronze_deduplicated": lambda t: portable(t.bronze()),
    "dedupe_latest": _keep_latest_lines,
    "ingest_metrics": lambda t: M.intake_metrics(B.flag_defects(t.raw())),
    "schema_version_mix": lambda t: M.schema_version_mix(t.bronze()),
    "schema_evolution": _evolved,
    "replay_proof": lambda t: M.replay_proof(t.bronze()),
    "upsert_transactions": _upserted,
    "upsert_replayed_table": _replayed,
    "referential_orphans": _orphans,
    "velocity_features": _bronze_features("velocity"),
    "amount_zscore": _bronze_features("baseline"),
    "geo_features": _bronze_features("travel"),
    "merchant_risk_scores": lambda t: _rounded(V.merchant_risk_scores(t.bronze()), 6),
    "silver_signals": lambda t: V.silver(t.bronze(), t.dim()).select(
        "transaction_id", "merchant_risk_score", "merchant_risk_tier", "is_high_velocity",
        "is_amount_outlier", "is_impossible_travel", "device_change_flag", "fraud_signal_count",
    ),
    "silver_unknown_merchants": lambda t: V.with_merchant_risk(
        t.bronze().select("transaction_id", "merchant_id"), _early_dim(t)
    ).select("transaction_id", "merchant_risk_score", "merchant_risk_tier"),
    "fraud_metrics_daily": lambda t: G.fraud_metrics_daily(t.silver()),
    "merchant_risk": lambda t: G.merchant_risk(t.silver()),
    "gold_summary": lambda t: G.gold_summary(t.metrics()),
    "latest_partition": lambda t: M.latest_partition(t.metrics()),
    "feature_health": lambda t: _rounded(M.feature_health(t.silver()), 6),
    "signal_recall": lambda t: M.signal_recall(t.silver()),
    "dash_daily": lambda t: D.daily(t.metrics()),
    "dash_channel": lambda t: D.by_channel(t.metrics()),
    "dash_mcc_top8": lambda t: D.costliest_categories(t.metrics()),
    "ops_tiles": lambda t: D.ops_tiles(t.metrics()),
    "model_metrics": _listing,
    "model_leaderboard": lambda t: D.leaderboard(t.model_metrics()),
    "auc_trend": _trend,
    "feedback_per_run": lambda t: D.feedback_per_run(t.model_metrics()),
    "value_listing": lambda t: D.value_listing(t.value()),
    "business_tiles": lambda t: D.business_tiles(t.value()),
    "business_daily": lambda t: D.business_daily(t.value()),
    "mcc_period_over_period": lambda t: GS.period_over_period(t.metrics(), AS_OF, 14),
    "metrics_join_risk": lambda t: GS.merchants_with_category(t.metrics(), t.risk()),
    "gold_union": lambda t: t.metrics().select("mcc").unionByName(t.risk().select("mcc")),
    "gold_union_distinct": lambda t: t.metrics().select("mcc").union(t.risk().select("mcc")).distinct(),
    "gold_except": lambda t: t.silver().select("merchant_id").subtract(
        t.risk().where("merchant_risk_tier = 'low'").select("merchant_id")
    ),
    "gold_intersect": lambda t: t.metrics().where("fraud_transaction_count > 0").select("mcc", "channel").intersect(
        t.metrics().where("approval_rate_pct < 100").select("mcc", "channel")
    ),
    "recent_scored": lambda t: portable(
        t.silver().select("transaction_id", "ingest_timestamp", "fraud_signal_count")
        .orderBy(F.desc("ingest_timestamp"), "transaction_id").limit(100)
    ),
    "gold_question": _gold_question,
    "gold_question_cut": _gold_question_cut,
    "analyst_view": lambda t: GS.persona_view("fraud_metrics_daily", t.metrics(), "analyst"),
    "analyst_risk_view": lambda t: GS.persona_view("merchant_risk", t.risk(), "analyst"),
    "quality_bronze": _quality_bronze,
    "quality_silver": _quality_silver,
    "quality_gold": _quality_gold,
    "quality_report": _quality_report,
    "health_checks": _health,
    "feedback_labels": _labelled,
    "feedback_stats": lambda t: FB.feedback_stats(t.silver(), t.feedback()),
    "fraud_value_daily": lambda t: VL.fraud_value_daily(t.silver(), rule_scores(t.silver())),
    "online_state": _online_state,
    "online_features": _online_features,
    "online_features_exact": lambda t: _rounded(O.exact_features(_events(t), _now())),
    "layered_features": _layered,
    "feature_matrix": lambda t: MF.matrix(t.silver()),
    "stratified_split": lambda t: _split_counts(SP.stratified_split(t.silver())),
    "temporal_split": lambda t: _split_counts(SP.temporal_split(t.silver())),
    "threshold_f1": lambda t: _rounded(E.best_f1_threshold(_scored(t), by=["model_name"]), 6),
    "threshold_cost": lambda t: E.min_cost_threshold(_scored(t), FP_COST, FN_COST, by=["model_name"]),
    "auc_ap": lambda t: E.ranking_metrics(_scored(t), by=["model_name"]),
    "auc_ap_exact": lambda t: E.exact_ranking_metrics(_plain_scores(t), by=["model_name"]),
    "cv_folds": lambda t: SP.stratified_folds(t.silver(), 5).select("transaction_id", "fold"),
    "cv_auc": lambda t: E.fold_stability(_fold_scores(t)),
    "passage_chunks": lambda t: R.chunk(t.given("documents").select("doc_id", "source", "text")),
    "topk_cosine": _nearest,
    "citations": _cited,
    "stream_landing": _stream_landing,
    "stream_bronze": _stream_bronze,
    "stream_runs": _stream_runs,
    "stream_customer_state": _stream_customer_state,
    "ensemble_scores": lambda t: _training(t).scores,
    "ensemble_metrics": lambda t: _training(t).metrics,
    "stream_scores": _stream_scores,
}


def queries() -> dict[str, Query]:
    def bound(run: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, sf_dir: run(Tables.of(spark, sf_dir))

    found = _QUERIES | stored.queries(AS_OF, _early_dim)
    return {name: bound(run) for name, run in found.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events to the daily fraud metrics."""
    t = Tables.of(spark, sf_dir)
    return G.fraud_metrics_daily(V.silver(t.bronze(), t.dim()))
