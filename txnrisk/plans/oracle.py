"""The same results in plain SQL, for any engine with window functions (written for DuckDB).

Independent of the Spark code: trailing features are range frames here, splits are rankings.
"""

from __future__ import annotations

from txnrisk.ml.features import CEILINGS, FLAGS, NUMERIC
from txnrisk.plans.fixture import raw_sql_duckdb
from txnrisk.schemas import CHANNELS
from txnrisk.sources.readers import MODEL_INPUT

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
NOW = "1706659200.0"


def rnd(x: str, digits: int) -> str:
    """Half-up rounding on decimals: rounding a binary double differs between engines."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def pct(part: str, whole: str, digits: int) -> str:
    return rnd(f"(CASE WHEN {whole} > 0 THEN 100.0::DOUBLE * ({part}) / ({whole}) END)", digits)


def money(x: str) -> str:
    return f"CAST(coalesce(sum(CAST({x} AS DECIMAL(12,2))), 0) AS DOUBLE)"


def when(cond: str) -> str:
    return f"count(CASE WHEN {cond} THEN 1 END)"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%g')"


_RULES = {
    "null_transaction_id": "transaction_id IS NULL OR trim(transaction_id) = ''",
    "null_customer_id": "customer_id IS NULL OR trim(customer_id) = ''",
    "null_merchant_id": "merchant_id IS NULL OR trim(merchant_id) = ''",
    "non_numeric_amount": "amount IS NOT NULL AND try_cast(amount AS DOUBLE) IS NULL",
    "missing_amount": "amount IS NULL",
    "amount_out_of_range": "try_cast(amount AS DOUBLE) < 0.01 OR try_cast(amount AS DOUBLE) > 25000",
    "unparseable_timestamp": "try_cast(timestamp AS TIMESTAMP) IS NULL",
    "lat_out_of_range": "abs(try_cast(lat AS DOUBLE)) > 90",
    "lon_out_of_range": "abs(try_cast(lon AS DOUBLE)) > 180",
    "unknown_channel": "channel NOT IN ('card_present','ecommerce','contactless','recurring')",
}

_CTE: dict[str, str] = {
    "raw": raw_sql_duckdb(),
    "flagged": "SELECT *, list_filter(["
    + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in _RULES.items())
    + "], lambda x: x IS NOT NULL) AS reasons FROM raw",
    "valid": """
        SELECT transaction_id, customer_id, merchant_id, mcc, CAST(amount AS DECIMAL(12,2)) AS amount,
               coalesce(currency, 'USD') AS currency, CAST(timestamp AS TIMESTAMP) AS transaction_timestamp,
               try_cast(lat AS DOUBLE) AS lat, try_cast(lon AS DOUBLE) AS lon, device_id, channel,
               CAST(is_fraud AS BOOLEAN) AS is_fraud, auth_response_code,
               CAST(ingest_timestamp AS TIMESTAMP) AS ingest_timestamp,
               coalesce(try_cast(schema_version AS INT), 1) AS schema_version, anomaly_type,
               CAST(CAST(timestamp AS TIMESTAMP) AS DATE) AS dt
        FROM flagged WHERE len(reasons) = 0""",
    "bronze": """
        SELECT * EXCLUDE copy FROM (
          SELECT *, row_number() OVER (PARTITION BY transaction_id
                    ORDER BY ingest_timestamp DESC NULLS LAST, transaction_timestamp DESC NULLS LAST) AS copy
          FROM valid) WHERE copy = 1""",
    "timed": "SELECT *, CAST(floor(epoch(transaction_timestamp)) AS BIGINT) AS s, CAST(amount AS DOUBLE) AS usd FROM bronze",
    "velocity": """
        SELECT *, count(*) OVER h AS txn_count_1h, count(*) OVER d AS txn_count_24h,
               CAST(sum(amount) OVER h AS DOUBLE) AS amount_sum_1h, CAST(sum(amount) OVER d AS DOUBLE) AS amount_sum_24h,
               count(DISTINCT merchant_id) OVER (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS distinct_merchants_24h
        FROM timed
        WINDOW h AS (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW),
               d AS (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""",
    "based": """
        SELECT *, CAST(sum(amount) OVER m AS DOUBLE) / count(*) OVER m AS mean30, stddev_samp(usd) OVER m AS sd30, count(*) OVER m AS prior_txn_count_30d
        FROM velocity
        WINDOW m AS (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING)""",
    "scored": f"""
        SELECT *, {rnd('mean30', 4)} AS amount_mean_30d, {rnd('sd30', 4)} AS amount_stddev_30d,
               {rnd('(CASE WHEN prior_txn_count_30d >= 3 AND sd30 > 0 THEN (usd - mean30) / sd30 END)', 4)} AS amount_zscore_30d
        FROM based""",
    "lagged": """
        SELECT *, lag(lat) OVER p AS lat0, lag(lon) OVER p AS lon0, lag(s) OVER p AS s0, lag(device_id) OVER p AS device0
        FROM scored WINDOW p AS (PARTITION BY customer_id ORDER BY transaction_timestamp, transaction_id)""",
    "placed": """
        SELECT *, s - s0 AS seconds_since_prior_txn,
               2 * 6371.0 * asin(sqrt(CASE WHEN chord > 1 THEN 1.0 ELSE chord END)) AS km
        FROM (SELECT *, power(sin(radians(lat - lat0) / 2), 2)
                        + cos(radians(lat0)) * cos(radians(lat)) * power(sin(radians(lon - lon0) / 2), 2) AS chord
              FROM lagged)""",
    "history": f"""
        SELECT *, {rnd('km', 3)} AS geo_distance_from_prior_km,
               CASE WHEN s > s0 THEN {rnd('(km / ((s - s0) / 3600.0::DOUBLE))', 2)}
                    WHEN s0 IS NOT NULL AND km > 1 THEN 99999.0::DOUBLE END AS implied_speed_kmh,
               coalesce(device_id <> device0, FALSE) AS device_change_flag
        FROM placed""",
    "silver": """
        SELECT *, CAST(is_high_velocity AS INT) + CAST(is_amount_outlier AS INT) + CAST(is_impossible_travel AS INT)
                  + CAST(device_change_flag AS INT) AS fraud_signal_count
        FROM (SELECT history.*, coalesce(dim.merchant_risk_score, 0.02::DOUBLE) AS merchant_risk_score,
                     coalesce(dim.merchant_risk_tier, 'unknown') AS merchant_risk_tier,
                     txn_count_1h >= 5 OR txn_count_24h >= 20 AS is_high_velocity,
                     coalesce(abs(amount_zscore_30d) >= 3, FALSE) AS is_amount_outlier,
                     coalesce(implied_speed_kmh > 900, FALSE) AS is_impossible_travel
              FROM history LEFT JOIN dim USING (merchant_id))""",
}


def _dim(source: str) -> str:
    score = rnd(
        f"((merchant_fraud_count + 20 * (SELECT avg(CAST(coalesce(is_fraud, FALSE) AS INT)) FROM {source})) / (merchant_txn_count + 20.0::DOUBLE))",
        6,
    )
    return f"""
        SELECT *, CASE WHEN merchant_risk_score >= 0.05 THEN 'high' WHEN merchant_risk_score >= 0.02 THEN 'medium' ELSE 'low' END AS merchant_risk_tier
        FROM (SELECT *, {score} AS merchant_risk_score FROM (
          SELECT merchant_id, count(*) AS merchant_txn_count, {when('is_fraud')} AS merchant_fraud_count,
                 {rnd('CAST(sum(amount) AS DOUBLE) / count(amount)', 6)} AS merchant_avg_amount
          FROM {source} GROUP BY merchant_id))"""


_CTE["dim"] = _dim("bronze")
_CTE["early"] = "SELECT * FROM bronze WHERE substr(md5(merchant_id), 1, 1) NOT IN ('0', '1')"
_CTE["early_dim"] = _dim("early")

_VOLUME = f"""count(*) AS transaction_count, count(DISTINCT customer_id) AS distinct_customer_count,
    {when('is_fraud')} AS fraud_transaction_count, {money('amount')} AS total_amount_usd,
    {money('CASE WHEN is_fraud THEN amount END')} AS fraud_loss_amount_usd,
    {rnd('CAST(sum(amount) AS DOUBLE) / count(amount)', 2)} AS avg_transaction_amount_usd"""

_CTE["metrics"] = f"""
    SELECT *, {pct('fraud_transaction_count', 'transaction_count', 4)} AS fraud_rate_pct,
           {pct('approved_transaction_count', 'transaction_count', 4)} AS approval_rate_pct,
           {pct('fraud_loss_amount_usd', 'total_amount_usd', 4)} AS fraud_loss_rate_pct
    FROM (SELECT dt, mcc, channel, {_VOLUME}, count(DISTINCT merchant_id) AS distinct_merchant_count,
                 {when("auth_response_code IS NULL OR auth_response_code = '00'")} AS approved_transaction_count,
                 CAST(sum(fraud_signal_count) AS BIGINT) AS total_fraud_signals
          FROM silver GROUP BY dt, mcc, channel)"""
_CTE["risk"] = f"""
    SELECT *, {pct('fraud_transaction_count', 'transaction_count', 4)} AS fraud_rate_pct
    FROM (SELECT merchant_id, mcc, {_VOLUME}, {rnd('max(merchant_risk_score)', 6)} AS merchant_risk_score,
                 max(merchant_risk_tier) AS merchant_risk_tier, min(dt) AS first_seen_date, max(dt) AS last_seen_date
          FROM silver GROUP BY merchant_id, mcc)"""

_PRICED = ", ".join(
    f"{when(cond)} AS {name}_count, {money(f'CASE WHEN {cond} THEN amount END')} AS {name}_amount_usd"
    for name, cond in {
        "actual_fraud": "actual",
        "caught_fraud": "predicted AND actual",
        "missed_fraud": "actual AND NOT predicted",
        "false_alarm": "predicted AND NOT actual",
    }.items()
)
_CTE["value"] = f"""
    SELECT *, {pct('caught_fraud_count', 'actual_fraud_count', 2)} AS capture_rate_pct,
           {pct('caught_fraud_amount_usd', 'actual_fraud_amount_usd', 2)} AS dollar_capture_rate_pct,
           {pct('caught_fraud_count', 'flagged_count', 2)} AS flag_precision_pct
    FROM (SELECT dt, count(*) AS transaction_count, {money('amount')} AS total_amount_usd, {when('predicted')} AS flagged_count, {_PRICED}
          FROM (SELECT dt, amount, fraud_signal_count >= 1 AS predicted, coalesce(is_fraud, FALSE) AS actual FROM silver)
          GROUP BY dt)"""

_CTE["confirmed"] = "SELECT concat('T', CAST(doc_id AS VARCHAR)) AS transaction_id, quality = 0 AS confirmed_is_fraud FROM labels"

# --- rule models -------------------------------------------------------------------------
_CTE["members"] = f"""
    SELECT strftime(date_trunc('week', dt), '%Y-%m-%d') AS model_run_id, coalesce(is_fraud, FALSE) AS fraud,
           {rnd('(CAST(amount AS DOUBLE) / 1000.0)', 6)} AS a, merchant_risk_score AS m, fraud_signal_count / 4.0::DOUBLE AS g
    FROM silver"""
_CTE["models"] = f"""
    SELECT model_run_id, fraud, 'amount' AS model_name, a AS score FROM members
    UNION ALL SELECT model_run_id, fraud, 'merchant', m FROM members
    UNION ALL SELECT model_run_id, fraud, 'signals', g FROM members
    UNION ALL SELECT model_run_id, fraud, 'ensemble', {rnd('((a + m + g) / 3.0)', 6)} FROM members"""


def _cuts(by: str) -> str:
    return f"""
        SELECT {by}, c.threshold, {when('fraud AND score >= c.threshold')} AS tp, {when('NOT fraud AND score >= c.threshold')} AS fp,
               {when('fraud AND NOT score >= c.threshold')} AS fn
        FROM models, (SELECT i / 100.0::DOUBLE AS threshold FROM range(5, 96) t(i)) c GROUP BY {by}, c.threshold"""


def _f1(by: str) -> str:
    return f"""
        SELECT {by}, threshold, f1 FROM (
          SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY f1 DESC, threshold) AS place
          FROM (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cuts_{len(by.split(','))}))
        WHERE place = 1"""


def _ranks(by: str) -> str:
    n = len(by.split(","))
    return f"""
        SELECT {by},
               {rnd('(1.0 - sum(pos * (2 * q0 + neg))::DOUBLE / nullif(2 * sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0))', 4)} AS roc_auc,
               {rnd('(sum(pos * ((p0 + pos)::DOUBLE / (p0 + pos + q0 + neg))) / nullif(sum(pos), 0)::DOUBLE)', 4)} AS average_precision
        FROM (SELECT *, coalesce(sum(pos) OVER w, 0) AS p0, coalesce(sum(neg) OVER w, 0) AS q0 FROM hist_{n}
              WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        GROUP BY {by}"""


for _by in ("model_name", "model_run_id, model_name"):
    _n = len(_by.split(","))
    _CTE[f"cuts_{_n}"] = _cuts(_by)
    _CTE[f"f1_{_n}"] = _f1(_by)
    _CTE[f"hist_{_n}"] = f"SELECT {_by}, score, {when('fraud')} AS pos, {when('NOT fraud')} AS neg FROM models GROUP BY {_by}, score"
    _CTE[f"ranks_{_n}"] = _ranks(_by)

_CTE["plain"] = """
    SELECT coalesce(is_fraud, FALSE) AS fraud, unnest(['amount', 'speed', 'busy']) AS model_name,
           unnest([CAST(amount AS DOUBLE) / 7000.0::DOUBLE,
                   1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + coalesce(seconds_since_prior_txn, 0)::DOUBLE),
                   CAST(amount AS DOUBLE) / (1.0::DOUBLE + txn_count_24h::DOUBLE)]) AS score
    FROM silver"""
_CTE["hist_plain"] = f"SELECT model_name, score, {when('fraud')} AS pos, {when('NOT fraud')} AS neg FROM plain GROUP BY model_name, score"
_CTE["ranks_plain"] = _ranks("model_name").replace("hist_1", "hist_plain")
_CTE["folds"] = """
    SELECT transaction_id, coalesce(is_fraud, FALSE) AS fraud, amount, merchant_risk_score, fraud_signal_count,
           CAST((row_number() OVER (PARTITION BY coalesce(is_fraud, FALSE) ORDER BY md5(concat(transaction_id, ':', '42')), transaction_id) - 1) % 5 AS INTEGER) AS fold
    FROM silver"""
_CTE["fold_models"] = f"""
    SELECT fold, fraud, 'amount' AS model_name, {rnd('(CAST(amount AS DOUBLE) / 1000.0)', 6)} AS score FROM folds
    UNION ALL SELECT fold, fraud, 'merchant', merchant_risk_score FROM folds
    UNION ALL SELECT fold, fraud, 'signals', fraud_signal_count / 4.0::DOUBLE FROM folds"""
_CTE["fold_hist"] = f"SELECT model_name, fold, score, {when('fraud')} AS pos, {when('NOT fraud')} AS neg FROM fold_models GROUP BY ALL"
_CTE["fold_areas"] = _ranks("model_name, fold").replace("hist_2", "fold_hist").replace("AS DECIMAL(38,10)), 4)", "AS DECIMAL(38,10)), 8)")
_CTE["model_metrics"] = f"""
    SELECT r.model_run_id, r.model_name, r.roc_auc AS holdout_roc_auc, f.threshold AS decision_threshold,
           {rnd('(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END)', 4)} AS holdout_precision,
           {rnd('(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END)', 4)} AS holdout_recall,
           {rnd('f.f1', 4)} AS holdout_f1, runs.* EXCLUDE model_run_id, r.model_run_id AS trained_at
    FROM ranks_2 r JOIN f1_2 f ON r.model_run_id = f.model_run_id AND r.model_name = f.model_name
    JOIN cuts_2 c ON c.model_run_id = f.model_run_id AND c.model_name = f.model_name AND c.threshold = f.threshold
    JOIN (SELECT strftime(date_trunc('week', dt), '%Y-%m-%d') AS model_run_id, count(*) AS training_rows,
                 count(confirmed_is_fraud) AS feedback_labels_confirmed,
                 {when('confirmed_is_fraud <> is_fraud')} AS feedback_labels_changed
          FROM silver LEFT JOIN confirmed USING (transaction_id) GROUP BY 1) runs ON runs.model_run_id = r.model_run_id"""

# --- an ensemble of deterministic members, judged on held-out rows ------------------------
_CTE["side"] = f"""
    SELECT transaction_id, dt, fraud, a, m, g, (0.0::DOUBLE + a + m + g) / 3.0::DOUBLE AS e, place > n - ceil(n * 0.25) AS in_holdout
    FROM (SELECT transaction_id, dt, coalesce(is_fraud, FALSE) AS fraud, {rnd('(CAST(amount AS DOUBLE) / 1000.0)', 6)} AS a,
                 merchant_risk_score AS m, fraud_signal_count / 4.0::DOUBLE AS g,
                 count(*) OVER (PARTITION BY coalesce(is_fraud, FALSE)) AS n,
                 row_number() OVER (PARTITION BY coalesce(is_fraud, FALSE) ORDER BY md5(concat(transaction_id, ':', '42')), transaction_id) AS place
          FROM silver)"""
_CTE["upto"] = "SELECT unnest([DATE '2024-01-17', DATE '2024-01-24', DATE '2024-01-31']) AS upto"
_CTE["side_runs"] = "SELECT strftime(upto, '%Y-%m-%d') AS model_run_id, side.* FROM side JOIN upto ON dt <= upto"
_CTE["side_cut"] = f"""
    SELECT model_run_id, threshold FROM (
      SELECT *, row_number() OVER (PARTITION BY model_run_id ORDER BY f1 DESC, threshold) AS place
      FROM (SELECT model_run_id, c.threshold, coalesce(2.0::DOUBLE * {when('fraud AND e >= c.threshold')}
                   / nullif(2 * {when('fraud AND e >= c.threshold')} + {when('NOT fraud AND e >= c.threshold')} + {when('fraud AND NOT e >= c.threshold')}, 0), 0) AS f1
            FROM side_runs, (SELECT i / 100.0::DOUBLE AS threshold FROM range(5, 96) t(i)) c
            WHERE NOT in_holdout GROUP BY model_run_id, c.threshold)) WHERE place = 1"""
_CTE["side_long"] = """
    SELECT model_run_id, fraud, unnest(['amount', 'merchant', 'signals', 'ensemble']) AS model_name, unnest([a, m, g, e]) AS score
    FROM side_runs WHERE in_holdout"""
_CTE["side_hist"] = f"SELECT model_run_id, model_name, score, {when('fraud')} AS pos, {when('NOT fraud')} AS neg FROM side_long GROUP BY ALL"
_CTE["side_ranks"] = _ranks("model_run_id, model_name").replace("hist_2", "side_hist")
_CTE["side_rated"] = f"""
    SELECT r.model_run_id, r.model_name, r.roc_auc AS holdout_roc_auc, r.average_precision AS holdout_average_precision,
           {rnd('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)', 4)} AS holdout_precision,
           {rnd('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)', 4)} AS holdout_recall,
           {rnd('coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)', 4)} AS holdout_f1, d.threshold AS decision_threshold
    FROM side_ranks r JOIN (
      SELECT l.model_run_id, model_name, min(threshold) AS threshold, {when('fraud AND score >= threshold')} AS tp, {when('NOT fraud AND score >= threshold')} AS fp,
             {when('fraud AND NOT score >= threshold')} AS fn
      FROM side_long l JOIN side_cut c ON l.model_run_id = c.model_run_id GROUP BY 1, 2) d
    ON d.model_run_id = r.model_run_id AND d.model_name = r.model_name"""
_CTE["side_fed"] = f"""
    SELECT strftime(upto, '%Y-%m-%d') AS model_run_id, upto, count(*) AS feedback_rows, count(s.transaction_id) AS labels_confirmed,
           {when('s.transaction_id IS NOT NULL AND c.confirmed_is_fraud IS DISTINCT FROM s.is_fraud')} AS labels_changed
    FROM upto CROSS JOIN confirmed c LEFT JOIN silver s ON s.transaction_id = c.transaction_id AND s.dt <= upto GROUP BY 2"""
_CTE["recent_risk"] = _CTE["risk"].replace("FROM silver", "FROM silver WHERE dt >= DATE '2024-01-17'")

# --- state -------------------------------------------------------------------------------
_CTE["readable"] = """
    SELECT customer_id, coalesce(epoch(try_cast(timestamp AS TIMESTAMP)), epoch(CAST(ingest_timestamp AS TIMESTAMP))) AS t,
           try_cast(amount AS DOUBLE) AS a
    FROM raw WHERE customer_id <> '' AND try_cast(amount AS DOUBLE) IS NOT NULL"""
_CTE["live"] = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY t DESC, a DESC) AS age
                   FROM readable WHERE {NOW} - t <= 2592000) WHERE age <= 60"""
_CTE["online"] = f"""
    SELECT customer_id, {when(f'{NOW} - t <= 3600')} + 1 AS txn_count_1h, {when(f'{NOW} - t <= 86400')} + 1 AS txn_count_24h,
           coalesce(sum(CASE WHEN {NOW} - t <= 3600 THEN a END), 0)::DOUBLE AS amount_sum_1h,
           coalesce(sum(CASE WHEN {NOW} - t <= 86400 THEN a END), 0)::DOUBLE AS amount_sum_24h,
           count(*) AS prior_txn_count_30d, {NOW} - max(t) AS seconds_since_prior_txn,
           CASE WHEN count(*) >= 3 THEN avg(a) END AS amount_mean_30d,
           CASE WHEN count(*) >= 3 AND stddev_samp(a) > 0 THEN stddev_samp(a) END AS amount_stddev_30d
    FROM live GROUP BY customer_id"""

_CTE["online_exact"] = _CTE["online"].replace("FROM live", f"FROM readable WHERE {NOW} - t <= 2592000").replace("count(*) AS prior_txn_count_30d", "count(*) > 60 AS truncated, count(*) AS prior_txn_count_30d")

_NEEDS: dict[str, list[str]] = {
    "raw": [], "flagged": ["raw"], "valid": ["flagged"], "bronze": ["valid"], "timed": ["bronze"],
    "velocity": ["timed"], "based": ["velocity"], "scored": ["based"], "lagged": ["scored"],
    "placed": ["lagged"], "history": ["placed"], "dim": ["bronze"], "silver": ["history", "dim"],
    "early": ["bronze"], "early_dim": ["early"], "metrics": ["silver"], "risk": ["silver"],
    "value": ["silver"], "confirmed": [], "members": ["silver"], "models": ["members"],
    "cuts_1": ["models"], "f1_1": ["cuts_1"], "hist_1": ["models"], "ranks_1": ["hist_1"],
    "cuts_2": ["models"], "f1_2": ["cuts_2"], "hist_2": ["models"], "ranks_2": ["hist_2"],
    "model_metrics": ["ranks_2", "f1_2", "cuts_2", "confirmed", "silver"],
    "plain": ["silver"], "hist_plain": ["plain"], "ranks_plain": ["hist_plain"],
    "folds": ["silver"], "fold_models": ["folds"], "fold_hist": ["fold_models"], "fold_areas": ["fold_hist"],
    "side": ["silver"], "upto": [], "side_runs": ["side", "upto"], "side_cut": ["side_runs"], "side_long": ["side_runs"],
    "side_hist": ["side_long"], "side_ranks": ["side_hist"], "side_rated": ["side_ranks", "side_cut"],
    "side_fed": ["upto", "confirmed", "silver"], "recent_risk": ["silver"],
    "readable": ["raw"], "live": ["readable"], "online": ["live"], "online_exact": ["readable"],
}


def _with(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in _NEEDS[name]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return select
    # Read several times by one query, so computed once.
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_CTE[n]})" for n in order) + "\n" + select


def _rows(select: str, *rules: tuple[str, str, str]) -> str:
    """One line per quality rule: name, measured number, condition on it."""
    lines = [
        f"SELECT '{name}' AS rule, CAST(({actual}) AS DOUBLE) AS actual, '{test}' AS test" for name, actual, test in rules
    ]
    body = "\nUNION ALL ".join(lines)
    return f"""SELECT '{select}' AS layer, rule, actual,
        CASE WHEN (test = 'zero' AND actual = 0) OR (test = 'some' AND actual > 0) OR (test NOT IN ('zero','some') AND actual > try_cast(test AS DOUBLE))
             THEN 'Passed' ELSE 'Failed' END AS outcome FROM ({body})"""


def _bad(table: str, cond: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {cond}"


def _repeats(table: str, keys: str) -> str:
    return f"SELECT count(*) FROM (SELECT {keys} FROM {table} GROUP BY {keys} HAVING count(*) > 1)"


def _null(table: str, column: str) -> tuple[str, str, str]:
    return (f"IsComplete {column}", _bad(table, f"{column} IS NULL"), "zero")


_CHANNELS = ",".join(CHANNELS)
_QUALITY_BRONZE = _rows(
    "bronze",
    ("References merchant_id", "SELECT count(*) FROM bronze WHERE merchant_id NOT IN (SELECT merchant_id FROM early_dim)", "zero"),
    *[_null("bronze", c) for c in ("transaction_id", "customer_id", "merchant_id", "transaction_timestamp", "amount")],
    ("IsUnique transaction_id", _repeats("bronze", "transaction_id"), "zero"),
    ("ColumnValues amount between 0.01 and 25000.0 inclusive", _bad("bronze", "NOT coalesce(amount BETWEEN 0.01 AND 25000, FALSE)"), "zero"),
    (f"ColumnValues channel in {_CHANNELS}", _bad("bronze", "channel NOT IN ('card_present','ecommerce','contactless','recurring')"), "zero"),
    ("ColumnValues lat between -90 and 90 inclusive", _bad("bronze", "NOT lat BETWEEN -90 AND 90"), "zero"),
    ("ColumnValues lon between -180 and 180 inclusive", _bad("bronze", "NOT lon BETWEEN -180 AND 180"), "zero"),
    ("Completeness currency > 0.99", "SELECT count(currency)::DOUBLE / count(*) FROM bronze", "0.99"),
    ("Fresh transaction_timestamp within 3h", _bad("bronze", f"transaction_timestamp > {AS_OF} - INTERVAL 3 HOUR"), "some"),
    ("RowCount > 0", "SELECT count(*) FROM bronze", "some"),
)
_QUALITY_SILVER = _rows(
    "silver",
    *[_null("silver", c) for c in ("transaction_id", "txn_count_1h", "txn_count_24h", "merchant_risk_score", "fraud_signal_count", "is_high_velocity")],
    ("IsUnique transaction_id", _repeats("silver", "transaction_id"), "zero"),
    ("ColumnValues txn_count_1h >= 1", _bad("silver", "NOT coalesce(txn_count_1h >= 1, FALSE)"), "zero"),
    ("ColumnValues txn_count_24h >= 1", _bad("silver", "NOT coalesce(txn_count_24h >= 1, FALSE)"), "zero"),
    ("Completeness amount_zscore_30d > 0.3", "SELECT count(amount_zscore_30d)::DOUBLE / count(*) FROM silver", "0.3"),
    ("ColumnValues merchant_risk_score between -0.001 and 1.001 exclusive", _bad("silver", "NOT coalesce(merchant_risk_score > -0.001 AND merchant_risk_score < 1.001, FALSE)"), "zero"),
    ("ColumnValues merchant_risk_tier in low,medium,high,unknown", _bad("silver", "NOT coalesce(merchant_risk_tier IN ('low','medium','high','unknown'), FALSE)"), "zero"),
    ("Never negative distance", _bad("silver", "geo_distance_from_prior_km < 0"), "zero"),
    ("ColumnValues fraud_signal_count between -1 and 5 exclusive", _bad("silver", "NOT coalesce(fraud_signal_count > -1 AND fraud_signal_count < 5, FALSE)"), "zero"),
    ("RowCount > 0", "SELECT count(*) FROM silver", "some"),
)
_QUALITY_GOLD = _rows(
    "gold",
    *[_null("metrics", c) for c in ("dt", "transaction_count")],
    ("ColumnValues transaction_count > 0", _bad("metrics", "NOT coalesce(transaction_count > 0, FALSE)"), "zero"),
    ("ColumnValues fraud_rate_pct between -0.001 and 100.001 exclusive", _bad("metrics", "NOT coalesce(fraud_rate_pct > -0.001 AND fraud_rate_pct < 100.001, FALSE)"), "zero"),
    ("ColumnValues approval_rate_pct between -0.001 and 100.001 exclusive", _bad("metrics", "NOT coalesce(approval_rate_pct > -0.001 AND approval_rate_pct < 100.001, FALSE)"), "zero"),
    ("ColumnValues fraud_loss_amount_usd >= 0", _bad("metrics", "NOT coalesce(fraud_loss_amount_usd >= 0, FALSE)"), "zero"),
    ("ColumnValues total_amount_usd >= 0", _bad("metrics", "NOT coalesce(total_amount_usd >= 0, FALSE)"), "zero"),
    ("IsUnique dt,mcc,channel", _repeats("metrics", "dt, mcc, channel"), "zero"),
    ("RowCount > 0", "SELECT count(*) FROM metrics", "some"),
)

_DAILY_SUMS = "CAST(sum(transaction_count) AS BIGINT) AS transaction_count, CAST(sum(fraud_transaction_count) AS BIGINT) AS fraud_transaction_count"
_RATE3 = pct("sum(fraud_transaction_count)", "sum(transaction_count)", 3)
_BRONZE_OUT = f"""SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount, {stamp('transaction_timestamp')} AS transaction_timestamp,
    {stamp('ingest_timestamp')} AS ingest_timestamp) FROM"""


def _feature_matrix() -> str:
    made = []
    for name in NUMERIC:
        value = f"coalesce(CAST({name} AS DOUBLE), 0)"
        if name in CEILINGS:
            value = f"least({value}, {CEILINGS[name]})"
        made.append(f"CAST({name} IS NULL AS DOUBLE) AS {name}_missing, CAST({value} AS DOUBLE) AS {name}")
    made += [f"CAST(coalesce({flag}, FALSE) AS DOUBLE) AS {flag}" for flag in FLAGS]
    made += [f"CAST(coalesce(channel = '{c}', FALSE) AS DOUBLE) AS channel_{c}" for c in CHANNELS]
    return "SELECT transaction_id, " + ", ".join(made) + ", CAST(coalesce(is_fraud, FALSE) AS DOUBLE) AS label FROM silver"


_STATE_TEXT = """SELECT customer_id,
    string_agg(concat(CAST(round(t * 1000) AS BIGINT), ':', CAST(round(a * 100) AS BIGINT)), ',' ORDER BY t, a) AS events
    FROM live GROUP BY customer_id"""

_NEAREST = """
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
    scored AS (SELECT query_id, vec_id AS item_id, list_cosine_similarity(embedding::DOUBLE[], v) AS exact FROM embeddings, q),
    nearest AS (SELECT query_id, CAST(rank AS INT) AS rank, item_id, {score} AS score
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, item_id) AS rank FROM scored) WHERE rank <= 5)
""".format(score=rnd("exact", 4))


_QUARANTINED = """SELECT * EXCLUDE reasons, array_to_string(reasons, ',') AS rejection_reason,
    CAST(coalesce(try_cast(timestamp AS TIMESTAMP), try_cast(ingest_timestamp AS TIMESTAMP)) AS DATE) AS dt
    FROM flagged WHERE len(reasons) > 0"""
_STAMPED = "'2024-01-31 00:00:00.000'"
_MODEL_INPUT = ", ".join(
    {"amount": "CAST(amount AS DOUBLE) AS amount", "transaction_timestamp": f"{stamp('transaction_timestamp')} AS transaction_timestamp"}.get(c, c)
    for c in MODEL_INPUT
)


def _verdict(layer: str, outcomes: str) -> str:
    failed = when("outcome = 'Failed'")
    return f"""SELECT '{layer}' AS layer, {failed} = 0 AS passed, {pct(when("outcome = 'Passed'"), 'count(*)', 2)} AS pass_rate_pct,
        {failed} AS failed_count, count(*) AS total_rules,
        coalesce(string_agg(rule, ';' ORDER BY rule) FILTER (WHERE outcome = 'Failed'), '') AS failed_rules FROM ({outcomes})"""


def _stored() -> dict[str, str]:
    return {
        "lake_raw": _with("SELECT * FROM raw", "raw"),
        "lake_arrival_day": _with("SELECT * FROM raw WHERE CAST(CAST(ingest_timestamp AS TIMESTAMP) AS DATE) = DATE '2024-01-12'", "raw"),
        "lake_quarantine": _with(_QUARANTINED, "flagged"),
        "lake_bronze": _with(f"{_BRONZE_OUT} bronze", "bronze"),
        "lake_recent_input": _with(f"SELECT {_MODEL_INPUT} FROM silver WHERE dt >= DATE '2024-01-24'", "silver"),
        "lake_daily_metrics": _with(f"SELECT *, {_STAMPED} AS gold_computed_at FROM metrics", "metrics"),
        "lake_merchant_dim": _with(f"SELECT *, {_STAMPED} AS dim_computed_at FROM dim", "dim"),
        "lake_feedback": """SELECT concat('T', CAST(doc_id AS VARCHAR)) AS transaction_id, toxic = 1 AS confirmed_is_fraud, '2024-02-01T00:00:00Z' AS confirmed_at
            FROM labels UNION ALL SELECT concat('T', CAST(doc_id AS VARCHAR)), quality = 0, '2024-02-02T00:00:00Z' FROM labels""",
        "lake_days_overwritten": _with(
            """SELECT * FROM metrics WHERE dt < DATE '2024-01-20'
               OR (dt <> DATE '2024-01-25' AND channel <> 'recurring')""",
            "metrics",
        ),
        "lake_merchant_snapshot": _with(f"SELECT *, {_STAMPED} AS gold_computed_at FROM recent_risk", "recent_risk"),
        "lake_model_history": _with(
            f"""SELECT r.*, strftime(upto, '%Y-%m-%d 00:00:00.000') AS trained_at, n AS training_rows,
                {pct('p', 'n', 4)} AS fraud_rate_in_training_pct, feedback_rows,
                labels_confirmed AS feedback_labels_confirmed, labels_changed AS feedback_labels_changed
                FROM side_rated r JOIN side_fed f ON f.model_run_id = r.model_run_id
                JOIN (SELECT model_run_id, count(*) AS n, {when('fraud')} AS p FROM side_runs GROUP BY 1) t ON t.model_run_id = r.model_run_id""",
            "side_rated",
            "side_fed",
        ),
        "gate_verdicts": _with(
            "\nUNION ALL ".join(
                [
                    _verdict("bronze, first run", f"SELECT * FROM ({_QUALITY_BRONZE}) WHERE rule <> 'References merchant_id'"),
                    _verdict("bronze", _QUALITY_BRONZE),
                    _verdict("silver", _QUALITY_SILVER),
                    _verdict("gold", _QUALITY_GOLD),
                    "SELECT 'absent', FALSE, 0.0::DOUBLE, -1, 0, 'report_available'",
                ]
            ),
            "early_dim",
            "metrics",
        ),
        "landing_kinds": _with(
            """SELECT CASE WHEN transaction_id LIKE '%7' THEN 'errors' ELSE 'raw' END AS kind,
               CAST(CAST(ingest_timestamp AS TIMESTAMP) AS DATE) AS ingest_dt, count(*) AS lines FROM raw GROUP BY 1, 2""",
            "raw",
        ),
        "ensemble_decisions": _with(
            f"""SELECT transaction_id, in_holdout, a AS amount, m AS merchant, g AS signals, {rnd('e', 6)} AS ensemble_fraud_score,
                e >= (SELECT threshold FROM side_cut WHERE model_run_id = '2024-01-31') AS predicted_is_fraud, fraud AS actual_is_fraud FROM side""",
            "side_cut",
        ),
        "ensemble_holdout": _with(
            "SELECT * EXCLUDE model_run_id FROM side_rated WHERE model_run_id = '2024-01-31'", "side_rated"
        ),
    }


def oracle_sql() -> dict[str, str]:
    listing = """model_name, model_run_id, trained_at, training_rows, holdout_roc_auc, holdout_precision,
        holdout_recall, holdout_f1, feedback_labels_confirmed, feedback_labels_changed"""
    history = {
        "velocity_features": "txn_count_1h, txn_count_24h, amount_sum_1h, amount_sum_24h, distinct_merchants_24h",
        "amount_zscore": "amount_mean_30d, amount_stddev_30d, prior_txn_count_30d, amount_zscore_30d",
        "geo_features": "seconds_since_prior_txn, geo_distance_from_prior_km, implied_speed_kmh, device_change_flag",
    }
    early_day = "CAST(CAST(ingest_timestamp AS TIMESTAMP) AS DATE)"
    online = ", ".join(
        f"{rnd(c, 4)} AS {c}"
        for c in ("amount_sum_1h", "amount_sum_24h", "seconds_since_prior_txn", "amount_mean_30d", "amount_stddev_30d")
    )
    layered_flags = "CAST(is_high_velocity AS INT) + CAST(is_amount_outlier AS INT)"
    return _stored() | {
        "raw_rows_per_day": _with(f"SELECT {early_day} AS dt, count(*) AS records FROM raw GROUP BY 1", "raw"),
        "raw_fraud_mix": _with(
            f"""SELECT {early_day} AS dt, channel, count(*) AS transactions, {when("is_fraud = 'true'")} AS fraud_transactions,
                {pct(when("is_fraud = 'true'"), 'count(*)', 3)} AS fraud_pct FROM raw GROUP BY 1, 2""",
            "raw",
        ),
        "bronze_rejections": _with(
            'SELECT reason, count(*) AS "count" FROM (SELECT unnest(reasons) AS reason FROM flagged) GROUP BY reason', "flagged"
        ),
        "bronze_valid": _with(f"{_BRONZE_OUT} valid", "valid"),
        "bronze_quarantine": _with(
            _QUARANTINED,
            "flagged",
        ),
        "bronze_deduplicated": _with(f"{_BRONZE_OUT} bronze", "bronze"),
        "dedupe_latest": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
               strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC,
                         l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS copy
                  FROM lineitem) WHERE copy = 1""",
        "ingest_metrics": _with(
            f"""SELECT {when('len(reasons) = 0')} AS bronze_rows, {when('len(reasons) > 0')} AS quarantine_rows,
                {pct(when('len(reasons) > 0'), 'count(*)', 4)} AS quarantine_pct FROM flagged""",
            "flagged",
        ),
        "schema_version_mix": _with(
            "SELECT schema_version, count(*) AS records, count(auth_response_code) AS with_auth_code FROM bronze GROUP BY 1", "bronze"
        ),
        "schema_evolution": _with(
            """SELECT schema_version, count(*) AS records, count(code) AS with_auth_code
               FROM (SELECT schema_version, CASE WHEN schema_version = 2 THEN auth_response_code END AS code FROM bronze) GROUP BY 1""",
            "bronze",
        ),
        "replay_proof": _with('SELECT count(*) AS "rows", count(DISTINCT transaction_id) AS unique_ids FROM bronze', "bronze"),
        "upsert_transactions": _with(
            f"""SELECT transaction_id, CAST(amount + CASE WHEN batch THEN 1 ELSE 0 END AS DOUBLE) AS amount, schema_version,
                CASE WHEN batch THEN auth_response_code END AS auth_response_code, {stamp('ingest_timestamp')} AS ingest_timestamp
                FROM (SELECT *, dt >= DATE '2024-01-15' OR schema_version = 2 AS batch FROM bronze)""",
            "bronze",
        ),
        "upsert_replayed_table": _with(
            """SELECT transaction_id, CAST(amount + CASE WHEN batch THEN 1 ELSE 0 END AS DOUBLE) AS amount,
               CAST(dt + CASE WHEN batch AND CAST(substr(transaction_id, 2) AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS DATE) AS dt
               FROM (SELECT *, dt BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' AS batch FROM bronze)""",
            "bronze",
        ),
        "referential_orphans": _with(
            "SELECT merchant_id, count(*) AS rows_without_parent FROM bronze WHERE merchant_id NOT IN (SELECT merchant_id FROM early_dim) GROUP BY 1",
            "early_dim",
        ),
        **{name: _with(f"SELECT transaction_id, {cols} FROM history", "history") for name, cols in history.items()},
        "merchant_risk_scores": _with("SELECT * FROM dim", "dim"),
        "silver_signals": _with(
            """SELECT transaction_id, merchant_risk_score, merchant_risk_tier, is_high_velocity, is_amount_outlier,
               is_impossible_travel, device_change_flag, fraud_signal_count FROM silver""",
            "silver",
        ),
        "silver_unknown_merchants": _with(
            """SELECT transaction_id, coalesce(merchant_risk_score, 0.02::DOUBLE) AS merchant_risk_score,
               coalesce(merchant_risk_tier, 'unknown') AS merchant_risk_tier FROM bronze LEFT JOIN early_dim USING (merchant_id)""",
            "early_dim",
        ),
        "fraud_metrics_daily": _with("SELECT * FROM metrics", "metrics"),
        "merchant_risk": _with("SELECT * FROM risk", "risk"),
        "gold_summary": _with(
            f"""SELECT count(*) AS total_transactions, {when('is_fraud')} AS total_fraud, {money('CASE WHEN is_fraud THEN amount END')} AS total_loss_usd,
                {pct(when('is_fraud'), 'count(*)', 4)} AS fraud_rate_pct FROM silver""",
            "silver",
        ),
        "latest_partition": _with("SELECT max(dt) AS latest_partition FROM bronze", "bronze"),
        "feature_health": _with(
            "SELECT "
            + ", ".join(
                f"{rnd(f'avg(CAST({c} AS INT))', 6)} AS {n}"
                for n, c in {
                    "high_velocity_rate": "is_high_velocity",
                    "amount_outlier_rate": "is_amount_outlier",
                    "impossible_travel_rate": "is_impossible_travel",
                    "device_change_rate": "device_change_flag",
                    "fraud_rate": "is_fraud",
                }.items()
            )
            + " FROM silver",
            "silver",
        ),
        "signal_recall": _with(
            f"""SELECT {when('is_fraud')} AS fraud_rows, {when('is_fraud AND fraud_signal_count > 0')} AS fraud_rows_with_signal,
                {pct(when('is_fraud AND fraud_signal_count > 0'), when('is_fraud'), 4)} AS signal_recall_pct FROM silver""",
            "silver",
        ),
        "dash_daily": _with(
            f"SELECT dt, {_DAILY_SUMS}, {money('total_amount_usd')} AS total_amount_usd, {money('fraud_loss_amount_usd')} AS fraud_loss_amount_usd, {_RATE3} AS fraud_rate_pct FROM metrics GROUP BY dt",
            "metrics",
        ),
        "dash_channel": _with(f"SELECT channel, {_DAILY_SUMS}, {_RATE3} AS fraud_rate_pct FROM metrics GROUP BY channel", "metrics"),
        "dash_mcc_top8": _with(
            f"""SELECT mcc, CAST(sum(fraud_transaction_count) AS BIGINT) AS fraud_transaction_count, {money('fraud_loss_amount_usd')} AS fraud_loss_amount_usd
                FROM metrics GROUP BY mcc ORDER BY fraud_loss_amount_usd DESC, mcc LIMIT 8""",
            "metrics",
        ),
        "ops_tiles": _with(
            f"""SELECT count(*) AS transactions, {when('is_fraud')} AS fraud_transactions, {pct(when('is_fraud'), 'count(*)', 2)} AS fraud_rate_pct,
                {money('CASE WHEN is_fraud THEN amount END')} AS fraud_loss_usd, count(DISTINCT dt) AS days FROM silver""",
            "silver",
        ),
        "model_metrics": _with(f"SELECT {listing} FROM model_metrics", "model_metrics"),
        "model_leaderboard": _with(
            """SELECT model_name AS model, holdout_roc_auc AS roc_auc, holdout_precision AS "precision", holdout_recall AS recall, holdout_f1 AS f1
               FROM model_metrics WHERE model_run_id = (SELECT max(model_run_id) FROM model_metrics)""",
            "model_metrics",
        ),
        "auc_trend": _with(
            """SELECT model_name AS model, string_agg(concat(model_run_id, ':', coalesce(CAST(CAST(round(holdout_roc_auc * 10000) AS BIGINT) AS VARCHAR), 'none')), ',' ORDER BY model_run_id) AS trend
               FROM model_metrics GROUP BY model_name""",
            "model_metrics",
        ),
        "feedback_per_run": _with(
            """SELECT model_run_id AS run, min(training_rows) AS training_rows, min(feedback_labels_confirmed) AS labels_confirmed,
               min(feedback_labels_changed) AS labels_changed FROM model_metrics GROUP BY 1""",
            "model_metrics",
        ),
        "value_listing": _with("SELECT * EXCLUDE total_amount_usd FROM value", "value"),
        "business_tiles": _with(
            f"""SELECT {money('caught_fraud_amount_usd')} AS intercepted_usd, {money('missed_fraud_amount_usd')} AS missed_usd,
                {pct('sum(CAST(caught_fraud_amount_usd AS DECIMAL(12,2)))::DOUBLE', 'sum(CAST(actual_fraud_amount_usd AS DECIMAL(12,2)))::DOUBLE', 2)} AS dollar_capture_rate_pct,
                {pct('sum(caught_fraud_count)', 'sum(actual_fraud_count)', 2)} AS capture_rate_pct,
                {pct('sum(caught_fraud_count)', 'sum(flagged_count)', 2)} AS flag_precision_pct,
                CAST(sum(false_alarm_count) AS BIGINT) AS review_queue FROM value""",
            "value",
        ),
        "business_daily": _with(
            """SELECT dt, caught_fraud_amount_usd AS caught_usd, missed_fraud_amount_usd AS missed_usd, false_alarm_count AS false_alarms, capture_rate_pct FROM value""",
            "value",
        ),
        "mcc_period_over_period": _with(
            """SELECT r.mcc, r.n AS fraud_txns, p.n AS prior_fraud_txns
               FROM (SELECT mcc, CAST(sum(fraud_transaction_count) AS BIGINT) AS n FROM metrics WHERE dt >= DATE '2024-01-17' GROUP BY mcc) r
               LEFT JOIN (SELECT mcc, CAST(sum(fraud_transaction_count) AS BIGINT) AS n FROM metrics WHERE dt >= DATE '2024-01-03' AND dt < DATE '2024-01-17' GROUP BY mcc) p USING (mcc)""",
            "metrics",
        ),
        "metrics_join_risk": _with(
            """SELECT r.mcc, r.merchant_id, r.transaction_count, r.fraud_rate_pct, c.n AS category_transaction_count, c.f AS category_fraud_count, c.d AS category_last_day
               FROM risk r JOIN (SELECT mcc, CAST(sum(transaction_count) AS BIGINT) AS n, CAST(sum(fraud_transaction_count) AS BIGINT) AS f, max(dt) AS d FROM metrics GROUP BY mcc) c USING (mcc)""",
            "risk",
            "metrics",
        ),
        "gold_union": _with("SELECT mcc FROM metrics UNION ALL SELECT mcc FROM risk", "metrics", "risk"),
        "gold_union_distinct": _with("SELECT mcc FROM metrics UNION SELECT mcc FROM risk", "metrics", "risk"),
        "gold_except": _with("SELECT merchant_id FROM silver EXCEPT SELECT merchant_id FROM risk WHERE merchant_risk_tier = 'low'", "risk"),
        "gold_intersect": _with(
            "SELECT mcc, channel FROM metrics WHERE fraud_transaction_count > 0 INTERSECT SELECT mcc, channel FROM metrics WHERE approval_rate_pct < 100",
            "metrics",
        ),
        "recent_scored": _with(
            f"SELECT transaction_id, {stamp('ingest_timestamp')} AS ingest_timestamp, fraud_signal_count FROM (SELECT * FROM silver ORDER BY ingest_timestamp DESC, transaction_id LIMIT 100)",
            "silver",
        ),
        "gold_question": _with(
            """SELECT r.merchant_id, r.mcc, b.n AS category_transactions, r.fraud_rate_pct
               FROM risk r JOIN (SELECT mcc, CAST(sum(transaction_count) AS BIGINT) AS n FROM metrics GROUP BY mcc) b USING (mcc)
               WHERE r.fraud_transaction_count > 0 ORDER BY r.fraud_rate_pct DESC, r.merchant_id LIMIT 200""",
            "risk",
            "metrics",
        ),
        "gold_question_cut": _with(
            """SELECT merchant_id, mcc, category_transactions, fraud_rate_pct, CAST(place AS INTEGER) AS answer_row, held > 10 AS truncated
               FROM (SELECT r.merchant_id, r.mcc, b.n AS category_transactions, r.fraud_rate_pct, count(*) OVER () AS held,
                            row_number() OVER (ORDER BY r.fraud_rate_pct DESC, r.merchant_id) AS place
                     FROM risk r JOIN (SELECT mcc, CAST(sum(transaction_count) AS BIGINT) AS n FROM metrics GROUP BY mcc) b USING (mcc)
                     WHERE r.fraud_transaction_count > 0) WHERE place <= 10""",
            "risk",
            "metrics",
        ),
        "analyst_view": _with("SELECT * EXCLUDE (distinct_customer_count, total_fraud_signals) FROM metrics", "metrics"),
        "analyst_risk_view": _with("SELECT * EXCLUDE (distinct_customer_count, merchant_risk_score) FROM risk", "risk"),
        "quality_bronze": _with(_QUALITY_BRONZE, "early_dim"),
        "quality_silver": _with(_QUALITY_SILVER, "silver"),
        "quality_gold": _with(_QUALITY_GOLD, "metrics"),
        "quality_report": _with(
            f"""SELECT 'bronze' AS layer, count(*) AS total_rules, {when("outcome = 'Passed'")} AS passed_count, {when("outcome = 'Failed'")} AS failed_count,
                {pct(when("outcome = 'Passed'"), 'count(*)', 2)} AS pass_rate_pct, {when("outcome = 'Failed'")} = 0 AS passed,
                coalesce(string_agg(rule, ';' ORDER BY rule) FILTER (WHERE outcome = 'Failed'), '') AS failed_rules FROM ({_QUALITY_BRONZE})""",
            "early_dim",
        ),
        "health_checks": _with(
            f"""SELECT 'fresh_rows' AS "check", n::DOUBLE AS "value", n = 0 AS alarm
                FROM (SELECT {when(f'transaction_timestamp > {AS_OF} - INTERVAL 3 HOUR')} AS n FROM bronze)
                UNION ALL SELECT 'ensemble_auc', holdout_roc_auc, coalesce(holdout_roc_auc < 0.80, FALSE) FROM model_metrics
                WHERE model_name = 'ensemble' AND model_run_id = (SELECT max(model_run_id) FROM model_metrics)
                UNION ALL SELECT 'quarantine_pct', p, p > 5 FROM (SELECT {pct(when('len(reasons) > 0'), 'count(*)', 4)} AS p FROM flagged)""",
            "model_metrics",
            "flagged",
        ),
        "feedback_labels": _with(
            "SELECT transaction_id, coalesce(confirmed_is_fraud, is_fraud) AS is_fraud FROM bronze LEFT JOIN confirmed USING (transaction_id)",
            "bronze",
            "confirmed",
        ),
        "feedback_stats": _with(
            f"""SELECT count(*) AS feedback_rows, count(b.transaction_id) AS labels_confirmed, {when('b.transaction_id IS NOT NULL AND confirmed_is_fraud IS DISTINCT FROM is_fraud')} AS labels_changed
                FROM confirmed c LEFT JOIN bronze b ON b.transaction_id = c.transaction_id""",
            "bronze",
            "confirmed",
        ),
        "fraud_value_daily": _with("SELECT * FROM value", "value"),
        "online_state": _with(_STATE_TEXT, "live"),
        "online_features": _with(f"SELECT customer_id, txn_count_1h, txn_count_24h, prior_txn_count_30d, {online} FROM online", "online"),
        "online_features_exact": _with(f"SELECT customer_id, txn_count_1h, txn_count_24h, prior_txn_count_30d, truncated, {online} FROM online_exact", "online_exact"),
        "layered_features": _with(
            f"""SELECT * REPLACE ({rnd('amount_zscore_30d', 4)} AS amount_zscore_30d, {rnd('amount_sum_1h', 4)} AS amount_sum_1h,
                       {rnd('amount_sum_24h', 4)} AS amount_sum_24h, {rnd('seconds_since_prior_txn', 4)} AS seconds_since_prior_txn),
                       {layered_flags} AS fraud_signal_count
                FROM (SELECT *, txn_count_1h >= 5 OR txn_count_24h >= 20 AS is_high_velocity,
                             coalesce(abs(amount_zscore_30d) >= 3, FALSE) AS is_amount_outlier, FALSE AS is_impossible_travel
                      FROM (SELECT n.customer_id, n.transaction_id, n.amount, n.channel,
                                   coalesce(o.txn_count_1h, 1) AS txn_count_1h, coalesce(o.txn_count_24h, 1) AS txn_count_24h,
                                   coalesce(o.amount_sum_1h, n.amount) AS amount_sum_1h, coalesce(o.amount_sum_24h, n.amount) AS amount_sum_24h,
                                   CAST(greatest(1, floor(coalesce(o.txn_count_24h, 1) / 2)) AS BIGINT) AS distinct_merchants_24h,
                                   (n.amount - o.amount_mean_30d) / o.amount_stddev_30d AS amount_zscore_30d,
                                   coalesce(o.prior_txn_count_30d, 0) AS prior_txn_count_30d, 0.02::DOUBLE AS merchant_risk_score,
                                   NULL::DOUBLE AS geo_distance_from_prior_km, NULL::DOUBLE AS implied_speed_kmh,
                                   o.seconds_since_prior_txn, FALSE AS device_change_flag
                            FROM (SELECT customer_id, max(transaction_id) AS transaction_id, CAST(max(amount) AS DOUBLE) AS amount, max(channel) AS channel
                                  FROM bronze GROUP BY customer_id) n LEFT JOIN online o USING (customer_id)))""",
            "bronze",
            "online",
        ),
        "feature_matrix": _with(_feature_matrix(), "silver"),
        "stratified_split": _with(
            """SELECT transaction_id, place > n - ceil(n * 0.25) AS in_holdout
               FROM (SELECT transaction_id, count(*) OVER (PARTITION BY coalesce(is_fraud, FALSE)) AS n,
                            row_number() OVER (PARTITION BY coalesce(is_fraud, FALSE) ORDER BY md5(concat(transaction_id, ':', '42')), transaction_id) AS place
                     FROM bronze)""",
            "bronze",
        ),
        "temporal_split": _with(
            """SELECT transaction_id, place > floor(n * 0.75) AS in_holdout
               FROM (SELECT transaction_id, count(*) OVER () AS n, row_number() OVER (ORDER BY transaction_timestamp, transaction_id) AS place FROM bronze)""",
            "bronze",
        ),
        "threshold_f1": _with(f"SELECT model_name, threshold, {rnd('f1', 6)} AS f1 FROM f1_1", "f1_1"),
        "threshold_cost": _with(
            """SELECT model_name, threshold, cost FROM (
                 SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY cost, threshold) AS place
                 FROM (SELECT *, CAST(1.0 * fp + 20.0 * fn AS DOUBLE) AS cost FROM cuts_1)) WHERE place = 1""",
            "cuts_1",
        ),
        "auc_ap": _with("SELECT * FROM ranks_1", "ranks_1"),
        "auc_ap_exact": _with("SELECT * FROM ranks_plain", "ranks_plain"),
        "cv_folds": _with("SELECT transaction_id, fold FROM folds", "folds"),
        "cv_auc": _with(
            f"""SELECT model_name, count(roc_auc) AS folds, {rnd('avg(roc_auc)', 4)} AS cv_auc_mean,
                {rnd('stddev_pop(roc_auc)', 4)} AS cv_auc_std FROM fold_areas GROUP BY 1""",
            "fold_areas",
        ),
        "passage_chunks": r"""
            WITH w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
            n AS (SELECT *, len(words) AS n FROM w WHERE len(words) > 0),
            s AS (SELECT *, unnest(range(0, CAST(greatest(ceil((n - 300) / 240.0), 0) AS BIGINT) + 1)) AS k FROM n)
            SELECT doc_id, source, CAST(k AS INT) AS chunk_no, array_to_string(words[k * 240 + 1 : k * 240 + 300], ' ') AS chunk,
                   CAST(len(words[k * 240 + 1 : k * 240 + 300]) AS INT) AS n_tokens FROM s""",
        "stream_landing": _with(
            f"""SELECT {early_day} AS ingest_dt, count(*) AS records, count(timestamp) AS with_time,
                count(auth_response_code) AS with_code FROM raw GROUP BY 1""",
            "raw",
        ),
        "stream_runs": _with(
            f"""SELECT DISTINCT {early_day} AS partition, {stamp("time_bucket(INTERVAL '15 minutes', CAST(ingest_timestamp AS TIMESTAMP))")} AS bucket FROM raw""",
            "raw",
        ),
        "stream_bronze": _with(f"{_BRONZE_OUT} bronze", "bronze"),
        "stream_customer_state": _with(_STATE_TEXT, "live"),
        "topk_cosine": _NEAREST + "SELECT * FROM nearest",
        "citations": _NEAREST
        + """SELECT query_id, rank, concat('[', rank, '] source: ', coalesce(source, 'null'), ' (relevance ', score, ')') AS citation, score
             FROM nearest LEFT JOIN documents ON doc_id = item_id""",
    }
