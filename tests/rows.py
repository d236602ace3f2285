"""Hand-made rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from txnrisk import schemas as S

START = datetime(2026, 3, 1, 12, 0, 0)

CLEAN = {
    "transaction_id": "T1",
    "customer_id": "CUST1",
    "merchant_id": "MER1",
    "mcc": "5411",
    "amount": "42.50",
    "currency": "USD",
    "timestamp": START.isoformat(),
    "lat": "40.7128",
    "lon": "-74.0060",
    "device_id": "DEV1",
    "channel": "ecommerce",
    "is_fraud": "false",
    "ingest_timestamp": START.isoformat(),
    "schema_version": "1",
    "anomaly_type": None,
    "auth_response_code": None,
}


def raw(spark, *changes: dict):
    return spark.createDataFrame([tuple({**CLEAN, **c}[name] for name in S.RAW_COLUMNS) for c in changes], S.RAW)


def bronze(spark, *changes: dict):
    """Typed rows; ``minutes`` or ``seconds`` place a row after START, ``amount`` may be a number."""
    from txnrisk.operators.bronze import clean_rows

    rows = []
    for i, change in enumerate(changes):
        change = dict(change)
        at = START + timedelta(minutes=change.pop("minutes", 0), seconds=change.pop("seconds", 0))
        stamped = {"transaction_id": f"T{i + 1:04d}", "timestamp": at.isoformat(), "ingest_timestamp": at.isoformat()}
        rows.append({**stamped, **{k: None if v is None else str(v) for k, v in change.items()}})
    return clean_rows(raw(spark, *rows))


def by_id(df, *columns: str) -> dict:
    picked = df.select("transaction_id", *columns).collect()
    return {r["transaction_id"]: (r[1] if len(columns) == 1 else tuple(r)[1:]) for r in picked}
