"""Runs queries on Spark and DuckDB and compares them as unordered row sets.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def differences(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs first."""
    frame = entry.queries()[name](spark, sf_dir)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(set(columns) ^ set(frame.columns))}"
    ours = rows_of(frame.columns, frame.collect())
    theirs = rows_of(columns, result.fetchall())
    types = {c: (t, kinds[c]) for c, t in frame.dtypes if KINDS.get(t) != kinds[c]}
    if ours != theirs:
        left, right = list((ours - theirs).items()), list((theirs - ours).items())
        return f"{len(left)} rows only in spark, {len(right)} only in sql of {sum(theirs.values())}:\n  {left[:2]}\n  {right[:2]}"
    return f"types {types}" if types else None


if __name__ == "__main__":
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.oracle_sql())
    spark = make_session("local[8]", "8")
    con = connect(sf_dir)
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            found = differences(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{len(chosen) - failed}/{len(chosen)} equal")
