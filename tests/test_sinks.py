from __future__ import annotations

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.rows import CLEAN, by_id, raw
from txnrisk import schemas as S
from txnrisk.operators import monitor as M
from txnrisk.plans import medallion as P
from txnrisk.sources import readers, scratch, writers

KEYED = "transaction_id string, dt date, v int"


def table(spark, *rows):
    return spark.createDataFrame([(i, date(2026, 3, d), v) for i, d, v in rows], KEYED)


def test_upsert_replaces_inserts_and_is_idempotent(spark, folder):
    path = f"{folder}/t"
    writers.upsert_table(table(spark, ("A", 1, 1), ("B", 1, 1)), path, ["transaction_id"])
    change = table(spark, ("B", 2, 9), ("C", 2, 3))
    for _ in range(2):
        writers.upsert_table(change, path, ["transaction_id"])
        assert by_id(spark.read.parquet(path), "v") == {"A": 1, "B": 9, "C": 3}
    assert by_id(spark.read.parquet(path), "dt")["B"] == date(2026, 3, 2)  # moved, not duplicated


def test_older_rows_do_not_replace_newer_ones(spark):
    standing, late = table(spark, ("A", 1, 5)), table(spark, ("A", 1, 4), ("N", 1, 1))
    assert by_id(writers.upsert(standing, late, ["transaction_id"], newer_by="v"), "v") == {"A": 5, "N": 1}


def test_schema_grows_and_old_rows_are_null(spark, folder):
    path = f"{folder}/t"
    writers.upsert_table(table(spark, ("A", 1, 1)), path, ["transaction_id"])
    writers.upsert_table(table(spark, ("B", 1, 1)).withColumn("extra", F.lit("x")), path, ["transaction_id"])
    assert by_id(spark.read.parquet(path), "extra") == {"A": None, "B": "x"}


def test_overwrite_days_touches_only_its_days_and_empties_vanished_ones(spark, folder):
    path = f"{folder}/t"
    writers.append(table(spark, ("A", 1, 1), ("B", 2, 1), ("C", 3, 1)), path)
    writers.overwrite_days(table(spark, ("B2", 2, 2)), path, [date(2026, 3, 2), date(2026, 3, 3)])
    assert by_id(spark.read.parquet(path), "v") == {"A": 1, "B2": 2}


def test_absent_inputs_are_empty_and_other_errors_raise(spark, folder):
    assert readers.feedback(spark, f"{folder}/none").count() == 0
    assert readers.quarantine(spark, f"{folder}/none").count() == 0
    assert readers.raw_json(spark, f"{folder}/none").count() == 0
    assert writers.read_json_line(spark, f"{folder}/none", S.RAW) is None
    with pytest.raises(Exception):  # noqa: B017
        readers.feedback(spark, "nosuchscheme://x/y").count()


def test_pruned_scan(spark, folder):
    path = f"{folder}/t"
    writers.append(table(spark, *[(f"T{d}", d, d) for d in range(1, 20)]), path)
    scan = readers.recent(spark.read.parquet(path), date(2026, 3, 20), 7)
    assert scan.count() == 7
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "(dt" in plan.split("PartitionFilters")[1][:80]


def landed(spark, folder, *changes):
    rows = raw(spark, *changes).withColumn("ingest_dt", F.lit("2026-03-01"))
    rows.write.mode("append").partitionBy("ingest_dt").option("compression", "gzip").json(f"{folder}/raw")
    return P.Lake(folder)


def test_pipeline_replay_adds_nothing(spark, folder):
    rows = [{"transaction_id": f"T{i}", "customer_id": f"C{i % 2}", "timestamp": f"2026-03-01T12:{i:02d}:00", "amount": str(10 + i)} for i in range(12)]
    lake = landed(spark, folder, *rows, {"transaction_id": "BAD", "amount": "N/A"})
    now = datetime(2026, 3, 1, 13)
    verdicts = P.run(spark, lake, now)
    assert [v["passed"] for v in verdicts] == [True, True, True]
    first = {name: spark.read.parquet(lake.path(name)).count() for name in ("bronze", "silver", "fraud_metrics_daily")}
    P.run(spark, lake, now)
    assert first == {name: spark.read.parquet(lake.path(name)).count() for name in first} and first["bronze"] == 12
    assert tuple(M.rejection_breakdown(readers.quarantine(spark, lake.path("quarantine"))).first())[0] == "non_numeric_amount"
    assert readers.quarantine(spark, lake.path("quarantine")).count() == 1  # the second run replaced it
    view = readers.raw_view(spark, lake.path("raw"))
    assert {"txn_timestamp", "ingest_dt"} <= set(view.columns) and view.count() == 13


def test_a_failed_gate_stops_before_silver(spark, folder):
    lake = landed(spark, folder, {})
    with pytest.raises(P.GateClosed):
        P.run(spark, lake, datetime(2026, 3, 5))  # nothing fresh
    assert not writers.exists(spark, lake.path("silver")) and CLEAN["transaction_id"] == "T1"


def test_lookback_rows_keep_their_features(spark, folder):
    rows = [
        {"transaction_id": f"T{d}", "timestamp": f"2026-{2 if d <= 28 else 3:02d}-{d if d <= 28 else d - 28:02d}T12:00:00", "amount": str(10 + d % 3)}
        for d in range(1, 40)
    ]
    lake = landed(spark, folder, *rows)
    P.run_bronze(spark, lake, datetime(2026, 3, 12))
    P.run_silver(spark, lake, date(2026, 3, 11), process_days=60)
    whole = by_id(spark.read.parquet(lake.path("silver")), "prior_txn_count_30d")
    P.run_silver(spark, lake, date(2026, 3, 11), process_days=1)
    assert by_id(spark.read.parquet(lake.path("silver")), "prior_txn_count_30d") == whole


def test_a_swap_stopped_halfway_loses_nothing(spark, folder):
    path = f"{folder}/t"
    writers.upsert_table(table(spark, ("A", 1, 1), ("B", 1, 1)), path, ["transaction_id"])
    live, files = writers._locate(spark, path)
    aside, _ = writers._locate(spark, f"{path}{writers.OLD}stopped")
    assert files.rename(live, aside)  # the first of the two renames was done, the second was not
    writers.upsert_table(table(spark, ("C", 1, 1)), path, ["transaction_id"])
    assert {r.transaction_id for r in spark.read.parquet(path).collect()} == {"A", "B", "C"}


def test_a_day_run_after_a_run_over_all_counts_no_reject_twice(spark, folder):
    lake = P.Lake(folder)
    for day, ids in ((1, "AB"), (2, "CD")):
        rows = [{"transaction_id": i, "amount": "N/A" if i in "AC" else "5"} for i in ids]
        raw(spark, *rows).write.mode("overwrite").json(f"{lake.path('raw')}/ingest_dt=2026-03-{day:02d}")
    now = datetime(2026, 3, 12)
    want = {"A", "C"}
    for day in (None, date(2026, 3, 1), date(2026, 3, 2), None, date(2026, 3, 1)):
        P.run_bronze(spark, lake, now, day)
        assert sorted(r.transaction_id for r in readers.quarantine(spark, lake.path("quarantine")).collect()) == sorted(want)


def test_keys_with_nulls_are_inserted_not_merged(spark, folder):
    path = f"{folder}/t"
    writers.upsert_table(table(spark, (None, 1, 1), (None, 1, 2)), path, ["transaction_id"])
    writers.upsert_table(table(spark, (None, 1, 3), ("A", 1, 4), (None, 2, 5)), path, ["transaction_id"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]


def files_of(spark, path) -> dict[str, set]:
    found: dict[str, set] = {}
    for row in spark.read.parquet(path).select("dt", F.input_file_name().alias("f")).distinct().collect():
        found.setdefault(str(row.dt), set()).add(row.f)
    return found


def test_only_touched_days_are_written(spark, folder):
    path = f"{folder}/t"
    writers.upsert_table(table(spark, *[(f"T{d}", d, d) for d in range(1, 8)], ("M", 2, 0), ("L", 7, 0)), path, ["transaction_id"])
    before = files_of(spark, path)
    change = table(spark, ("T3", 3, 30), ("M", 5, 50), ("N", 9, 90))  # in place, moved from the 2nd to the 5th, new
    for _ in range(2):
        writers.upsert_table(change, path, ["transaction_id"])
        after = files_of(spark, path)
        assert set(after) == set(before) | {"2026-03-09"}
        got = by_id(spark.read.parquet(path), "v")
        assert got == {"T1": 1, "T2": 2, "T3": 30, "T4": 4, "T5": 5, "T6": 6, "T7": 7, "M": 50, "L": 0, "N": 90}
    assert all(after[f"2026-03-0{d}"] == before[f"2026-03-0{d}"] for d in (1, 4, 6, 7))


def test_a_day_that_all_rows_leave_is_emptied(spark, folder):
    path = f"{folder}/t"
    writers.upsert_table(table(spark, ("A", 1, 1), ("B", 2, 2)), path, ["transaction_id"])
    writers.upsert_table(table(spark, ("A", 2, 3)), path, ["transaction_id"])
    assert by_id(spark.read.parquet(path), "v") == {"A": 3, "B": 2} and set(files_of(spark, path)) == {"2026-03-02"}


@pytest.mark.parametrize("whole", [True, False])
def test_a_stopped_move_of_days_is_finished_or_undone(spark, folder, whole, monkeypatch):
    path = f"{folder}/t"
    writers.upsert_table(table(spark, ("A", 1, 1), ("B", 2, 2), ("C", 3, 3)), path, ["transaction_id"])
    change = table(spark, ("A", 2, 9), ("C", 3, 9))
    with monkeypatch.context() as stopped:
        if whole:  # after one of the folders was dropped

            def half(spark, beside, path):
                writers._drop_folder(spark, f"{path}/dt=2026-03-02")
                raise OSError("stopped")

            stopped.setattr(writers, "_move_days", half)
        else:

            def no_marker(spark, beside, path):
                live, files = writers._locate(spark, f"{beside}/{writers.WHOLE}")
                files.delete(live, True)
                raise OSError("stopped")

            stopped.setattr(writers, "_move_days", no_marker)
        with pytest.raises(OSError, match="stopped"):
            writers.upsert_table(change, path, ["transaction_id"])
    writers.recover(spark, path)
    want = {"A": 9, "B": 2, "C": 9} if whole else {"A": 1, "B": 2, "C": 3}
    assert by_id(spark.read.parquet(path), "v") == want
    live, files = writers._locate(spark, folder)
    assert [s.getPath().getName() for s in files.listStatus(live)] == ["t"]


def test_stale_older_versions_are_deleted(spark, folder):
    path = f"{folder}/t"
    writers.upsert_table(table(spark, ("A", 1, 1)), path, ["transaction_id"])
    for name in ("x", "y"):
        writers.append(table(spark, ("OLD", 1, 1)), f"{path}{writers.OLD}{name}")
    writers.recover(spark, path)
    live, files = writers._locate(spark, folder)
    assert [s.getPath().getName() for s in files.listStatus(live)] == ["t"]


def test_the_probe_reads_keys_and_days_only(spark, folder):
    path = f"{folder}/t"
    writers.upsert_table(table(spark, ("A", 1, 1), ("B", 2, 1)), path, ["transaction_id"])
    target, change = spark.read.parquet(path), table(spark, ("A", 3, 1))
    standing = target.select("transaction_id", "dt").join(change.select("transaction_id"), "transaction_id", "left_semi")
    assert "ReadSchema: struct<transaction_id:string>" in standing._jdf.queryExecution().toString()
    assert sorted(str(d) for d in writers.touched_days(target, change, ["transaction_id"], "dt")) == ["2026-03-01", "2026-03-03"]


def test_an_upsert_reads_either_side_once(spark):
    target, source = table(spark, ("A", 1, 1)), table(spark, ("A", 2, 2))
    plan = writers.upsert(target, source, ["transaction_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_days_of_an_empty_result_are_emptied(spark, folder):
    path = f"{folder}/t"
    writers.overwrite_days(table(spark, ("A", 1, 1), ("B", 2, 2)), path)
    writers.overwrite_days(spark.read.parquet(path).where("false"), path, [date(2026, 3, 1)])
    assert [r["dt"] for r in spark.read.parquet(path).collect()] == [date(2026, 3, 2)]


def test_an_overwrite_computes_its_rows_once(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = table(spark, ("A", 1, 1), ("B", 2, 2))
    writers.overwrite_days(rows.mapInArrow(counted, rows.schema), f"{folder}/t", [date(2026, 3, d) for d in (1, 2, 3)])
    assert seen.value == 2


def test_a_new_table_is_written_in_one_pass(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = table(spark, ("A", 1, 1), ("B", 2, 2), (None, 2, 3))
    before = scratch_tables(spark)
    writers.upsert_table(rows.mapInArrow(counted, rows.schema), f"{folder}/t", ["transaction_id"])
    assert by_id(spark.read.parquet(f"{folder}/t"), "v") == {"A": 1, "B": 2, None: 3}
    assert seen.value == 3 and scratch_tables(spark) == before  # nor is it staged


def scratch_tables(spark):
    home = f"{scratch.root(spark)}/txnrisk".removeprefix("file:")
    return set(os.listdir(home)) if os.path.isdir(home) else set()


def test_stored_roll_ups_say_when_they_were_computed(spark, folder):
    rows = [{"transaction_id": f"T{i}", "customer_id": f"C{i % 2}", "timestamp": f"2026-03-01T12:{i:02d}:00", "amount": str(10 + i)} for i in range(12)]
    lake, now = landed(spark, folder, *rows), datetime(2026, 3, 1, 13)
    P.run(spark, lake, now)
    stamps = {"fraud_metrics_daily": "gold_computed_at", "merchant_risk": "gold_computed_at", "merchant_dim": "dim_computed_at"}
    for name, column in stamps.items():
        assert {r[column] for r in spark.read.parquet(lake.path(name)).select(column).collect()} == {now}
    P.run_gold(spark, lake, date(2026, 3, 1))  # without a moment: the beginning of the day
    assert spark.read.parquet(lake.path("merchant_risk")).first()["gold_computed_at"] == datetime(2026, 3, 1)
    assert "dim_computed_at" not in spark.read.parquet(lake.path("silver")).columns
