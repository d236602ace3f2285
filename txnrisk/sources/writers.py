"""Sinks over Parquet folders partitioned by ``dt``.

Parquet has no MERGE: an upsert rewrites the days it touches. Each table has one writer at a time.
A catalog with a transactional format can run the same frames through ``MERGE INTO``.
"""

from __future__ import annotations

import json
import uuid
from datetime import date
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.sources import scratch

CODEC = "zstd"


def add_columns(target: DataFrame, source: DataFrame) -> DataFrame:
    """``target`` with the columns only ``source`` has, NULL in the old rows. Nothing is
    dropped or retyped."""
    fresh = [f for f in source.schema.fields if f.name not in target.columns]
    return target.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fresh])


def upsert(
    target: DataFrame, source: DataFrame, keys: list[str], newer_by: str | None = None
) -> DataFrame:
    """``target`` with every source row inserted, or put in place of the row with its key.

    ``source`` holds one row per key. With ``newer_by`` a source row replaces an existing one
    only if it is at least as new, so replaying an old batch changes nothing. A key that holds a NULL
    matches nothing, as in MERGE: such rows stay, and those of the source are inserted.
    """
    widened = add_columns(target, source).withColumn("_arrived", F.lit(0))
    both = widened.unionByName(source.withColumn("_arrived", F.lit(1)), allowMissingColumns=True)
    # a row without a key equals no other: each is a group of its own, on either side
    apart = F.when(reduce(or_, [F.col(k).isNull() for k in keys]), F.monotonically_increasing_id())
    newest = [F.desc_nulls_last(newer_by)] if newer_by is not None else []
    first = Window.partitionBy(*keys, "_apart").orderBy(*newest, F.desc("_arrived"))
    # either side is read once, and rows meet in one shuffle
    numbered = both.withColumn("_apart", apart).withColumn("_n", F.row_number().over(first))
    return numbered.where("_n = 1").drop("_n", "_arrived", "_apart")


def create_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    partition_by: str | None = "dt",
    sort_by: list[str] | None = None,
) -> DataFrame:
    """The table at ``path``, created empty when it does not exist yet."""
    recover(spark, path)
    if not exists(spark, path):
        _laid_out(spark.createDataFrame([], schema), partition_by, sort_by).save(path)
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
    return spark.read.schema(schema).parquet(path)


def _laid_out(df: DataFrame, partition_by: str | None, sort_by: list[str] | None = None, mode="errorifexists"):
    if partition_by:
        # The rebalance hint lets Spark split a big day over several files and merge small
        # ones; a plain repartition by day would put each day in one task.
        df = df.hint("rebalance", partition_by)
    order = [*([partition_by] if partition_by else []), *(sort_by or [])]
    if sort_by:
        df = df.sortWithinPartitions(*order)
    writer = df.write.format("parquet").mode(mode).option("compression", CODEC)
    return writer.partitionBy(partition_by) if partition_by else writer


def append(df: DataFrame, path: str, partition_by: str | None = "dt") -> None:
    _laid_out(df, partition_by, mode="append").save(path)


def write_quarantine(rejected: DataFrame, path: str, arrival_day: date | None = None) -> None:
    """Dead letters, filed by the day their raw rows arrived, in place of those earlier runs left; the
    reasons stay as text.

    With a day that day's folder is replaced. Without one, a run over all raw files replaces everything
    and files each row under its own arrival day, the column ``ingest_dt`` that the raw folders give (rows of
    raw files outside such folders under ``none``), so that a later run of one day replaces what it judges
    again and counts nothing twice.
    """
    home = path.rstrip("/")
    rows = rejected.drop("rejection_reasons", "ingest_dt")
    if arrival_day is not None:
        _laid_out(rows, "dt", mode="overwrite").save(f"{home}/arrival={arrival_day}")
        return
    day = F.col("ingest_dt").cast("string") if "ingest_dt" in rejected.columns else F.lit(None)
    filed = rejected.withColumn("arrival", F.coalesce(day, F.lit("none"))).select(*rows.columns, "arrival")
    filed = filed.hint("rebalance", "arrival", "dt")
    filed.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", CODEC).partitionBy("arrival", "dt").parquet(home)


def overwrite_snapshot(df: DataFrame, path: str) -> None:
    """Replace an unpartitioned table whole."""
    _laid_out(df, None, mode="overwrite").save(path)


def overwrite_days(df: DataFrame, path: str, days: list[date] | None = None) -> None:
    """Replace the partitions present in ``df``. Days listed but absent from ``df`` are
    emptied too, which a dynamic overwrite alone would leave stale. Which these are is read off the
    writing job: ``df`` is computed once."""
    seen = Observation()
    if days:
        df = df.observe(seen, *[F.count_if(F.col("dt") == F.lit(day)).alias(f"d{i}") for i, day in enumerate(days)])
    _laid_out(df, "dt", mode="overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    for i, day in enumerate(days or []):
        if not seen.get[f"d{i}"]:
            _drop_folder(df.sparkSession, f"{path.rstrip('/')}/dt={day}")


def _locate(spark: SparkSession, folder: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    location, files = _locate(spark, path)
    return files.exists(location)


def _drop_folder(spark: SparkSession, folder: str) -> None:
    location, files = _locate(spark, folder)
    if files.exists(location):
        files.delete(location, True)


def touched_days(target: DataFrame, source: DataFrame, keys: list[str], partition_by: str) -> list:
    """The days an upsert of ``source`` changes: its own and those where rows with its keys stand now.

    Of the table only the keys and the day are read, and Spark filters that scan by a Bloom filter of
    the source's keys where that pays. The list is as long as the table has days.
    """
    standing = target.select(*keys, partition_by).join(source.select(*keys), keys, "left_semi")
    days = source.select(partition_by).unionByName(standing.select(partition_by)).distinct()
    return [row[0] for row in days.collect()]


def upsert_table(
    source: DataFrame,
    path: str,
    keys: list[str],
    partition_by: str | None = "dt",
    newer_by: str | None = None,
) -> None:
    """Keyed upsert into the table at ``path``; created when absent, from the rows as they are, one per key.

    Only touched days are read whole and written anew. A key may move to another day (a corrected
    timestamp): the day it leaves is touched too. Where the source brings new columns, and in tables
    without days, the whole table is written, so that all files have one schema.

    The new days are written beside the table and then moved into place. A job that stops before all of
    them are written has changed nothing; one that stops later is finished by the next call (see
    ``recover``), as its marker says that what is beside the table is whole.
    """
    spark = source.sparkSession
    home = path.rstrip("/")
    recover(spark, path)
    if not exists(spark, path):
        # nothing to meet: the rows are written as they come, in one pass
        fresh = f"{home}{NEXT}{uuid.uuid4().hex}"
        _laid_out(source, partition_by).save(fresh)
        if not _locate(spark, fresh)[1].rename(_locate(spark, fresh)[0], _locate(spark, path)[0]):
            raise OSError(f"could not move {fresh} to {path}")
        return
    target = create_table(spark, path, source.schema, partition_by)
    if partition_by is None or set(source.columns) - set(target.columns):
        beside = f"{home}__{uuid.uuid4().hex}"
        _laid_out(upsert(target, source, keys, newer_by), partition_by).save(beside)
        _swap(spark, beside, path)
        return
    batch = scratch.stage(source, "upsert")  # read for its days, for its keys and for its rows
    days = touched_days(target, batch, keys, partition_by)
    if not days:
        return
    known = [d for d in days if d is not None]
    within = F.col(partition_by).isin(known) if known else F.lit(False)
    if None in days:
        within = within | F.col(partition_by).isNull()
    beside = f"{home}{NEXT}{uuid.uuid4().hex}"
    _laid_out(upsert(target.where(within), batch, keys, newer_by), partition_by).save(beside)
    for day in days:  # a day that all its rows left is an empty folder here
        folder, files = _locate(spark, _day_folder(beside, partition_by, day))
        files.mkdirs(folder)
    marker, files = _locate(spark, f"{beside}/{WHOLE}")
    files.create(marker, True).close()
    _move_days(spark, beside, path)


OLD, NEXT, WHOLE = "__old_", "__next_", "_WHOLE"


def _day_folder(home: str, partition_by: str, day) -> str:
    return f"{home}/{partition_by}={'__HIVE_DEFAULT_PARTITION__' if day is None else day}"


def _move_days(spark: SparkSession, beside: str, path: str) -> None:
    """Every day's folder in ``beside`` takes the place of the table's; can be repeated from any point."""
    source, files = _locate(spark, beside)
    for status in files.listStatus(source):
        name = status.getPath().getName()
        if "=" in name:
            _drop_folder(spark, f"{path.rstrip('/')}/{name}")
            if not files.listStatus(status.getPath()):
                continue
            if not files.rename(status.getPath(), _locate(spark, f"{path.rstrip('/')}/{name}")[0]):
                raise OSError(f"could not move {name} into {path}")
    files.delete(source, True)


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo what an upsert that was stopped left beside the table at ``path``.

    Days that are whole are moved into place, others are deleted. A whole table set aside goes back if the
    table is missing, else it is deleted: its successor is in place.
    """
    home = path.rstrip("/")
    live, files = _locate(spark, path)

    def beside(mark: str) -> list:
        return [s.getPath() for s in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{home}{mark}*")) or []]

    aside = beside(OLD)
    if not files.exists(live) and len(aside) > 1:
        raise OSError(f"{path} is missing and more than one older version of it is there")
    for old in aside:
        if files.exists(live):
            files.delete(old, True)
        elif not files.rename(old, live):
            raise OSError(f"could not bring {path} back")
    for fresh in beside(NEXT):
        if exists(spark, f"{fresh.toString()}/{WHOLE}"):
            _move_days(spark, fresh.toString(), path)
        else:
            files.delete(fresh, True)


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    live, files = _locate(spark, path)
    new, _ = _locate(spark, fresh)
    old, _ = _locate(spark, f"{path.rstrip('/')}{OLD}{uuid.uuid4().hex}")
    if not (files.rename(live, old) and files.rename(new, live)):
        raise OSError(f"could not swap {fresh} into {path}")
    files.delete(old, True)


def write_json_line(df: DataFrame, path: str) -> None:
    """A one-row document (manifest, quality report)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json_line(spark: SparkSession, path: str, schema: T.StructType) -> dict | None:
    """The document, or None when absent or unreadable."""
    try:
        lines = spark.read.schema("value STRING").text(path).limit(1).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if not lines:
        return None
    try:
        document = json.loads(lines[0]["value"])
    except ValueError:
        return None
    return {name: document.get(name) for name in schema.fieldNames()}
