"""Intermediate tables on shared storage.

A plan that reads the same expensive input several times stages it here. A written table is
read back column by column, cuts the lineage, and survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh local one only on a one-machine master."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = tempfile.mkdtemp(prefix="spark-")
    return _local[application]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/txnrisk/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
