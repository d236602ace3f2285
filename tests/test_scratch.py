from __future__ import annotations

import pytest

from txnrisk.sources import scratch


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, *_):
        return self.value


class Session:
    def __init__(self, master: str, named: str | None):
        self.conf = Conf(named)
        self.sparkContext = type(
            "Context", (), {"master": master, "applicationId": "app", "getConf": lambda _: Conf(None)}
        )()


def test_the_folder_the_cluster_names_is_used():
    assert scratch.root(Session("yarn", "hdfs://shared/")) == "hdfs://shared"


def test_a_cluster_without_one_is_refused_and_a_single_machine_gets_one():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.root(Session("yarn", None))
    assert scratch.root(Session("local[2]", None)) == scratch.root(Session("local[4]", None))


def test_staged_tables_read_back_the_same(spark):
    df = spark.range(5).selectExpr("id", "cast(id as decimal(12,2)) AS amount")
    again = scratch.stage(df, "t")
    assert again.dtypes == df.dtypes and again.exceptAll(df).count() == 0
