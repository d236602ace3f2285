"""Every query with an SQL twin against DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences
from txnrisk.plans import driver

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    assert differences(spark, duck, SF, name) is None


def test_every_query_is_known_and_the_flagship_runs(spark):
    assert set(driver.queries()) <= set(entry.queries())
    without_sql = set(driver.queries()) - set(entry.oracle_sql())
    assert without_sql == {"ensemble_scores", "ensemble_metrics", "stream_scores"}
    assert entry.entry(spark).count() > 0
