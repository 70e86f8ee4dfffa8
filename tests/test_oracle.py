"""A sample of registered queries against their SQL on the smallest data (tests/check.py runs all of them)."""

import pytest

import __spark_entry__ as entry
from check import compare, oracle
from conftest import SF

SAMPLE = ("cross_sectional_sort", "upsert_bars", "max_drawdown", "tail_ratio", "rolling_beta", "depth_bands", "lead_lag_join", "iceberg",
          "classify_trades_tick", "smart_route", "cascade", "skew_metrics", "contrarian", "page_metadata", "feed_items")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    err, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert err is None, err


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
