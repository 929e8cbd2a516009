"""One registered query per family against its SQL; ``check.py`` runs them all."""

import pytest

import __spark_entry__ as registered
from check import compare
from tallymart import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_entry(spark):
    assert registered.entry(spark).count() == 6


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


def test_every_query_of_the_catalog_is_registered():
    assert set(QUERIES) <= set(registered.queries()) and set(SQL) <= set(registered.oracle_sql())
    assert not set(registered.oracle_sql()) - set(registered.queries())


PICKED = (
    "q15_spend_rank_in_segment", "q35_profit_concentration", "view1_analytics_view",
    "flt1_dashboard_filter", "ch9_outlier_histogram", "st1_describe_profit",
    "fc11_backtest_by_category", "rc6_recommendations", "cln10_drop_report", "nrm7_orders",
    "ri_report_with_orphans")


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_its_sql(spark, name):
    state, _, _, note = compare(spark, FOLDER, name, QUERIES[name], SQL.get(name))
    assert state in ("ok", "rows-only"), note
