"""The 41 reports on eight hand-made tables, and on star tables by both routes."""

import datetime as dt

import duckdb
import pytest

from conftest import rows
from tallymart.catalog import base_sql, reports
from tallymart.plans import customers, overview, products, trends
from tallymart.sources.star import StarMart

SMALL = "/root/testdata/sf0.001"


def test_headline(tiny):
    assert rows(overview.headline_kpis(tiny)) == [(1850.0, 45.0, 2.43, 6, 308.33)]


def test_category_and_region(tiny):
    assert rows(overview.profitability_by(tiny, "category_name")) == [
        ("Technology", 3, 1300.0, -60.0, -4.62), ("Furniture", 3, 500.0, 100.0, 20.0),
        ("Office Supplies", 2, 50.0, 5.0, 10.0)]
    assert rows(overview.loss_making(tiny)) == [("West", 1250.0, -100.0)]


def test_margin_of_a_zero_sale_is_left_out(tiny):
    [(discount, margin, low, high)] = rows(overview.discount_profile(tiny))
    assert (low, high) == (0.0, 1.0) and discount == 0.2125
    assert margin == pytest.approx((.2 + .3 - 50 / 600 + .1 - .25 + .2 + .2) / 7, abs=1e-4)


def test_tiers_speeds_and_split(tiny):
    assert rows(overview.discount_tiers(tiny), "discount_tier", "line_items") == [
        ("No discount", 3), ("Low (0-10%)", 2), ("Medium (11-20%)", 1), ("High (21%+)", 2)]
    assert rows(overview.shipping_speed(tiny)) == [
        ("Same day", 1, 0.0), ("1-3 days", 3, 2.33), ("4+ days", 2, 5.5)]
    assert set(rows(overview.profitable_split(tiny), "profitability", "pct_of_line_items")) == {
        ("Profitable", 75.0), ("Loss-making", 25.0)}


def test_customers(tiny):
    assert rows(customers.frequent_customers(tiny)) == [("C1", "Ann", "Consumer", 4, 1000.0)]
    assert rows(customers.latest_order_per_customer(tiny)) == [
        ("Cy", "O6", dt.date(2023, 3, 1)), ("Ann", "O5", dt.date(2023, 1, 4)),
        ("Bob", "O2", dt.date(2022, 1, 20))]
    assert rows(customers.spend_rank_in_segment(tiny)) == [
        ("Consumer", "Ann", 1000.0, 1), ("Consumer", "Cy", 250.0, 2), ("Corporate", "Bob", 600.0, 1)]
    assert rows(customers.top_decile_customers(tiny), "customer_name") == [("Ann",)]
    assert sorted(rows(customers.order_value_changes(tiny)), key=repr) == sorted([
        ("Ann", dt.date(2022, 1, 5), 400.0, None, None),
        ("Ann", dt.date(2022, 2, 3), 50.0, 400.0, -350.0),
        ("Ann", dt.date(2023, 1, 4), 400.0, 50.0, 350.0),
        ("Ann", dt.date(2023, 1, 4), 150.0, 400.0, -250.0),
        ("Bob", dt.date(2022, 1, 20), 600.0, None, None),
        ("Cy", dt.date(2023, 3, 1), 250.0, None, None)], key=repr)


def test_rfm_direction(tiny):
    usual = {r.customer_name: r for r in customers.rfm_scores(tiny).collect()}
    assert usual["Cy"].recency_days == 0 and usual["Cy"].r_score == 1
    flipped = {r.customer_name: r for r in customers.rfm_scores(tiny, best_score=5).collect()}
    assert flipped["Cy"].r_score == 5
    with pytest.raises(ValueError):
        customers.rfm_scores(tiny, best_score=3)


def test_products(tiny):
    assert rows(products.best_product_per_category(tiny)) == [
        ("Furniture", "Chair", 100.0), ("Office Supplies", "Paper", 5.0),
        ("Technology", "Phone", -60.0)]
    assert rows(products.profit_concentration(tiny)) == [(1, 2, 50.0, 95.2)]
    assert rows(products.top_products_in_context(tiny, 1)) == [
        ("Chair", 100.0, "Furniture", "Chairs")]
    assert rows(products.dormant_products(tiny, 1)) == [
        ("Phone", dt.date(2023, 1, 4), 56, 4)]


def test_trends(tiny):
    assert rows(trends.cumulative_revenue(tiny), "cumulative_revenue") == [
        (1000.0,), (1050.0,), (1600.0,), (1850.0,)]
    assert rows(trends.rolling_revenue(tiny), "rolling_3mo_avg") == [
        (1000.0,), (525.0,), (533.33,), (283.33,)]
    assert rows(trends.revenue_growth(tiny, "order_year", "g"), "g") == [(None,), (-23.81,)]
    assert set(rows(trends.new_vs_returning(tiny))) == {
        (dt.date(2022, 1, 1), "New", 2, 1000.0), (dt.date(2022, 2, 1), "Returning", 1, 50.0),
        (dt.date(2023, 1, 1), "Returning", 2, 550.0), (dt.date(2023, 3, 1), "New", 1, 250.0)}


def test_an_unsold_first_order_makes_later_ones_returning(spark, tiny):
    early = spark.createDataFrame(
        [("O0", dt.date(2021, 5, 1), dt.date(2021, 5, 1), "Same Day", "C2", 1)],
        tiny.tables["orders"].schema)
    tiny.tables["orders"] = tiny.tables["orders"].union(early)
    got = rows(trends.new_vs_returning(tiny))
    assert (dt.date(2022, 1, 1), "Returning", 1, 600.0) in got
    assert not [r for r in got if r[0] == dt.date(2021, 5, 1)]


def test_region_matrix_has_zero_for_absent_cells(tiny):
    names = {"Technology": "technology_revenue", "Furniture": "furniture_revenue",
             "Office Supplies": "office_supplies_revenue"}
    assert rows(overview.region_category_matrix(tiny, names)) == [
        ("East", 300.0, 250.0, 50.0), ("West", 1000.0, 250.0, 0.0)]
    assert rows(overview.best_state_per_region(tiny)) == [
        ("West", "NV", 1250.0), ("East", "MA", 600.0)]


@pytest.fixture(scope="module")
def both_routes(spark, tmp_path_factory):
    """The star read directly, and its eight tables written out and joined by key."""
    from tallymart import sinks
    from tallymart.sources.tables import load_tables
    star = StarMart(spark, SMALL)
    folder = str(tmp_path_factory.mktemp("eight"))
    sinks.write_tables(star.normalised(), folder)
    return star, load_tables(spark, folder, "parquet")


# One query per way of reading the mart. Left out are those whose ties fall to a
# key, which sorts as a number in the star and as text in the eight tables.
COMPARED = (
    "q01_headline_kpis", "q03_region_revenue", "q06_frequent_customers",
    "q07_broad_reach_products", "q10_shipping_speed", "q12_category_month_share",
    "q15_spend_rank_in_segment", "q17_best_product_per_category", "q26_segment_summary",
    "q28_new_vs_returning", "q32_region_category_matrix", "q33_best_state_per_region",
    "q35_profit_concentration", "q36_rfm_raw", "q40_dormant_products")


@pytest.mark.parametrize("name", COMPARED)
def test_star_and_eight_tables_agree(both_routes, many_blocks, name):
    build = reports.ENTRIES[name][0]
    star, eight = both_routes

    def settled(df):
        return sorted(
            (tuple(str(v) if c == "customer_id" else v for c, v in zip(df.columns, r))
             for r in df.collect()), key=repr)

    assert settled(build(star)) == settled(build(eight))


def test_check_sql_reads_only_given_tables():
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    assert con.execute(base_sql.flat("SELECT COUNT(*) FROM flat")).fetchone()[0] > 3000
