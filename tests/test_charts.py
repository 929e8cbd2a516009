import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallymart.operators.view import analytics_view, filter_options, filter_view
from tallymart.plans import charts


def test_view_keeps_every_sale_and_all_attributes(tiny):
    view = analytics_view(tiny)
    assert view.count() == 8
    got = view.where("sales_id = 3").first()
    assert (got.customer_name, got.city, got.region_name, got.product_name, got.subcategory_name,
            got.category_name) == ("Bob", "Reno", "West", "Phone", "Phones", "Technology")
    assert (got.order_year, got.order_month, got.order_quarter) == (2022, dt.date(2022, 1, 1), "2022Q1")
    assert got.profit_margin == pytest.approx(-50 / 600)
    assert view.where("sales = 0").first().profit_margin is None


def test_view_keeps_sales_without_a_parent(tiny):
    tiny.tables["products"] = tiny.tables["products"].where("product_id <> 'P1'")
    view = analytics_view(tiny)
    assert view.count() == 8 and view.where("product_name IS NULL").count() == 3


def test_filter_is_inclusive_and_empty_lists_give_nothing(tiny):
    view = analytics_view(tiny)
    day = dt.date(2023, 1, 4)
    assert filter_view(view, day, day).count() == 2
    assert filter_view(view, regions=["East"], segments=["Consumer"]).count() == 4
    assert filter_view(view, categories=[]).count() == 0
    assert filter_view(view).count() == 8


def test_filter_options(tiny):
    got = rows(filter_options(analytics_view(tiny)))
    assert ("max_date", "2023-03-01") in got and ("min_date", "2022-01-05") in got
    assert [v for f, v in got if f == "category_name"] == [
        "Furniture", "Office Supplies", "Technology"]


def test_kpis(view_of):
    got = charts.kpis(view_of([
        {"order_id": "O-1", "sales": 100.0, "profit": 20.0},
        {"order_id": "O-1", "sales": 50.0, "profit": 10.0},
        {"order_id": "O-2", "sales": 200.0, "profit": -40.0}])).first()
    assert (got.total_revenue, got.total_profit, got.total_orders) == (350.0, -10.0, 2)
    assert got.profit_margin == pytest.approx(-10 / 350) and got.avg_order_value == 175.0


def test_kpis_of_nothing(view_of):
    assert rows(charts.kpis(view_of([]))) == [(0.0, 0.0, None, 0, None)]


def test_group_charts(tiny):
    view = analytics_view(tiny)
    assert rows(charts.performance_by(view, "category_name"), "category_name", "sales") == [
        ("Technology", 1300.0), ("Furniture", 500.0), ("Office Supplies", 50.0)]
    assert rows(charts.performance_by(view, "region_name"), "region_name", "sales") == [
        ("West", 1250.0), ("East", 600.0)]
    assert rows(charts.segment_share(view)) == [("Consumer", 1250.0), ("Corporate", 600.0)]
    assert rows(charts.monthly_trend(view), "order_month")[0] == (dt.date(2022, 1, 1),)
    assert rows(charts.top_products(view, 1)) == [("Chair", 100.0)]
    assert rows(charts.top_products(view, 1, "sales", True)) == [("Paper", 50.0)]
    with pytest.raises(ValueError):
        charts.top_products(view, metric="quantity")


def test_discount_grid_counts_every_point(tiny):
    view = analytics_view(tiny)
    assert charts.discount_points(view).count() == 8
    assert charts.discount_grid(view).agg(F.sum("points")).first()[0] == 7  # one has no margin


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(41)], "sales double")
    got = rows(charts.sales_histogram(df), "bin", "n")
    assert got[0] == (1, 1) and got[-1] == (40, 2) and sum(n for _, n in got) == 41


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(5.0,)] * 3, "sales double")
    assert rows(charts.sales_histogram(df), "bin", "n") == [(21, 3)]


def test_outlier_histogram_and_box(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 11, 12, 13, 14, 500)], "sales double")
    kinds = charts.outlier_histogram(df).groupBy("kind").agg(F.sum("n")).collect()
    assert {tuple(r) for r in kinds} == {("Outlier", 1), ("Typical", 5)}
    box = charts.box_plot(df).first()
    assert (box.q1, box.median, box.q3) == (11.25, 12.5, 13.75)
    assert (box.whisker_low, box.whisker_high, box.fliers) == (10.0, 14.0, 1)
    assert rows(charts.box_fliers(df)) == [(500.0, 1)]


def test_charts_of_no_values(spark):
    df = spark.createDataFrame([(None,)], "sales double")
    assert rows(charts.sales_histogram(df)) == [] and rows(charts.outlier_histogram(df)) == []
    assert rows(charts.box_plot(df)) == [(None, None, None, None, None, 0)]
    assert rows(charts.box_fliers(df)) == []


def test_plans_on_a_count_table_stay_small(tiny):
    view = analytics_view(tiny)
    for df in (charts.outlier_histogram(view), charts.box_plot(view), charts.box_fliers(view)):
        plan = df._jdf.queryExecution().toString()
        assert len(plan) < 50_000 and "ScalarSubquery" not in plan


def test_given_flags_split_the_histogram(spark):
    df = spark.createDataFrame([(float(i), i > 7) for i in range(10)], "sales double, is_outlier boolean")
    got = charts.outlier_histogram(None, df, bins=3)
    assert rows(got, "kind", "bin", "n") == [("Outlier", 3, 2), ("Typical", 1, 3), ("Typical", 2, 3), ("Typical", 3, 2)]
