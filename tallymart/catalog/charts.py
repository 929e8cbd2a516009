"""KPIs, filters and chart datasets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallymart.catalog.base_sql import flat, money, tables
from tallymart.catalog.shared import settle
from tallymart.operators.view import analytics_view, filter_options, filter_view
from tallymart.plans import charts
from tallymart.sources.star import StarMart

FILTER = dict(start=dt.date(1996, 3, 1), end=dt.date(1999, 10, 31),
              regions=["ASIA", "EUROPE", "AFRICA"], categories=["PROMO", "SMALL", "LARGE"],
              segments=["BUILDING", "HOUSEHOLD"])
FILTER_COLUMNS = ("order_date", "region_name", "category_name", "segment")
PASSES = """order_date BETWEEN DATE '1996-03-01' AND DATE '1999-10-31'
          AND region_name IN ('ASIA', 'EUROPE', 'AFRICA')
          AND category_name IN ('PROMO', 'SMALL', 'LARGE')
          AND segment IN ('BUILDING', 'HOUSEHOLD')"""

SUMS = "CAST(SUM(sales) AS DOUBLE) AS sales, CAST(SUM(profit) AS DOUBLE) AS profit"
KPIS = """CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS total_revenue,
        CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS total_profit,
        ROUND(CAST(SUM(profit) AS DOUBLE) / NULLIF(CAST(SUM(sales) AS DOUBLE), 0), 6)
          AS profit_margin,
        COUNT(DISTINCT order_id) AS total_orders,
        ROUND(CAST(SUM(sales) AS DOUBLE) / NULLIF(COUNT(DISTINCT order_id), 0), 6)
          AS avg_order_value"""

# Sales of the star data have no outlier; margins have some on every scale.
QUARTILES = """quartiles AS (
  SELECT quantile_cont(profit_margin, 0.25) AS q1, quantile_cont(profit_margin, 0.5) AS median,
         quantile_cont(profit_margin, 0.75) AS q3 FROM flat)"""
FENCED = """fenced AS (
  SELECT profit_margin AS x, q1, median, q3,
         q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high
  FROM flat, quartiles WHERE profit_margin IS NOT NULL)"""


def _span(x: str) -> str:
    return f"spans AS (SELECT MIN({x}) AS lo, (MAX({x}) - MIN({x})) / 40 AS width FROM flat)"



def _bins(kind: str, source: str) -> str:
    keys = "kind, bin" if kind else "bin"
    return f"""
        SELECT {keys}, COUNT(*) AS n, ROUND(ANY_VALUE(lo) + (bin - 1) * ANY_VALUE(width), 6)
                 AS bin_from, ROUND(ANY_VALUE(lo) + bin * ANY_VALUE(width), 6) AS bin_to
        FROM (SELECT {kind} CAST(LEAST(FLOOR((x - lo) / width), 39) + 1 AS INTEGER) AS bin,
                     lo, width
              FROM {source}, spans) AS b
        GROUP BY {keys}"""


def _view(m: StarMart, *columns: str):
    return m.lines(*columns)


def _filtered(m: StarMart, *columns: str):
    names = list(dict.fromkeys([*columns, *FILTER_COLUMNS]))
    return filter_view(m.lines(*names), **FILTER)


ENTRIES = {
    "view1_analytics_view": (lambda m: analytics_view(m.normalised()), tables("""
        SELECT s.*, order_date, ship_date, ship_mode, o.customer_id, o.location_id,
               customer_name, segment, city, state, postal_code, l.region_id, region_name,
               product_name, p.subcategory_id, b.subcategory_name, b.category_id, c.category_name,
               CAST(year(order_date) AS INTEGER) AS order_year,
               CAST(date_trunc('month', order_date) AS DATE) AS order_month,
               year(order_date) || 'Q' || quarter(order_date) AS order_quarter,
               CAST(profit AS DOUBLE) / NULLIF(CAST(sales AS DOUBLE), 0) AS profit_margin
        FROM t_sales AS s
        LEFT JOIN t_orders AS o ON s.order_id = o.order_id
        LEFT JOIN t_customers AS u ON o.customer_id = u.customer_id
        LEFT JOIN t_locations AS l ON o.location_id = l.location_id
        LEFT JOIN t_regions AS r ON l.region_id = r.region_id
        LEFT JOIN t_products AS p ON s.product_id = p.product_id
        LEFT JOIN t_sub_categories AS b ON p.subcategory_id = b.subcategory_id
        LEFT JOIN t_categories AS c ON b.category_id = c.category_id""")),
    "view2_time_features": (
        lambda m: m.lines("order_year", "order_month", "order_quarter", "sales")
        .groupBy("order_year", "order_month", "order_quarter")
        .agg(F.count(F.lit(1)).alias("line_items"), F.sum("sales").cast("double").alias("sales")),
        flat("""
        SELECT order_year, order_month, order_year || 'Q' || quarter(order_date) AS order_quarter,
               COUNT(*) AS line_items, CAST(SUM(sales) AS DOUBLE) AS sales
        FROM flat GROUP BY ALL""")),
    "view3_profit_margin": (
        lambda m: m.lines("order_id", "product_id", "sales", "profit", "profit_margin"), flat("""
        SELECT order_id, product_id, sales, profit, profit_margin FROM flat""")),
    "flt1_dashboard_filter": (
        lambda m: _filtered(m, "order_id", "product_id", "sales", "quantity"), flat(f"""
        SELECT order_id, product_id, sales, quantity, order_date, region_name, category_name,
               segment
        FROM flat WHERE {PASSES}""")),
    "flt2_filter_options": (
        lambda m: filter_options(_view(m, *FILTER_COLUMNS)), flat("""
        SELECT DISTINCT 'region_name' AS filter, region_name AS value FROM flat
        UNION ALL SELECT DISTINCT 'category_name', category_name FROM flat
        UNION ALL SELECT DISTINCT 'segment', segment FROM flat
        UNION ALL SELECT 'min_date', CAST(MIN(order_date) AS VARCHAR) FROM flat
        UNION ALL SELECT 'max_date', CAST(MAX(order_date) AS VARCHAR) FROM flat""")),
    "flt3_browse_filtered": (
        lambda m: _filtered(m, "order_id", "order_date", "ship_mode", "customer_id",
                            "customer_name", "segment", "city", "state", "postal_code",
                            "region_name", "product_id", "product_name", "category_name",
                            "subcategory_name", "sales", "quantity", "discount", "profit",
                            "order_year", "order_month", "profit_margin"), flat(f"""
        SELECT order_id, order_date, ship_mode, customer_id, customer_name, segment, city, state,
               'UNKNOWN' AS postal_code, region_name, product_id, product_name, category_name,
               subcategory_name, sales, quantity, discount, profit, order_year, order_month,
               profit_margin
        FROM flat WHERE {PASSES}""")),
    "kpi1_headline": (
        lambda m: settle(charts.kpis(_view(m, "order_id", "sales", "profit"))),
        flat(f"SELECT {KPIS} FROM flat")),
    "kpi1_headline_filtered": (
        lambda m: settle(charts.kpis(_filtered(m, "order_id", "sales", "profit"))),
        flat(f"SELECT {KPIS} FROM flat WHERE {PASSES}")),
    "ch1_monthly_trend": (
        lambda m: charts.monthly_trend(_view(m, "order_month", "sales", "profit")),
        flat(f"SELECT order_month, {SUMS} FROM flat GROUP BY order_month")),
    "ch2_category_performance": (
        lambda m: charts.performance_by(charts.summed_view(m, "category_name"), "category_name"),
        flat(f"SELECT category_name, {SUMS} FROM flat GROUP BY category_name")),
    "ch3_region_performance": (
        lambda m: charts.performance_by(charts.summed_view(m, "region_name"), "region_name"),
        flat(f"SELECT region_name, {SUMS} FROM flat GROUP BY region_name")),
    "ch4_top_products": (
        lambda m: charts.top_products(charts.summed_view(m, "product_name")), flat("""
        SELECT product_name, CAST(SUM(profit) AS DOUBLE) AS profit FROM flat
        GROUP BY product_name ORDER BY SUM(profit) DESC, product_name LIMIT 10""")),
    "ch4_bottom_products_by_sales": (
        lambda m: charts.top_products(charts.summed_view(m, "product_name"), 25, "sales", True),
        flat("""
        SELECT product_name, CAST(SUM(sales) AS DOUBLE) AS sales FROM flat
        GROUP BY product_name ORDER BY SUM(sales), product_name LIMIT 25""")),
    "ch5_discount_points": (
        lambda m: charts.discount_points(
            _view(m, "discount", "profit_margin", "product_name", "category_name")),
        flat("SELECT discount, profit_margin, product_name, category_name FROM flat")),
    "ch5_discount_grid": (
        lambda m: charts.discount_grid(_view(m, "discount", "profit_margin")), flat("""
        SELECT CAST(discount AS DOUBLE) AS discount,
               ROUND(FLOOR(ROUND(profit_margin / CAST(0.1 AS DOUBLE), 8)) * CAST(0.1 AS DOUBLE), 8)
                 AS margin_from,
               COUNT(*) AS points
        FROM flat GROUP BY 1, 2""")),
    "ch6_segment_share": (
        lambda m: charts.segment_share(charts.summed_view(m, "segment")),
        flat("SELECT segment, CAST(SUM(sales) AS DOUBLE) AS sales FROM flat GROUP BY segment")),
    "ch7_correlation_heatmap": (
        lambda m: settle(charts.correlation_heatmap(_view(m, *charts.CORRELATED))),
        flat("\n        UNION ALL ".join(
            f"SELECT '{a}' AS row_column, '{b}' AS \"column\", "
            f"ROUND(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS correlation FROM flat"
            for a in charts.CORRELATED for b in charts.CORRELATED))),
    "ch8_sales_histogram": (
        lambda m: settle(charts.sales_histogram(_view(m, "sales"))),
        flat(_bins("", "(SELECT CAST(sales AS DOUBLE) AS x FROM flat) AS f"),
             _span("CAST(sales AS DOUBLE)"))),
    "ch9_outlier_histogram": (
        lambda m: settle(charts.outlier_histogram(_view(m, "profit_margin"), column="profit_margin")),
        flat(_bins("kind,", "kinds"), _span("profit_margin"), QUARTILES, FENCED, """kinds AS (
          SELECT x, CASE WHEN x < low OR x > high THEN 'Outlier' ELSE 'Typical' END AS kind
          FROM fenced)""")),
    "ch10_box_plot": (
        lambda m: settle(charts.box_plot(_view(m, "profit_margin"), "profit_margin")), flat("""
        SELECT ROUND(ANY_VALUE(q1), 6) AS q1, ROUND(ANY_VALUE(median), 6) AS median,
               ROUND(ANY_VALUE(q3), 6) AS q3, ROUND(MIN(x) FILTER (WHERE x >= low), 6) AS whisker_low,
               ROUND(MAX(x) FILTER (WHERE x <= high), 6) AS whisker_high,
               COUNT(*) FILTER (WHERE x < low OR x > high) AS fliers
        FROM fenced""", QUARTILES, FENCED)),
    "ch10_box_fliers": (
        lambda m: charts.box_fliers(_view(m, "profit_margin"), "profit_margin"), flat("""
        SELECT x AS profit_margin, COUNT(*) AS n FROM fenced WHERE x < low OR x > high GROUP BY x""",
        QUARTILES, FENCED)),
}
