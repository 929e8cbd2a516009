"""KPIs and the datasets behind each chart, on the flat analytics view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallymart.functions.measures import ratio, real
from tallymart.operators.mart import Mart
from tallymart.plans.counts import ValueCounts, fences_of
from tallymart.plans.stats import correlation_matrix

CORRELATED = ("sales", "quantity", "discount", "profit", "profit_margin")


def kpis(view: DataFrame) -> DataFrame:
    """KPI1. NULL margin and order value where there is nothing to divide by."""
    per_order = view.groupBy("order_id").agg(
        F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))
    total = per_order.agg(
        F.coalesce(F.sum("sales"), F.lit(0)).alias("sales"),
        F.coalesce(F.sum("profit"), F.lit(0)).alias("profit"),
        F.count("order_id").alias("total_orders"))
    return total.select(
        real("sales").alias("total_revenue"), real("profit").alias("total_profit"),
        ratio("profit", "sales").alias("profit_margin"), "total_orders",
        ratio("sales", "total_orders").alias("avg_order_value"))


def summed_view(mart: Mart, *dims: str) -> DataFrame:
    """``dims``, sales and profit of a mart, summed per key before a dimension is joined.

    For the charts that only sum: they read it like a view with a row per sale.
    """
    return mart.totals(list(dims), "revenue", "profit").withColumnRenamed("revenue", "sales")


def _sums(view: DataFrame, dim: str, *measures: str) -> DataFrame:
    return view.groupBy(dim).agg(*[real(F.sum(m)).alias(m) for m in measures])


def monthly_trend(view: DataFrame) -> DataFrame:
    """CH1."""
    return _sums(view, "order_month", "sales", "profit").orderBy("order_month")


def performance_by(view: DataFrame, dim: str) -> DataFrame:
    """CH2 (category_name), CH3 (region_name)."""
    return _sums(view, dim, "sales", "profit").orderBy(F.desc("sales"), dim)


def top_products(view: DataFrame, n: int = 10, metric: str = "profit",
                 ascending: bool = False) -> DataFrame:
    """CH4: top (or, ascending, bottom) products by name."""
    if metric not in ("profit", "sales"):
        raise ValueError("metric must be 'profit' or 'sales'")
    order = F.asc(metric) if ascending else F.desc(metric)
    return _sums(view, "product_name", metric).orderBy(order, "product_name").limit(n)


def discount_points(view: DataFrame) -> DataFrame:
    """CH5: one point per sale."""
    return view.select("discount", "profit_margin", "product_name", "category_name")


def discount_grid(view: DataFrame, margin_step: float = 0.1) -> DataFrame:
    """CH5 for large data: how many points fall in each discount and margin cell."""
    step = F.lit(margin_step)
    cell = F.floor(F.round(F.col("profit_margin") / step, 8)) * step
    return (
        view.where("discount IS NOT NULL AND profit_margin IS NOT NULL")
        .groupBy(real("discount").alias("discount"), F.round(cell, 8).alias("margin_from"))
        .agg(F.count(F.lit(1)).alias("points")))


def segment_share(view: DataFrame) -> DataFrame:
    """CH6."""
    return _sums(view, "segment", "sales").orderBy(F.desc("sales"), "segment")


def correlation_heatmap(view: DataFrame) -> DataFrame:
    """CH7."""
    return correlation_matrix(view, CORRELATED)


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """CH8: equal-width bins from minimum to maximum; the maximum is in the last.

    Empty bins have no row. Where all values are equal the range is one wide around them.
    """
    return ValueCounts(df, column).bins(bins)


def sales_histogram(view: DataFrame, bins: int = 40) -> DataFrame:
    """CH8."""
    return histogram(view, "sales", bins)


def outlier_histogram(view: DataFrame, flagged: DataFrame | None = None,
                      bins: int = 40, column: str = "sales") -> DataFrame:
    """CH9: ``flagged`` has the column and ``is_outlier``; by default the IQR rule."""
    if flagged is None:
        counts = ValueCounts(view, column)
        outlier = counts.fences().outside(F.col("value"))
    else:
        counts = ValueCounts(flagged, column, by="is_outlier")
        outlier = F.col("is_outlier")
    return counts.bins(bins, F.when(outlier, "Outlier").otherwise("Typical"))


def box_plot(df: DataFrame, column: str = "sales") -> DataFrame:
    """CH10: quartiles, whiskers at the furthest point inside the fences, fliers beyond."""
    counts = ValueCounts(df, column)
    q1, median, q3 = counts.quantiles(0.25, 0.5, 0.75)
    fences = fences_of(q1, q3)
    outside = fences.outside(F.col("value"))
    inside = F.when(~outside, F.col("value"))
    fixed = [F.lit(v).cast("double").alias(n) for n, v in (("q1", q1), ("median", median), ("q3", q3))]
    return counts.table.agg(
        F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
        F.coalesce(F.sum(F.when(outside, F.col("copies"))), F.lit(0)).alias("fliers")).select(
        *fixed, "whisker_low", "whisker_high", "fliers")


def box_fliers(df: DataFrame, column: str = "sales") -> DataFrame:
    """CH10: the points beyond the fences, counted per value."""
    counts = ValueCounts(df, column)
    return counts.table.where(counts.fences().outside(F.col("value"))).select(
        F.col("value").alias(column), F.col("copies").alias("n")).orderBy(column)
