"""Reports over months and years.

The windows here run on rows already summed per month or year, so a partition
holds no more rows than the calendar has periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymart.functions.measures import pct, rounded
from tallymart.operators.mart import Mart


def _growth(value: str, window) -> Column:
    before = F.lag(value).over(window)
    return pct(F.col(value) - before, before)


def category_month_share(mart: Mart) -> DataFrame:
    """Q12."""
    month = Window.partitionBy("order_month")
    return (
        mart.totals(["order_month", "category_name"], "revenue")
        .select("order_month", "category_name", rounded("revenue").alias("revenue"),
                pct("revenue", F.sum("revenue").over(month)).alias("pct_of_month_revenue"))
        .orderBy("order_month", F.desc_nulls_first("revenue"), "category_name"))


def cumulative_revenue(mart: Mart) -> DataFrame:
    """Q20."""
    return (
        mart.totals(["order_month"], "revenue")
        .select("order_month", rounded("revenue").alias("revenue"),
                rounded(F.sum("revenue").over(Window.orderBy("order_month")))
                .alias("cumulative_revenue"))
        .orderBy("order_month"))


def rolling_revenue(mart: Mart, months: int = 3) -> DataFrame:
    """Q21: mean of the last ``months`` present months."""
    recent = Window.orderBy("order_month").rowsBetween(-(months - 1), 0)
    return (
        mart.totals(["order_month"], "revenue")
        .select("order_month", rounded("revenue").alias("revenue"),
                F.round(F.sum("revenue").over(recent).cast("double")
                        / F.count("revenue").over(recent), 2).alias(f"rolling_{months}mo_avg"))
        .orderBy("order_month"))


def cumulative_profit_by_category(mart: Mart) -> DataFrame:
    """Q22."""
    upto = Window.partitionBy("category_name").orderBy("order_month")
    return (
        mart.totals(["order_month", "category_name"], "profit")
        .select("order_month", "category_name", rounded("profit").alias("profit"),
                rounded(F.sum("profit").over(upto)).alias("cumulative_profit"))
        .orderBy("category_name", "order_month"))


def revenue_growth(mart: Mart, period: str, name: str) -> DataFrame:
    """Q23 (order_month, month over month), Q24 (order_year, year over year)."""
    return (
        mart.totals([period], "revenue")
        .select(period, rounded("revenue").alias("revenue"),
                _growth("revenue", Window.orderBy(period)).alias(name))
        .orderBy(period))


def category_yoy_growth(mart: Mart) -> DataFrame:
    """Q25."""
    years = Window.partitionBy("category_name").orderBy("order_year")
    return (
        mart.totals(["order_year", "category_name"], "revenue")
        .select("order_year", "category_name", rounded("revenue").alias("revenue"),
                _growth("revenue", years).alias("yoy_growth_pct"))
        .orderBy("category_name", "order_year"))


def new_vs_returning(mart: Mart) -> DataFrame:
    """Q28: orders on a customer's first order date are 'New'.

    Each customer's first day is moved from 'Returning' to 'New' by adding a
    positive and a negative row; no join, so a hot customer is only summed.
    """
    days = (
        mart.order_totals("order_date", "customer_id", with_profit=False, keep_unsold=True)
        .groupBy("customer_id", "order_date")
        .agg(F.count("revenue").alias("n"), F.sum("revenue").alias("amount")))
    first = days.groupBy("customer_id").agg(
        F.min("order_date").alias("order_date"), F.min_by("n", "order_date").alias("n"),
        F.min_by("amount", "order_date").alias("amount"))

    def typed(rows: DataFrame, kind: str, sign: int) -> DataFrame:
        return rows.select(
            F.trunc("order_date", "MM").alias("order_month"), F.lit(kind).alias("customer_type"),
            (F.col("n") * sign).alias("n"), (F.col("amount") * sign).alias("amount"))

    moved = (
        typed(days, "Returning", 1).unionByName(typed(first, "Returning", -1))
        .unionByName(typed(first, "New", 1)))
    return (
        moved.groupBy("order_month", "customer_type")
        .agg(F.sum("n").alias("order_count"), rounded(F.sum("amount")).alias("revenue"))
        .where("order_count > 0").orderBy("order_month", "customer_type"))
