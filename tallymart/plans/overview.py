"""Headline figures, group profitability and CASE-style classifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallymart.functions.measures import nonzero, pct, ratio, real, rounded
from tallymart.operators.mart import Mart


def headline_kpis(mart: Mart) -> DataFrame:
    """Q01."""
    total = mart.order_totals().agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"),
        F.count(F.lit(1)).alias("total_orders"))
    return total.select(
        rounded("revenue").alias("total_revenue"),
        rounded("profit").alias("total_profit"),
        pct("profit", "revenue").alias("profit_margin_pct"),
        "total_orders",
        F.round(ratio("revenue", "total_orders"), 2).alias("avg_order_value"))


def profitability_by(mart: Mart, dim: str) -> DataFrame:
    """Q02 (category), Q03 (region)."""
    return (
        mart.totals([dim], "line_items", "revenue", "profit")
        .select(dim, "line_items", rounded("revenue").alias("revenue"),
                rounded("profit").alias("profit"), pct("profit", "revenue").alias("margin_pct"))
        .orderBy(F.desc_nulls_first("revenue"), dim))


def discount_profile(mart: Mart) -> DataFrame:
    """Q04."""
    return mart.lines("discount", "profit_margin").agg(
        F.round(F.avg(real("discount")), 4).alias("avg_discount"),
        F.round(F.avg("profit_margin"), 4).alias("avg_margin"),
        rounded(F.min("discount")).alias("min_discount"),
        rounded(F.max("discount")).alias("max_discount"))


def thin_margin_subcategories(mart: Mart, below: float = 0.08) -> DataFrame:
    """Q05."""
    return (
        mart.totals(["subcategory_name"], "revenue", "margin_sum", "margin_count")
        .where(F.col("margin_sum") / nonzero("margin_count") < below)
        .select("subcategory_name", rounded("revenue").alias("revenue"),
                pct("margin_sum", "margin_count").alias("avg_margin_pct"))
        .orderBy("avg_margin_pct", "subcategory_name"))


def loss_making(mart: Mart, dim: str = "region_name") -> DataFrame:
    """Q08."""
    return (
        mart.totals([dim], "revenue", "profit").where("profit < 0")
        .select(dim, rounded("revenue").alias("revenue"), rounded("profit").alias("profit"))
        .orderBy("profit", dim))


def discount_tiers(mart: Mart) -> DataFrame:
    """Q09."""
    tier = (
        F.when(F.col("discount") == 0, "No discount")
        .when(F.col("discount") <= 0.10, "Low (0-10%)")
        .when(F.col("discount") <= 0.20, "Medium (11-20%)")
        .otherwise("High (21%+)"))
    return (
        mart.lines("discount", "sales", "profit_margin").groupBy(tier.alias("discount_tier"))
        .agg(F.count(F.lit(1)).alias("line_items"), rounded(F.sum("sales")).alias("revenue"),
             F.round(F.avg("profit_margin") * 100, 2).alias("avg_margin_pct"),
             F.min("discount").alias("_lowest"))
        .orderBy("_lowest").drop("_lowest"))


def shipping_speed(mart: Mart) -> DataFrame:
    """Q10."""
    days = F.datediff("ship_date", "order_date")
    speed = (
        F.when(days == 0, "Same day").when(days.between(1, 3), "1-3 days").otherwise("4+ days"))
    return (
        mart.orders("order_id", "order_date", "ship_date")
        .groupBy(speed.alias("shipping_speed"))
        .agg(F.count("order_id").alias("order_count"),
             F.round(F.avg(days), 2).alias("avg_days_to_ship"))
        .orderBy(F.asc_nulls_last("avg_days_to_ship")))


def profitable_split(mart: Mart) -> DataFrame:
    """Q11."""
    kind = F.when(F.col("profit") >= 0, "Profitable").otherwise("Loss-making")
    return (
        mart.lines("sales", "profit").groupBy(kind.alias("profitability"))
        .agg(F.count(F.lit(1)).alias("line_items"), F.sum("sales").alias("_sales"),
             F.sum("profit").alias("_profit"))
        .select("profitability", "line_items", rounded("_sales").alias("revenue"),
                rounded("_profit").alias("profit"),
                # At most two rows reach this window.
                pct("line_items", F.sum("line_items").over(Window.partitionBy()))
                .alias("pct_of_line_items")))


def margin_by_ship_mode(mart: Mart) -> DataFrame:
    """Q34."""
    return (
        mart.order_totals("ship_mode").groupBy("ship_mode")
        .agg(F.count(F.lit(1)).alias("order_count"), F.sum("revenue").alias("_revenue"),
             F.sum("profit").alias("_profit"))
        .select("ship_mode", "order_count", rounded("_revenue").alias("revenue"),
                pct("_profit", "_revenue").alias("margin_pct"))
        .orderBy(F.desc_nulls_first("margin_pct"), "ship_mode"))


def region_category_matrix(mart: Mart, categories: dict[str, str]) -> DataFrame:
    """Q32. ``categories`` maps each category to the name of its column."""
    cells = (
        mart.totals(["region_name", "category_name"], "revenue")
        .groupBy("region_name").pivot("category_name", list(categories))
        .agg(F.sum("revenue")))
    return cells.select("region_name", *[
        rounded(F.coalesce(F.col(f"`{category}`"), F.lit(0))).alias(name)
        for category, name in categories.items()]).orderBy("region_name")


def leaders(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows with the highest ``value`` of their group, ties kept.

    A maximum per group joined back: unlike a ranking window it never gathers a
    whole group in one task.
    """
    best = df.groupBy(group).agg(F.max(value).alias("_best"))
    return df.join(best, group).where(F.col(value) == F.col("_best")).drop("_best")


def best_state_per_region(mart: Mart) -> DataFrame:
    """Q33."""
    return (
        leaders(mart.totals(["region_name", "state"], "revenue"), "region_name", "revenue")
        .select("region_name", "state", rounded("revenue").alias("revenue"))
        .orderBy(F.desc_nulls_first("revenue"), "region_name", "state"))
