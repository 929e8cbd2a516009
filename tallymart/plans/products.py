"""Product reports: reach, profit, margin, concentration, velocity.

Products are reported by name, so different products of one name are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallymart.functions.measures import nonzero, pct, real, rounded
from tallymart.operators.mart import Mart
from tallymart.plans.ordered import OrderedBlocks
from tallymart.plans.overview import leaders
from tallymart.session import stash


def broad_reach_products(mart: Mart, at_least: int = 5) -> DataFrame:
    """Q07."""
    return (
        mart.lines("product_name", "order_id", "quantity").groupBy("product_name")
        .agg(F.count_distinct("order_id").alias("distinct_orders"),
             F.sum("quantity").alias("total_units_sold"))
        .where(F.col("distinct_orders") >= at_least)
        .orderBy(F.desc("distinct_orders"), "product_name"))


def top_products_in_context(mart: Mart, n: int = 5) -> DataFrame:
    """Q13."""
    top = (
        mart.totals(["product_id"], "profit")
        .orderBy(F.desc_nulls_first("profit"), "product_id").limit(n))
    return (
        mart.attach(top, "product_name", "category_name", "subcategory_name")
        .select("product_name", rounded("profit").alias("total_profit"),
                "category_name", "subcategory_name")
        .orderBy(F.desc_nulls_first("total_profit"), "product_name"))


def best_product_per_category(mart: Mart) -> DataFrame:
    """Q17: best by profit, ties kept."""
    by_name = mart.totals(["category_name", "product_name"], "profit")
    return (
        leaders(by_name, "category_name", "profit")
        .select("category_name", "product_name", rounded("profit").alias("total_profit"))
        .orderBy(F.desc_nulls_first("total_profit"), "category_name", "product_name"))


def highest_margin_products(mart: Mart, floor: float = 500, n: int = 10) -> DataFrame:
    """Q29."""
    return (
        mart.totals(["product_name"], "revenue", "margin_sum", "margin_count")
        .where(F.col("revenue") >= floor)
        .select("product_name", rounded("revenue").alias("revenue"),
                pct("margin_sum", "margin_count").alias("avg_margin_pct"))
        .orderBy(F.desc_nulls_first("avg_margin_pct"), "product_name").limit(n))


def worst_products(mart: Mart, n: int = 10) -> DataFrame:
    """Q30."""
    return (
        mart.totals(["product_name"], "revenue", "profit")
        .orderBy(F.asc_nulls_last("profit"), "product_name").limit(n)
        .select("product_name", rounded("revenue").alias("revenue"),
                rounded("profit").alias("total_profit")))


def subcategory_share(mart: Mart) -> DataFrame:
    """Q31. The window holds the sub-categories of one category."""
    category = Window.partitionBy("category_name")
    return (
        mart.totals(["category_name", "subcategory_name"], "revenue")
        .select("category_name", "subcategory_name", rounded("revenue").alias("revenue"),
                pct("revenue", F.sum("revenue").over(category)).alias("pct_of_category_revenue"))
        .orderBy("category_name", F.desc_nulls_first("revenue"), "subcategory_name"))


def profit_concentration(mart: Mart, share: float = 0.8) -> DataFrame:
    """Q35: how many of the profitable products bring ``share`` of their profit.

    Products of equal profit share one running total, so they are counted
    together first; the first of them carries the reported rank.
    """
    by_profit = (
        mart.totals(["product_name"], "profit").where("profit > 0")
        .groupBy("profit").agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("amount")))
    blocks = OrderedBlocks(by_profit, F.desc("profit"))
    totals = blocks.rows.agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    products, profit = totals.select("n").scalar(), totals.select("amount").scalar()
    target = share * profit.cast("double")
    crossing = real(F.col("before_running") + F.col("within_running")) >= target
    first = (
        blocks.running_sums(only=crossing & (real("before_running") < target),
                            upto="n", running="amount")
        .where(real("running") >= target)
        .orderBy(F.desc("profit")).limit(1))
    rank = F.col("upto") - F.col("n") + 1
    return first.select(
        rank.alias("product_rank"), products.alias("total_product_count"),
        pct(rank, products, 1).alias("pct_of_products_so_far"),
        pct("running", profit, 1).alias("pct_of_profit_so_far"))


def _sold_window(mart: Mart) -> DataFrame:
    """Units and first and last order date per product name."""
    per_product = (
        mart.lines("product_id", "order_date", "quantity").groupBy("product_id")
        .agg(F.sum("quantity").alias("units"), F.min("order_date").alias("first"),
             F.max("order_date").alias("last")))
    return (
        mart.attach(per_product, "product_name").groupBy("product_name")
        .agg(F.sum("units").alias("total_units_sold"), F.min("first").alias("first"),
             F.max("last").alias("last")))


def fast_movers(mart: Mart, min_units: int = 5, n: int = 15) -> DataFrame:
    """Q39."""
    days = F.datediff("last", "first")
    months = F.greatest(days, F.lit(1)) / F.lit(30.0)
    return (
        _sold_window(mart).where(F.col("total_units_sold") >= min_units)
        .select("product_name", "total_units_sold", days.alias("active_days"),
                F.round(real("total_units_sold") / nonzero(months), 2).alias("units_per_month"))
        .orderBy(F.desc_nulls_first("units_per_month"), "product_name").limit(n))


def dormant_products(mart: Mart, n: int = 15) -> DataFrame:
    """Q40."""
    sold = stash(_sold_window(mart), "sold")
    newest = mart.latest_order_date(sold, "last")
    return (
        sold.select("product_name", F.col("last").alias("last_sold_date"),
                    F.datediff(newest, "last").alias("days_since_last_sale"), "total_units_sold")
        .orderBy(F.desc_nulls_first("days_since_last_sale"), "product_name").limit(n))


def discount_dependency(mart: Mart, min_sales: int = 5, n: int = 15) -> DataFrame:
    """Q41."""
    return (
        mart.totals(["product_name"], "line_items", "discounted", "margin_sum", "margin_count")
        .where(F.col("line_items") >= min_sales)
        .select("product_name", F.col("line_items").alias("total_sales"),
                F.col("discounted").alias("discounted_sales"),
                pct("discounted", "line_items", 1).alias("pct_sold_at_discount"),
                pct("margin_sum", "margin_count").alias("avg_margin_pct"))
        .orderBy(F.desc_nulls_first("pct_sold_at_discount"), "product_name").limit(n))
