"""Customer reports: spend, ranks, order history, RFM."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallymart.functions.measures import pct, ratio, rounded
from tallymart.operators.mart import Mart
from tallymart.plans.counts import exact_quantiles
from tallymart.plans.ordered import OrderedBlocks
from tallymart.session import stash


def frequent_customers(mart: Mart, more_than: int = 3) -> DataFrame:
    """Q06."""
    per_customer = (
        mart.order_totals("customer_id", with_profit=False).groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("order_count"), F.sum("revenue").alias("revenue"))
        .where(F.col("order_count") > more_than))
    return (
        mart.attach(per_customer, "customer_name", "segment")
        .select("customer_id", "customer_name", "segment", "order_count",
                rounded("revenue").alias("lifetime_revenue"))
        .orderBy(F.desc("order_count"), "customer_id"))


def customer_spend(mart: Mart, *names: str) -> DataFrame:
    """Lifetime spend per customer, with these customer columns."""
    per_customer = mart.totals(["customer_id"], "revenue").withColumnRenamed(
        "revenue", "lifetime_spend")
    return mart.attach(per_customer, *names)


def top_decile_customers(mart: Mart, quantile: float = 0.90) -> DataFrame:
    """Q14."""
    spend = stash(customer_spend(mart, "customer_name", "segment"), "spend")
    cutoff = exact_quantiles(spend, "lifetime_spend", {"cutoff": quantile}).scalar()
    return (
        spend.where(F.col("lifetime_spend").cast("double") >= cutoff)
        .select("customer_id", "customer_name", "segment",
                F.col("lifetime_spend").cast("double").alias("lifetime_spend"))
        .orderBy(F.desc("lifetime_spend"), "customer_id"))


def spend_rank_in_segment(mart: Mart) -> DataFrame:
    """Q15: RANK inside each segment, customers of one name merged."""
    spend = (
        customer_spend(mart, "segment", "customer_name").groupBy("segment", "customer_name")
        .agg(F.sum("lifetime_spend").alias("spend")))
    ranked = OrderedBlocks(spend, "segment", F.desc("spend"), "customer_name").rank_within(
        ["segment"], "spend", "spend_rank_in_segment")
    return (
        ranked.select("segment", "customer_name", rounded("spend").alias("total_spend"),
                      "spend_rank_in_segment")
        .orderBy("segment", "spend_rank_in_segment", "customer_name"))


def latest_order_per_customer(mart: Mart) -> DataFrame:
    """Q16: of two orders on the last day the greater order_id is taken."""
    latest = (
        mart.orders("customer_id", "order_id", "order_date").groupBy("customer_id")
        .agg(F.max(F.struct("order_date", "order_id")).alias("last")))
    return (
        mart.attach(latest, "customer_name")
        .select("customer_name", "last.order_id", "last.order_date")
        .orderBy(F.desc("order_date"), "customer_name"))


def spend_quartiles(mart: Mart) -> DataFrame:
    """Q18."""
    spend = customer_spend(mart, "customer_name")
    quartiles = OrderedBlocks(spend, F.desc("lifetime_spend"), "customer_id").ntile(
        4, "spend_quartile")
    return (
        quartiles.select("customer_name", rounded("lifetime_spend").alias("lifetime_spend"),
                         "spend_quartile")
        .orderBy(F.desc("lifetime_spend"), "customer_name"))


def order_value_changes(mart: Mart) -> DataFrame:
    """Q19: each order against the customer's order before it."""
    values = mart.order_totals("customer_id", "order_date", with_profit=False).select(
        "order_id", "customer_id", "order_date", F.col("revenue").alias("order_value"))
    history = OrderedBlocks(values, "customer_id", "order_date", "order_id").previous(
        ["customer_id"], "order_value", "before")
    return (
        mart.attach(history, "customer_name")
        .select("customer_name", "order_date", rounded("order_value").alias("order_value"),
                rounded("before").alias("previous_order_value"),
                rounded(F.col("order_value") - F.col("before")).alias("change_vs_previous"))
        .orderBy("customer_name", "order_date"))


def segment_summary(mart: Mart) -> DataFrame:
    """Q26."""
    per_customer = mart.order_totals("customer_id").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"),
        F.sum("profit").alias("profit"))
    return (
        mart.attach(per_customer, "segment").groupBy("segment")
        .agg(F.sum("orders").alias("order_count"), F.sum("revenue").alias("_revenue"),
             F.sum("profit").alias("_profit"))
        .select("segment", "order_count", rounded("_revenue").alias("revenue"),
                rounded("_profit").alias("profit"), pct("_profit", "_revenue").alias("margin_pct"),
                F.round(ratio("_revenue", "order_count"), 2).alias("avg_order_value"))
        .orderBy(F.desc_nulls_first("revenue"), "segment"))


def top_customers(mart: Mart, n: int = 10) -> DataFrame:
    """Q27: one row per customer and region the customer ordered from."""
    per_place = (
        mart.order_totals("customer_id", "location_id", with_profit=False)
        .groupBy("customer_id", "location_id")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue")))
    per_region = (
        mart.attach(per_place, "region_name").groupBy("customer_id", "region_name")
        .agg(F.sum("orders").alias("order_count"), F.sum("revenue").alias("revenue"))
        .orderBy(F.desc_nulls_first("revenue"), "customer_id", "region_name").limit(n))
    return (
        mart.attach(per_region, "customer_name", "segment")
        .select("customer_name", "segment", F.col("region_name").alias("most_recent_region"),
                rounded("revenue").alias("lifetime_revenue"), "order_count")
        .orderBy(F.desc_nulls_first("lifetime_revenue"), "customer_name"))


# -- RFM ---------------------------------------------------------------------


def rfm_values(mart: Mart) -> DataFrame:
    """Recency, frequency and monetary value per customer, written once."""
    per_customer = (
        mart.order_totals("customer_id", "order_date", with_profit=False).groupBy("customer_id")
        .agg(F.max("order_date").alias("last_order"), F.count(F.lit(1)).alias("frequency"),
             F.sum("revenue").alias("monetary")))
    customers = stash(mart.attach(per_customer, "customer_name"), "rfm")
    newest = mart.latest_order_date(customers, "last_order")
    return customers.select(
        "customer_id", "customer_name", F.datediff(newest, "last_order").alias("recency_days"),
        "frequency", "monetary")


def rfm_raw(mart: Mart) -> DataFrame:
    """Q36."""
    return (
        rfm_values(mart)
        .select("customer_name", "recency_days", "frequency", rounded("monetary").alias("monetary"))
        .orderBy(F.desc_nulls_first("monetary"), "customer_name"))


def rfm_scored(mart: Mart, best_score: int = 1) -> DataFrame:
    """Quintiles per component. Bucket 1 holds the best; ``best_score=5`` flips that."""
    if best_score not in (1, 5):
        raise ValueError("best_score must be 1 or 5")
    scored = rfm_values(mart)
    for name, order in (("r_score", F.asc("recency_days")), ("f_score", F.desc("frequency")),
                        ("m_score", F.desc("monetary"))):
        scored = OrderedBlocks(scored, order, "customer_id").ntile(5, name)
    if best_score == 5:
        scored = scored.withColumns(
            {s: 6 - F.col(s) for s in ("r_score", "f_score", "m_score")})
    return scored


def rfm_scores(mart: Mart, best_score: int = 1) -> DataFrame:
    """Q37."""
    digits = F.concat(*[F.col(s).cast("string") for s in ("r_score", "f_score", "m_score")])
    return (
        rfm_scored(mart, best_score)
        .select("customer_name", "recency_days", "frequency", rounded("monetary").alias("monetary"),
                "r_score", "f_score", "m_score", digits.alias("rfm_score"))
        .orderBy(F.desc("r_score"), F.desc("f_score"), F.desc("m_score"), "customer_name"))


def rfm_segments(mart: Mart, best_score: int = 1) -> DataFrame:
    """Q38."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    # Score limits and names of the segments.
    segment = (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r <= 2) & (f >= 4) & (m >= 4), "At Risk")
        .when((r >= 4) & (f <= 2), "New / Promising")
        .when((r <= 2) & (f <= 2) & (m <= 2), "Lost")
        .otherwise("Needs Attention"))
    return (
        rfm_scored(mart, best_score)
        .select("customer_name", "r_score", "f_score", "m_score", segment.alias("rfm_segment"))
        .orderBy("rfm_segment", F.desc("r_score"), "customer_name"))
