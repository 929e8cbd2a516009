"""The flat analytics view, its derived columns and the dashboard filter."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tallymart.operators.mart import REACHED, Mart, derived


def analytics_view(mart: Mart) -> DataFrame:
    """One row per sale with every dimension attribute; unmatched keys stay, as NULLs.

    Tables meet the one they are reached from before that meets the sales, which are many
    more: products first, as sales are then still narrow when they go on to their orders.
    """
    whole, names = dict(mart.tables), mart.tables["sales"].columns
    for table, (_, key) in REACHED.items():
        names = [key, *(c for c in [*names, *mart.tables[table].columns] if c != key)]
    for table in reversed(REACHED):
        parent, key = REACHED[table]
        whole[parent] = whole[parent].join(whole[table], key, "left")
    return add_profit_margin(add_time_features(whole["sales"].select(*names)))


def add_time_features(df: DataFrame) -> DataFrame:
    names = ("order_year", "order_month", "order_quarter")
    return df.withColumns({name: derived(name)[1] for name in names})


def add_profit_margin(df: DataFrame) -> DataFrame:
    """Profit over sales, NULL where sales are zero."""
    return df.withColumn("profit_margin", derived("profit_margin")[1])


def filter_view(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
                regions: Iterable[str] | None = None, categories: Iterable[str] | None = None,
                segments: Iterable[str] | None = None) -> DataFrame:
    """Inclusive dates and value lists; ``None`` means no filter, an empty list no rows.

    A view with ``order_year`` is filtered on that too, which skips files of tables stored
    by year.
    """
    if "order_year" in df.columns:
        if start is not None:
            df = df.where(F.col("order_year") >= start.year)
        if end is not None:
            df = df.where(F.col("order_year") <= end.year)
    if start is not None:
        df = df.where(F.col("order_date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("order_date") <= F.lit(end))
    for column, values in (("region_name", regions), ("category_name", categories),
                           ("segment", segments)):
        if values is not None:
            df = df.where(F.col(column).isin(list(values)))
    return df


def filter_options(df: DataFrame) -> DataFrame:
    """Sorted values per filter as (filter, value) rows, dates included; one pass."""
    dims = ("region_name", "category_name", "segment")
    combined = df.groupBy(*dims).agg(
        F.min("order_date").cast("string").alias("min_date"),
        F.max("order_date").cast("string").alias("max_date"))
    options = combined.unpivot([], [*dims, "min_date", "max_date"], "filter", "value")
    listed = options.where("value IS NOT NULL").groupBy("filter", "value").agg(F.lit(1))
    name, value = F.col("filter"), F.col("value")
    dates = listed.where(name.isin("min_date", "max_date")).groupBy("filter").agg(
        F.when(F.first(name) == "min_date", F.min(value)).otherwise(F.max(value)).alias("value"))
    return (
        listed.where(name.isin(*dims)).select("filter", "value").unionByName(dates)
        .orderBy("filter", "value"))
