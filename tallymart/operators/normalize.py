"""Cleaned order lines decomposed into the eight tables.

"First" always means the lowest row_id. Rows without one come last, and among rows
with the same one the values decide, so the order is total and never NULL. Per-key
firsts are aggregates (merged before the shuffle); surrogate keys are dense and
numbered in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymart.operators.mart import Mart
from tallymart.operators.quality import validate_integrity
from tallymart.plans.ordered import dense_ids
from tallymart.session import stash

_LAST = (1 << 63) - 1


def _row() -> Column:
    return F.coalesce("row_id", F.lit(_LAST))


def first_rows(lines: DataFrame, *columns: str) -> DataFrame:
    """The different values with the row_id of their first row."""
    return lines.groupBy(*columns).agg(F.min(_row()).alias("row_id"))


def _numbered(lines: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct values, numbered from 1 in order of first appearance."""
    numbered = dense_ids(first_rows(lines, *columns), name, "row_id", *columns)
    return numbered.withColumn(name, F.col(name).cast("int")).drop("row_id")


def _first_row(lines: DataFrame, key: str, *columns: str) -> DataFrame:
    order = F.struct(_row(), *columns)
    first = lines.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("row"))
    return first.select(key, *[f"row.{c}" for c in columns])


def regions(lines: DataFrame) -> DataFrame:
    """NRM1."""
    return _numbered(lines, ["region"], "region_id").select(
        "region_id", F.col("region").alias("region_name"))


def _places(lines: DataFrame, region_table: DataFrame) -> DataFrame:
    places = _numbered(lines, ["city", "state", "postal_code", "region"], "location_id")
    return places.join(region_table.withColumnRenamed("region_name", "region"), "region", "left")


_LOCATION = ("location_id", "city", "state", "postal_code", "region_id")


def locations(lines: DataFrame, region_table: DataFrame) -> DataFrame:
    """NRM2."""
    return _places(lines, region_table).select(*_LOCATION)


def customers(lines: DataFrame) -> DataFrame:
    """NRM3."""
    return _first_row(lines, "customer_id", "customer_name", "segment")


def categories(lines: DataFrame) -> DataFrame:
    """NRM4."""
    return _numbered(lines, ["category"], "category_id").select(
        "category_id", F.col("category").alias("category_name"))


def sub_categories(lines: DataFrame, category_table: DataFrame) -> DataFrame:
    """NRM5."""
    pairs = _numbered(lines, ["sub_category", "category"], "subcategory_id")
    named = category_table.withColumnRenamed("category_name", "category")
    return pairs.join(named, "category", "left").select(
        "subcategory_id", F.col("sub_category").alias("subcategory_name"), "category_id")


def products(lines: DataFrame, subcategory_table: DataFrame,
             category_table: DataFrame) -> DataFrame:
    """NRM6: matched on sub-category and category, as names alone may repeat."""
    first = _first_row(lines, "product_id", "product_name", "sub_category", "category")
    named = subcategory_table.join(category_table, "category_id").select(
        "subcategory_id", F.col("subcategory_name").alias("sub_category"),
        F.col("category_name").alias("category"))
    return first.join(named, ["sub_category", "category"], "left").select(
        "product_id", "product_name", "subcategory_id")


def orders(lines: DataFrame, location_table: DataFrame, region_table: DataFrame) -> DataFrame:
    """NRM7: matched on the region too, as one postal code may lie in two regions."""
    place = ["city", "state", "postal_code", "region"]
    first = _first_row(
        lines, "order_id", "order_date", "ship_date", "ship_mode", "customer_id", *place)
    known = location_table.join(region_table, "region_id").withColumnRenamed(
        "region_name", "region").select("location_id", *place)
    return first.join(known, place, "left").select(
        "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "location_id")


def sales(lines: DataFrame) -> DataFrame:
    """NRM8: every line, numbered 1..n in row_id order, ties by value."""
    measures = ("order_id", "product_id", "sales", "quantity", "discount", "profit")
    placed = lines.select(_row().alias("row_id"), *measures)
    return dense_ids(placed, "sales_id", "row_id", *measures).select("sales_id", *measures)


def normalise(cleaned: DataFrame, check: bool = True, stored: bool = False) -> Mart:
    """NRM9: the eight tables, integrity checked.

    Eight builders read the lines, so they are written once first, unless they
    are ``stored`` already. The check reads each table several times, so with it
    the tables are written once as well.
    """
    lines = cleaned if stored else stash(cleaned, "cleaned")
    # The first row of each place and of each category pair is found once; the
    # four tables of names need no more of the lines than that.
    places = stash(first_rows(lines, "city", "state", "postal_code", "region"), "places")
    pairs = stash(first_rows(lines, "sub_category", "category"), "pairs")
    region_table, category_table = regions(places), categories(pairs)
    location_table = locations(places, region_table)
    subcategory_table = sub_categories(pairs, category_table)
    tables = {
        "regions": region_table,
        "locations": location_table,
        "customers": customers(lines),
        "categories": category_table,
        "sub_categories": subcategory_table,
        "products": products(lines, subcategory_table, category_table),
        "orders": orders(lines, location_table, region_table),
        "sales": sales(lines),
    }
    if not check:
        return Mart(tables)
    mart = Mart({name: stash(table, name) for name, table in tables.items()})
    validate_integrity(mart)
    return mart
