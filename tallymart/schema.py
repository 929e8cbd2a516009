"""Contracts of the raw order-line file and of the eight retail tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Header names the raw order-line file must carry.
RAW_COLUMNS = (
    "Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode",
    "Customer ID", "Customer Name", "Segment", "Country", "City", "State",
    "Postal Code", "Region", "Product ID", "Category", "Sub-Category",
    "Product Name", "Sales", "Quantity", "Discount", "Profit",
)

# Field texts that count as missing in a raw file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# The column that holds the text of a row with too few or too many fields.
MALFORMED = "malformed_record"

MONEY = T.DecimalType(12, 4)
RATE = T.DecimalType(5, 4)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, False) for name, kind in fields])


_INT, _LONG, _TEXT, _DATE = T.IntegerType(), T.LongType(), T.StringType(), T.DateType()

# Parents come before children, so the order is also a safe load order.
TABLES: dict[str, T.StructType] = {
    "regions": _struct(("region_id", _INT), ("region_name", _TEXT)),
    "locations": _struct(
        ("location_id", _INT), ("city", _TEXT), ("state", _TEXT),
        ("postal_code", _TEXT), ("region_id", _INT)),
    "customers": _struct(
        ("customer_id", _TEXT), ("customer_name", _TEXT), ("segment", _TEXT)),
    "categories": _struct(("category_id", _INT), ("category_name", _TEXT)),
    "sub_categories": _struct(
        ("subcategory_id", _INT), ("subcategory_name", _TEXT), ("category_id", _INT)),
    "products": _struct(
        ("product_id", _TEXT), ("product_name", _TEXT), ("subcategory_id", _INT)),
    "orders": _struct(
        ("order_id", _TEXT), ("order_date", _DATE), ("ship_date", _DATE),
        ("ship_mode", _TEXT), ("customer_id", _TEXT), ("location_id", _INT)),
    "sales": _struct(
        ("sales_id", _LONG), ("order_id", _TEXT), ("product_id", _TEXT),
        ("sales", MONEY), ("quantity", _INT), ("discount", RATE), ("profit", MONEY)),
}

LOAD_ORDER = tuple(TABLES)

PRIMARY_KEYS = {
    "regions": "region_id", "locations": "location_id", "customers": "customer_id",
    "categories": "category_id", "sub_categories": "subcategory_id",
    "products": "product_id", "orders": "order_id", "sales": "sales_id",
}

UNIQUE_KEYS = {
    "regions": ("region_name",),
    "locations": ("city", "state", "postal_code"),
    "categories": ("category_name",),
    "sub_categories": ("subcategory_name", "category_id"),
}

# (child table, foreign key, parent table); the key has one name on both sides.
FOREIGN_KEYS = (
    ("locations", "region_id", "regions"),
    ("sub_categories", "category_id", "categories"),
    ("products", "subcategory_id", "sub_categories"),
    ("orders", "customer_id", "customers"),
    ("orders", "location_id", "locations"),
    ("sales", "order_id", "orders"),
    ("sales", "product_id", "products"),
)

CHECKS = {
    "orders": {"ship_date >= order_date": "ship_date >= order_date"},
    "sales": {
        "sales >= 0": "sales >= 0",
        "quantity > 0": "quantity > 0",
        "0 <= discount <= 1": "discount BETWEEN 0 AND 1",
    },
}
