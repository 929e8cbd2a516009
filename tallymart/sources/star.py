"""Adapter: a TPC-H-like star schema read as the eight retail tables.

Kept sales are the line items shipped on or after their order's date. The star
has no profit, so it is the discounted price less quantity times retail price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymart.operators.mart import Mart
from tallymart.plans.ordered import dense_ids
from tallymart.schema import MONEY, RATE

_PART_COLUMNS = {"profit", "product_name", "subcategory_name", "category_name",
                 "subcategory_id", "category_id"}
_ORDER_COLUMNS = ("order_date", "ship_mode", "customer_id", "location_id")


class StarMart(Mart):
    """A mart over star-schema Parquet files, joined on the star's own keys."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        super().__init__({})

    def raw(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    # -- the fact: line items with the attributes of their order ---------------

    def _fact(self, plain: set[str]) -> DataFrame:
        """Kept lines; order attributes come with the join that selects them."""
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("o_orderpriority").alias("ship_mode"),
            F.col("o_custkey").alias("customer_id"))
        wants_location = plain & {"location_id", "city", "state", "postal_code",
                                  "region_id", "region_name"}
        if wants_location:
            named = [c for c in ("customer_name", "segment") if c in plain]
            orders = orders.join(self._dimension("customers").select(
                "customer_id", "location_id", *named), "customer_id")
        price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_shipdate").cast("date").alias("line_ship_date"),
            price.cast(MONEY).alias("sales"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_discount").cast(RATE).alias("discount"),
            price.alias("_price"), F.col("l_quantity").alias("_units"),
            *[c for c in ("l_linenumber", "l_suppkey", "l_tax", "l_returnflag", "l_linestatus",
                          "l_extendedprice") if c in plain])
        kept = lines.join(orders, "order_id").where(F.col("line_ship_date") >= F.col("order_date"))
        if plain & _PART_COLUMNS:
            kept = kept.join(self._dimension("products"), "product_id")
            cost = F.col("_units") * F.col("_retail_price")
            kept = kept.withColumn("profit", (F.col("_price") - cost).cast(MONEY))
        return kept.drop("_price", "_units", "_retail_price")

    def _dimension(self, table: str) -> DataFrame:
        if table == "products":
            return self.raw("part").select(
                F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
                F.col("p_brand").alias("subcategory_name"), F.col("p_type").alias("category_name"),
                F.col("p_retailprice").alias("_retail_price"))
        if table == "customers":
            return self.raw("customer").select(
                F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
                F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("location_id"))
        if table == "locations":
            return self.raw("nation").select(
                F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("city"),
                F.col("n_name").alias("state"), F.lit("UNKNOWN").alias("postal_code"),
                F.col("n_regionkey").alias("region_id"))
        return self.raw("region").select(
            F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))

    def _join_dimensions(self, df: DataFrame, wanted: set[str]) -> DataFrame:
        """As the normalised mart, but part carries its own (sub-)category names."""
        missing = {c for c in wanted if c not in df.columns}
        if missing & {"product_name", "subcategory_name", "category_name"}:
            df = df.join(self._dimension("products").drop("_retail_price"), "product_id")
        if missing & {"customer_name", "segment"}:
            df = df.join(self._dimension("customers").drop("location_id"), "customer_id")
        if missing & {"city", "state", "postal_code", "region_name"}:
            df = df.join(self._dimension("locations"), "location_id")
        if "region_name" in missing:
            df = df.join(self._dimension("regions"), "region_id")
        return df

    # -- orders ----------------------------------------------------------------

    def orders(self, *columns: str) -> DataFrame:
        """Orders with a kept line; shipped when the first of those lines is."""
        plain = self._plain(columns)
        carried = [c for c in _ORDER_COLUMNS if c in plain or (
            c == "customer_id" and plain & {"customer_name", "segment"}) or (
            c == "location_id" and plain & {"city", "state", "region_name"})]
        shipped = self._fact({*carried, "order_id"}).groupBy("order_id", *carried).agg(
            F.min("line_ship_date").alias("ship_date"))
        return self._project(self._join_dimensions(shipped, plain), columns)

    def order_totals(self, *columns: str, with_profit: bool = True,
                     keep_unsold: bool = False) -> DataFrame:
        plain = self._plain(columns)
        sums = [F.sum("sales").alias("revenue")]
        if with_profit:
            sums.append(F.sum("profit").alias("profit"))
        need = {"order_id", "sales", *plain, *(["profit"] if with_profit else [])}
        grouped = self._fact(need).groupBy("order_id", *sorted(plain)).agg(*sums)
        measures = [c for c in ("revenue", "profit") if c in grouped.columns]
        return self._project(grouped, ["order_id", *columns, *measures])

    def latest_order_date(self, sold: DataFrame, column: str) -> Column:
        # Every order here has a kept line, so the newest sold order is the newest.
        return sold.agg(F.max(column)).scalar()

    # -- the eight tables --------------------------------------------------------

    def normalised(self) -> Mart:
        """The eight tables themselves, surrogate keys included."""
        part = self.raw("part")
        categories = dense_ids(
            part.select(F.col("p_type").alias("category_name")).distinct(),
            "category_id", "category_name")
        pairs = part.select(
            F.col("p_brand").alias("subcategory_name"), F.col("p_type").alias("category_name")
        ).distinct()
        named = dense_ids(pairs, "subcategory_id", "category_name", "subcategory_name")
        ids = named.join(categories, "category_name").select(
            F.col("subcategory_id").cast("int"), "subcategory_name",
            F.col("category_id").cast("int"), "category_name")
        products = self._dimension("products").join(ids, ["subcategory_name", "category_name"])
        tie = ("order_id", "l_linenumber", "product_id", "l_suppkey", "quantity",
               "l_extendedprice", "discount", "l_tax", "l_returnflag", "l_linestatus",
               "line_ship_date")
        sale = ("sales", "profit")
        lines = self._fact({*tie, *sale}).select(*tie, *sale)
        sales = dense_ids(lines, "sales_id", *tie)
        return Mart({
            "regions": self._dimension("regions").select("region_id", "region_name"),
            "locations": self._dimension("locations"),
            "customers": self._dimension("customers").drop("location_id"),
            "categories": categories.select(F.col("category_id").cast("int"), "category_name"),
            "sub_categories": ids.select("subcategory_id", "subcategory_name", "category_id"),
            "products": products.select("product_id", "product_name", "subcategory_id"),
            "orders": self.orders("order_id", "order_date", "ship_date", "ship_mode",
                                  "customer_id", "location_id"),
            "sales": sales.select("sales_id", "order_id", "product_id", "sales", "quantity",
                                  "discount", "profit"),
        })
