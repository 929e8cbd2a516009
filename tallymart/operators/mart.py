"""The eight tables and the joins between them, each defined once.

Reports ask a mart for columns; the mart joins only the tables that own them.
Measures are summed per foreign key before a dimension is joined, so the join
sees one row per key and a hot product or customer costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tallymart.functions.measures import line_margin

# Which table owns a column, and through which key a table is reached.
_OWNED = {
    "sales": ("sales_id", "order_id", "product_id", "sales", "quantity", "discount", "profit"),
    "orders": ("order_date", "ship_date", "ship_mode", "customer_id", "location_id"),
    "customers": ("customer_name", "segment"),
    "locations": ("city", "state", "postal_code", "region_id"),
    "regions": ("region_name",),
    "products": ("product_name", "subcategory_id"),
    "sub_categories": ("subcategory_name", "category_id"),
    "categories": ("category_name",),
}
OWNER = {column: table for table, columns in _OWNED.items() for column in columns}
REACHED = {
    "orders": ("sales", "order_id"),
    "customers": ("orders", "customer_id"),
    "locations": ("orders", "location_id"),
    "regions": ("locations", "region_id"),
    "products": ("sales", "product_id"),
    "sub_categories": ("products", "subcategory_id"),
    "categories": ("sub_categories", "category_id"),
}

# Derived columns: what they need and how they are computed.
DERIVED: dict[str, tuple[tuple[str, ...], Column]] = {}


def derived(name: str) -> tuple[tuple[str, ...], Column]:
    if not DERIVED:
        date = F.col("order_date")
        DERIVED.update({
            "order_year": (("order_date",), F.year(date)),
            "order_month": (("order_date",), F.trunc(date, "MM")),
            "order_quarter": (
                ("order_date",),
                F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))),
            "profit_margin": (("profit", "sales"), line_margin()),
        })
    return DERIVED[name]


DERIVED_NAMES = ("order_year", "order_month", "order_quarter", "profit_margin")

# Measures that can be summed per key first and summed again later.
def measure(name: str) -> Column:
    return {
        "line_items": lambda: F.count(F.lit(1)),
        "revenue": lambda: F.sum("sales"),
        "profit": lambda: F.sum("profit"),
        "units": lambda: F.sum("quantity"),
        "margin_sum": lambda: F.sum("profit_margin"),
        "margin_count": lambda: F.count("profit_margin"),
        "discounted": lambda: F.count_if(F.col("discount") > 0),
    }[name]()


_MEASURE_INPUTS = {
    "line_items": (), "revenue": ("sales",), "profit": ("profit",), "units": ("quantity",),
    "margin_sum": ("profit_margin",), "margin_count": ("profit_margin",),
    "discounted": ("discount",),
}


class Mart:
    """The eight normalised tables, given as DataFrames."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    #: Columns on which sales and orders meet.
    order_keys = ("order_id",)

    # -- joins ---------------------------------------------------------------

    def lines(self, *columns: str) -> DataFrame:
        """One row per sale with just these columns, joining just their tables."""
        plain = self._plain(columns)
        df = self._fact(plain)
        return self._project(self._join_dimensions(df, plain), columns)

    def attach(self, df: DataFrame, *columns: str) -> DataFrame:
        """Add dimension columns to rows that carry the key leading to them."""
        return self._join_dimensions(df, set(columns)).select(*df.columns, *columns)

    def orders(self, *columns: str) -> DataFrame:
        """One row per order."""
        plain = self._plain(columns)
        return self._project(self._join_dimensions(self.tables["orders"], plain), columns)

    def order_totals(self, *columns: str, with_profit: bool = True,
                     keep_unsold: bool = False) -> DataFrame:
        """One row per order: ``revenue``, ``profit`` and these order columns."""
        sums = self._fact({"order_id", "sales", "profit"}).groupBy("order_id").agg(
            F.sum("sales").alias("revenue"), F.sum("profit").alias("profit"))
        if not columns:
            return sums
        attributes = self.orders("order_id", *columns)
        return attributes.join(sums, "order_id", "left" if keep_unsold else "inner")

    def latest_order_date(self, sold: DataFrame, column: str) -> Column:
        """The newest order date of all, as a scalar.

        ``sold`` already holds the newest sold order date per group in ``column``;
        a mart in which every order has a sale can use it instead of a new scan.
        """
        return self.tables["orders"].agg(F.max("order_date")).scalar()

    # -- grouped sums --------------------------------------------------------

    def totals(self, dims: Iterable[str], *measures: str) -> DataFrame:
        """Sums per group: first per foreign key, then per dimension value."""
        dims = list(dims)
        keys, attached = [], []
        for dim in dims:
            key = self._line_key(dim)
            if key not in keys:
                keys.append(key)
            if key != dim:
                attached.append(dim)
        inputs = {c for m in measures for c in _MEASURE_INPUTS[m]}
        per_key = (
            self.lines(*keys, *sorted(inputs - set(keys)))
            .groupBy(*keys).agg(*[measure(m).alias(m) for m in measures]))
        if not attached:
            return per_key
        return (
            self.attach(per_key, *attached)
            .groupBy(*dims).agg(*[F.sum(m).alias(m) for m in measures]))

    def _line_key(self, dim: str) -> str:
        """The key on a sale or its order from which ``dim`` can be looked up."""
        table = OWNER.get(dim)
        if table in (None, "sales", "orders"):
            return dim
        while REACHED[table][0] not in ("sales", "orders"):
            table = REACHED[table][0]
        return REACHED[table][1]

    # -- helpers -------------------------------------------------------------

    def _plain(self, columns: Iterable[str]) -> set[str]:
        plain: set[str] = set()
        for c in columns:
            plain.update(derived(c)[0] if c in DERIVED_NAMES else (c,))
        return plain

    def _project(self, df: DataFrame, columns: Iterable[str]) -> DataFrame:
        return df.select(*[
            derived(c)[1].alias(c) if c in DERIVED_NAMES else F.col(c) for c in columns])

    def _fact(self, plain: set[str]) -> DataFrame:
        """Sales, joined to their orders when an order column or key is needed."""
        sales = self.tables["sales"]
        if any(self._needs_order(c) for c in plain):
            return sales.join(self.tables["orders"], list(self.order_keys))
        return sales

    def _needs_order(self, column: str) -> bool:
        table = OWNER[column]
        while table in REACHED:
            if table == "orders":
                return True
            table = REACHED[table][0]
        return False

    def _dimension(self, table: str) -> DataFrame:
        return self.tables[table]

    def _join_dimensions(self, df: DataFrame, wanted: set[str]) -> DataFrame:
        needed = {OWNER[c] for c in wanted if c not in df.columns}
        for table in list(needed):
            while table in REACHED and REACHED[table][1] not in df.columns:
                table = REACHED[table][0]
                needed.add(table)
        for table, (_, key) in REACHED.items():
            if table in needed and table != "orders":
                df = df.join(self._dimension(table), key)
        return df


class YearMart(Mart):
    """A mart whose orders and sales carry ``order_year`` and are stored by it.

    They meet on the year as well, so a filter on it, however it got there, holds for the
    files of both.
    """

    order_keys = ("order_id", "order_year")

    def _needs_order(self, column: str) -> bool:
        return column != "order_year" and super()._needs_order(column)

    def _plain(self, columns: Iterable[str]) -> set[str]:
        """The year is stored, not derived."""
        return super()._plain(c for c in columns if c != "order_year")

    def _project(self, df: DataFrame, columns: Iterable[str]) -> DataFrame:
        return df.select(*[
            derived(c)[1].alias(c) if c in DERIVED_NAMES and c != "order_year" else F.col(c)
            for c in columns])
