from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallymart.operators.mart import Mart  # noqa: E402
from tallymart.operators.view import add_profit_margin, add_time_features  # noqa: E402
from tallymart.schema import LOAD_ORDER, TABLES  # noqa: E402
from tallymart.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.chdir(tmp_path_factory.mktemp("work"))
    # Compiling plans costs more than running them on a handful of rows.
    session = local_session(4, shuffle_partitions=4, memory="4g", **{
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1"})
    yield session
    session.stop()


@pytest.fixture
def many_blocks(spark):
    """Keep the blocks of small tables apart, as on large ones."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


@pytest.fixture
def view_of(spark):
    """A flat view from short rows; missing columns get plain defaults."""
    defaults = dict(
        order_id="O-1", order_date=dt.date(2023, 1, 5), product_name="P", category_name="C",
        region_name="R", segment="S", quantity=1, discount=0.0, sales=100.0, profit=10.0)

    def build(rows):
        full = [{**defaults, **row} for row in rows]
        schema = ("order_id string, order_date date, product_name string, category_name string, "
                  "region_name string, segment string, quantity int, discount double, "
                  "sales double, profit double")
        names = [part.split()[0] for part in schema.split(", ")]
        df = spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema)
        return add_profit_margin(add_time_features(df))

    return build


RAW_BASE = {
    "row_id": "1", "order_id": "ORD-1", "order_date": "01/01/2023", "ship_date": "01/05/2023",
    "ship_mode": "Standard Class", "customer_id": "CUST-1", "customer_name": "Ann Lee",
    "segment": "Consumer", "country": "United States", "city": "New York", "state": "New York",
    "postal_code": "10001", "region": "East", "product_id": "PROD-1", "category": "Furniture",
    "sub_category": "Chairs", "product_name": "Chair", "sales": "100", "quantity": "2",
    "discount": "0.1", "profit": "20",
}


@pytest.fixture
def raw_of(spark):
    """Raw text rows, each the base row with changes; row i gets row_id i + 1."""
    def build(*changes):
        rows = [{**RAW_BASE, "row_id": str(i + 1), **c} for i, c in enumerate(changes)]
        schema = ", ".join(f"{n} string" for n in RAW_BASE)
        return spark.createDataFrame([tuple(r[n] for n in RAW_BASE) for r in rows], schema)
    return build


def tiny_rows():
    d = dt.date
    return {
        "regions": [(1, "East"), (2, "West")],
        "locations": [(1, "Boston", "MA", "02101", 1), (2, "Reno", "NV", "89501", 2)],
        "customers": [("C1", "Ann", "Consumer"), ("C2", "Bob", "Corporate"),
                      ("C3", "Cy", "Consumer")],
        "categories": [(1, "Furniture"), (2, "Technology"), (3, "Office Supplies")],
        "sub_categories": [(1, "Chairs", 1), (2, "Phones", 2), (3, "Paper", 3)],
        "products": [("P1", "Chair", 1), ("P2", "Phone", 2), ("P3", "Paper", 3),
                     ("P4", "Phone", 2)],
        "orders": [
            ("O1", d(2022, 1, 5), d(2022, 1, 5), "Same Day", "C1", 1),
            ("O2", d(2022, 1, 20), d(2022, 1, 22), "First Class", "C2", 2),
            ("O3", d(2022, 2, 3), d(2022, 2, 9), "Standard Class", "C1", 1),
            ("O4", d(2023, 1, 4), d(2023, 1, 6), "First Class", "C1", 2),
            ("O5", d(2023, 1, 4), d(2023, 1, 9), "Standard Class", "C1", 1),
            ("O6", d(2023, 3, 1), d(2023, 3, 4), "Standard Class", "C3", 2)],
        "sales": [
            (1, "O1", "P1", "100", 2, "0", "20"), (2, "O1", "P2", "300", 1, "0.1", "90"),
            (3, "O2", "P2", "600", 2, "0.2", "-50"), (4, "O3", "P3", "50", 5, "0", "5"),
            (5, "O4", "P4", "400", 1, "0.3", "-100"), (6, "O5", "P1", "150", 3, "0.1", "30"),
            (7, "O6", "P3", "0", 10, "1", "0"), (8, "O6", "P1", "250", 5, "0", "50")],
    }


@pytest.fixture
def tiny(spark):
    tables = {}
    for name in LOAD_ORDER:
        rows = tiny_rows()[name]
        if name == "sales":
            rows = [(i, o, p, Decimal(s), q, Decimal(x), Decimal(f)) for i, o, p, s, q, x, f in rows]
        tables[name] = spark.createDataFrame(rows, TABLES[name])
    return Mart(tables)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


@pytest.fixture
def monthly_of(spark):
    def build(values, start="2020-01-01"):
        numbered = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)],
                                         "i int, value double")
        return numbered.select(
            F.add_months(F.to_date(F.lit(start)), F.col("i")).alias("order_month"), "value")
    return build
