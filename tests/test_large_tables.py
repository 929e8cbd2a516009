"""Work that must not grow faster than the tables: profiles, years, the flat view."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import rows
from tallymart import sinks
from tallymart.catalog import tables
from tallymart.operators.mart import REACHED, Mart
from tallymart.operators.view import analytics_view
from tallymart.schema import TABLES
from tallymart.sources.tables import load_by_year


def test_profile_counts_a_column_at_a_time(tiny):
    extra = tiny.tables["customers"].limit(1).withColumn("segment", F.lit(None).cast("string"))
    empty = tiny.tables["regions"].limit(0)
    mart = Mart({**tiny.tables, "regions": empty, "customers": tiny.tables["customers"].unionByName(extra)})
    found = tables._profile(mart)
    want = []
    for table, schema in TABLES.items():
        held = mart.tables[table].collect()
        for c in schema.names:
            values = [r[c] for r in held if r[c] is not None]
            want.append((table, c, len(values), len(set(values))))
    assert sorted(rows(found)) == sorted(want)
    assert ("regions", "region_id", 0, 0) in want
    # No table of a task holds the values of several columns.
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_year_of_a_sale_comes_from_the_written_orders(spark, tiny, tmp_path):
    # Whoever runs the orders again gets other dates.
    some_day = F.udf(lambda _: dt.date(random.SystemRandom().randrange(1950, 2020), 1, 5), "date").asNondeterministic()
    orders = tiny.tables["orders"].withColumn("order_date", some_day("order_id"))
    sinks.write_by_year(Mart({**tiny.tables, "orders": orders}), str(tmp_path))
    back = load_by_year(spark, str(tmp_path)).tables
    years = dict(back["orders"].select("order_id", "order_year").collect())
    sold = back["sales"].select("order_id", "order_year").collect()
    assert len(sold) == tiny.tables["sales"].count()
    assert [r.order_year for r in sold] == [years.get(r.order_id) for r in sold]


def _chained(mart):
    """The flat view as one join after the other."""
    df = mart.tables["sales"]
    for table, (_, key) in REACHED.items():
        df = df.join(mart.tables[table], key, "left")
    return df


def test_sales_meet_two_tables_in_the_flat_view(tiny):
    t = dict(tiny.tables)
    t["orders"] = t["orders"].unionByName(t["orders"].limit(1)).unionByName(
        t["orders"].limit(1).withColumn("customer_id", F.lit("nobody")))
    t["customers"] = t["customers"].unionByName(t["customers"])
    t["sales"] = t["sales"].unionByName(t["sales"].withColumn("product_id", F.lit(None).cast("string")).withColumn(
        "order_id", F.lit("none")))
    mart = Mart(t)
    view, want = analytics_view(mart), _chained(mart)
    assert view.columns[:len(want.columns)] == want.columns
    assert sorted(map(repr, rows(view.select(*want.columns)))) == sorted(map(repr, rows(want)))
    marked = Mart({**t, "sales": t["sales"].where("quantity > -4711")})
    lines = analytics_view(marked)._jdf.queryExecution().analyzed().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "-4711" in line)
    depth, joins = len(lines[at]) - len(lines[at].lstrip(" :+-")), 0
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            depth, joins = own, joins + ("Join " in line)
    assert joins == 2  # products and orders; once all seven
