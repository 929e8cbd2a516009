import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallymart.operators import quality
from tallymart.operators.clean import clean
from tallymart.operators.mart import Mart
from tallymart.operators.normalize import normalise
from tallymart.schema import LOAD_ORDER, TABLES


def lines(raw_of, *changes):
    return clean(raw_of(*[
        {"order_id": f"ORD-{i}", "customer_id": f"CUST-{i}", "product_id": f"PROD-{i}", **c}
        for i, c in enumerate(changes)]))


def test_eight_tables_with_contract_columns(raw_of):
    mart = normalise(lines(raw_of, {}, {}))
    assert set(mart.tables) == set(LOAD_ORDER)
    for name, df in mart.tables.items():
        assert [(f.name, f.dataType) for f in df.schema] == [
            (f.name, f.dataType) for f in TABLES[name]]


def test_ids_follow_first_appearance(raw_of, many_blocks):
    names = ["West", "East", "West", "South", "North", "East"]
    mart = normalise(lines(raw_of, *[{"region": n} for n in names]))
    assert sorted(rows(mart.tables["regions"])) == [
        (1, "West"), (2, "East"), (3, "South"), (4, "North")]


def test_first_row_wins_per_key(raw_of):
    mart = normalise(lines(
        raw_of, {"customer_id": "C", "customer_name": "First", "row_id": "20"},
        {"customer_id": "C", "customer_name": "Earlier", "row_id": "3"}))
    assert rows(mart.tables["customers"]) == [("C", "Earlier", "Consumer")]


def test_orders_are_unique_and_every_line_is_a_sale(raw_of, many_blocks):
    mart = normalise(lines(raw_of, *[{"order_id": f"ORD-{i % 3}"} for i in range(20)]))
    assert sorted(r[0] for r in rows(mart.tables["orders"], "order_id")) == [
        "ORD-0", "ORD-1", "ORD-2"]
    assert sorted(r[0] for r in rows(mart.tables["sales"], "sales_id")) == list(range(1, 21))
    in_order = rows(mart.tables["sales"].orderBy("sales_id"), "product_id")
    assert in_order == [(f"PROD-{i}",) for i in range(20)]


def test_one_postal_code_in_two_regions_does_not_fan_out(raw_of):
    mart = normalise(lines(raw_of, {"region": "East"}, {"region": "West"}))
    assert mart.tables["orders"].count() == 2
    assert mart.tables["locations"].count() == 2
    repeated = quality.uniqueness_report(mart).where("repeated_keys > 0")
    assert rows(repeated, "table_name", "kind") == [("locations", "unique")]


def test_one_sub_category_name_in_two_categories(raw_of):
    mart = normalise(lines(raw_of, {"category": "A"}, {"category": "B"}))
    assert mart.tables["products"].count() == 2
    assert mart.tables["sub_categories"].count() == 2


def test_dangling_foreign_key_raises(tiny):
    orphan = tiny.tables["sales"].withColumn("order_id", F.lit("NONEXISTENT-ORDER"))
    with pytest.raises(quality.DataQualityError, match="sales.order_id: 1 key.*NONEXISTENT"):
        quality.validate_integrity(Mart({**tiny.tables, "sales": orphan}))
    quality.validate_integrity(tiny)


def test_null_keys_are_not_orphans(tiny):
    nulls = tiny.tables["sales"].withColumn("order_id", F.lit(None).cast("string"))
    report = quality.integrity_report(Mart({**tiny.tables, "sales": nulls}))
    assert report.where("orphans > 0").count() == 0


def test_checks_and_nulls(tiny):
    bad = tiny.tables["sales"].withColumns(
        {"quantity": F.lit(0), "profit": F.lit(None).cast("decimal(12,4)")})
    mart = Mart({**tiny.tables, "sales": bad})
    broken = quality.check_report(mart).where("violations > 0")
    assert rows(broken, "check_name", "violations") == [("quantity > 0", 8)]
    assert rows(quality.null_report(mart).where("nulls > 0"), "column_name", "nulls") == [
        ("profit", 8)]


def test_integrity_reads_each_table_once_and_samples_the_lowest(tiny):
    sales = tiny.tables["sales"]
    lost = sales.unionByName(sales.withColumn("order_id", F.concat(F.lit("X"), 20 - F.col("sales_id"))))
    orders = tiny.tables["orders"].withColumn("location_id", F.col("location_id") * 10)
    report = quality.integrity_report(Mart({**tiny.tables, "sales": lost, "orders": orders}))
    got = {r.foreign_key: (r.orphans, r.samples) for r in report.collect()}
    assert got["sales.order_id"] == (8, "X12, X13, X14, X15, X16")
    assert got["orders.location_id"] == (2, "10, 20") and got["sales.product_id"] == (0, "")
    assert len(got) == 7
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the names of the seven keys
