import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import RAW_BASE, rows
from tallymart import sinks
from tallymart.operators.mart import Mart
from tallymart.operators.quality import row_counts
from tallymart.schema import LOAD_ORDER, RAW_COLUMNS
from tallymart.sources.raw_csv import SchemaValidationError, load_raw, standard_name
from tallymart.operators.view import filter_view
from tallymart.session import scratch_dir
from tallymart.sources.tables import catalog_tables, first_available, load_by_year, load_tables


def raw_file(tmp_path, *changes, header=RAW_COLUMNS, name="raw.csv"):
    path = tmp_path / name
    lines = [",".join(header)]
    for i, change in enumerate(changes):
        row = {**RAW_BASE, "row_id": str(i + 1), "order_id": f"O{i}", "product_id": f"P{i}", **change}
        lines.append(",".join(row.get(standard_name(h), "x") for h in header))
    path.write_bytes("\n".join(lines).encode("latin-1"))
    return str(path)


def test_raw_file(spark, tmp_path):
    path = raw_file(tmp_path, {"product_name": "Caf\xe9 \xbd"}, {"product_name": '"Big, ""red"""'},
                    {"postal_code": "NA", "profit": "N/A", "city": ""})
    df = load_raw(spark, path)
    assert df.columns == [standard_name(c) for c in RAW_COLUMNS]
    got = df.orderBy("row_id").collect()
    assert [r.product_name for r in got] == ["Caf\xe9 \xbd", 'Big, "red"', "Chair"]
    assert (got[2].postal_code, got[2].profit, got[2].city) == (None, None, None)
    assert got[0].postal_code == "10001"


def test_header_may_have_more_but_not_less(spark, tmp_path):
    assert "extra_thing" in load_raw(
        spark, raw_file(tmp_path, {}, header=(*RAW_COLUMNS, " Extra-Thing "))).columns
    short = [c for c in RAW_COLUMNS if c not in ("Sales", "City")]
    with pytest.raises(SchemaValidationError, match=r"\['City', 'Sales'\]"):
        load_raw(spark, raw_file(tmp_path, {}, header=short, name="short.csv"))
    with pytest.raises(FileNotFoundError):
        load_raw(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_tables_survive_a_round_trip(spark, tiny, tmp_path, fmt):
    sinks.write_tables(tiny, str(tmp_path), fmt)
    back = load_tables(spark, str(tmp_path), fmt)
    for name in LOAD_ORDER:
        assert back.tables[name].dtypes == tiny.tables[name].dtypes
        assert sorted(rows(back.tables[name])) == sorted(rows(tiny.tables[name]))


def test_a_missing_table_is_named(spark, tiny, tmp_path):
    with pytest.raises(FileNotFoundError, match="regions"):
        load_tables(spark, str(tmp_path))


@pytest.mark.parametrize("buckets", [None, 4])
def test_catalog_load_appends_and_recreate_empties(spark, tiny, buckets):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    sinks.recreate_tables(spark, "shop", buckets)
    sinks.load_all_tables(tiny, "shop", buckets)
    assert dict(rows(row_counts(catalog_tables(spark, "shop"))))["sales"] == 8
    sinks.append_table(tiny.tables["sales"], "sales", "shop", buckets)
    assert dict(rows(row_counts(catalog_tables(spark, "shop"))))["sales"] == 16
    sinks.recreate_tables(spark, "shop", buckets)
    assert {n for _, n in rows(row_counts(catalog_tables(spark, "shop")))} == {0}


def test_bucketed_sales_and_orders_join_without_a_shuffle(spark, tiny):
    spark.sql("CREATE DATABASE IF NOT EXISTS buckets")
    sinks.recreate_tables(spark, "buckets", 4)
    sinks.load_all_tables(tiny, "buckets", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = catalog_tables(spark, "buckets").lines("order_id", "sales", "order_date")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 8


def test_load_needs_all_tables(tiny):
    with pytest.raises(KeyError, match="orders"):
        sinks.load_all_tables(Mart({n: t for n, t in tiny.tables.items() if n != "orders"}))


def test_fallback(tiny):
    def broken():
        raise RuntimeError("down")
    with pytest.warns(UserWarning, match="down"):
        assert first_available([broken, lambda: tiny]) is tiny
    with pytest.warns(UserWarning), pytest.raises(RuntimeError):
        first_available([broken])


def test_bulk_load(spark, tiny, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS bulk")
    sinks.write_tables(tiny, str(tmp_path), "csv")
    sinks.recreate_tables(spark, "bulk")
    sinks.bulk_load_csv(spark, str(tmp_path), "bulk")
    assert sorted(rows(spark.table("bulk.orders"))) == sorted(rows(tiny.tables["orders"]))


def test_pipeline(spark, tmp_path):
    path = raw_file(tmp_path, {}, {"region": "West"}, {"quantity": "0"}, {"sales": ""})
    spark.sql("CREATE DATABASE IF NOT EXISTS pipe")
    result = sinks.run_pipeline(spark, path, str(tmp_path / "out"), database="pipe", buckets=2)
    assert dict(rows(result.drops)) == {"quantity not positive": 1, "missing critical field": 1}
    counts = dict(rows(result.counts))
    assert (counts["sales"], counts["orders"], counts["regions"], counts["customers"]) == (2, 2, 2, 1)
    assert result.mart.lines("sales", "region_name").agg(F.count("region_name")).first()[0] == 2


def test_export(spark, tiny, tmp_path):
    sinks.export_csv(tiny.lines("order_id", "sales"), str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == 8


def test_files_must_share_one_header(spark, tmp_path):
    folder = tmp_path / "two"
    folder.mkdir()
    raw_file(folder, {}, name="a.csv")
    swapped = list(RAW_COLUMNS)
    a, b = swapped.index("Sales"), swapped.index("Profit")
    swapped[a], swapped[b] = swapped[b], swapped[a]
    raw_file(folder, {}, header=swapped, name="b.csv")
    with pytest.raises(Exception, match="header"):
        load_raw(spark, str(folder)).collect()


def test_pipeline_keeps_names_without_usable_row_ids(spark, tmp_path):
    path = raw_file(tmp_path, {"row_id": "x"}, {"row_id": "", "customer_id": "NULL"}, {"row_id": "1.0"},
                    {"row_id": "1.0", "product_name": '"two\nlines"'})
    result = sinks.run_pipeline(spark, path, str(tmp_path / "out"), quoted_newlines=True)
    tables = result.mart.tables
    assert dict(rows(result.drops)) == {"missing critical field": 1}
    assert tables["sales"].orderBy("sales_id").select("product_id").collect() == [
        ("P2",), ("P3",), ("P0",)]
    assert tables["customers"].where("customer_name IS NULL OR segment IS NULL").count() == 0
    assert tables["orders"].where("order_date IS NULL OR location_id IS NULL").count() == 0
    assert tables["products"].where("product_name = 'two\nlines'").count() == 1


def bad_file(tmp_path):
    """Two good rows, one of 20 and two of 22 fields, and one with a rule broken."""
    path = raw_file(tmp_path, {}, {"region": "West"}, {"quantity": "0"})
    good = open(path, encoding="latin-1").read().splitlines()[1]
    with open(path, "a", encoding="latin-1") as file:
        file.write("\n" + good.replace("O0", "O8").rpartition(",")[0])
        file.write("\n" + good.replace("O0", "O9") + ",more" + "\n" + good.replace("O0", "O9") + ",more")
    return path


def test_malformed_rows_fail_or_are_tagged(spark, tmp_path):
    path = bad_file(tmp_path)
    with pytest.raises(Exception, match="(?i)malformed|failed_read_file"):
        load_raw(spark, path).select("order_id").collect()
    tagged = [r.malformed_record for r in load_raw(spark, path, malformed="tag").collect()]
    assert len(tagged) == 6 and sum(r is not None for r in tagged) == 3
    assert sum(r is not None and r.endswith(",more") for r in tagged) == 2
    with pytest.raises(ValueError):
        load_raw(spark, path, malformed="ignore")


def test_pipeline_reports_what_it_saw_and_cleans_up(spark, tmp_path):
    scratch = scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(scratch))
    tables = {t.name for t in spark.catalog.listTables()}
    result = sinks.run_pipeline(spark, bad_file(tmp_path), str(tmp_path / "out"))
    assert set(os.listdir(scratch)) == before and {t.name for t in spark.catalog.listTables()} == tables
    assert dict(rows(result.drops)) == {"malformed row": 3, "quantity not positive": 1}
    assert result.rows_read == 6
    assert dict(rows(result.counts)) == dict(rows(row_counts(result.mart)))
    assert result.mart.lines("sales", "region_name").count() == 2


def test_a_filter_on_dates_skips_files_of_orders_and_sales(spark, tiny, tmp_path):
    sinks.write_by_year(tiny, str(tmp_path))
    mart = load_by_year(spark, str(tmp_path))
    columns = ("order_id", "sales", "order_date", "order_year", "region_name")
    for start, end in ((dt.date(2023, 1, 4), dt.date(2023, 2, 1)), (dt.date(2022, 1, 6), None), (None, None)):
        view = filter_view(mart.lines(*columns), start, end)
        want = filter_view(tiny.lines(*columns), start, end)
        assert sorted(rows(view)) == sorted(rows(want))
    plan = filter_view(mart.lines(*columns), dt.date(2023, 1, 4))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters: [" in line and "order_year" in line]
    assert len(scans) >= 2 and all(">= 2023" in line for line in scans)
    assert mart.lines("product_id", "sales").count() == 8


def test_a_source_with_a_broken_file_is_passed_over(spark, tiny, tmp_path):
    sinks.write_tables(tiny, str(tmp_path))
    folder = tmp_path / "products.parquet"
    for name in os.listdir(folder):
        (folder / name).write_bytes(b"no parquet")
    with pytest.warns(UserWarning, match="trying the next"):
        assert first_available([lambda: load_tables(spark, str(tmp_path), "parquet"), lambda: tiny]) is tiny

    def down():
        raise RuntimeError("down")
    with pytest.warns(UserWarning), pytest.raises(Exception) as raised:
        first_available([down, lambda: load_tables(spark, str(tmp_path), "parquet")])
    assert raised.value.__notes__ == ["before that: down"]
