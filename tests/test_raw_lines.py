"""The raw order lines that the cleaning queries read."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tallymart.catalog import dirty, tables
from tallymart.plans.ordered import dense_ids

_LINE = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
         "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
         "l_linestatus string, l_shipdate date")


def _line(order, number, part=1, flag="N"):
    return (order, number, part, 1, 2.0, 10.0, 0.0, 0.01, flag, "O", None)


def test_lines_are_numbered_by_all_columns_and_lines_without_order_count(spark):
    lines = spark.createDataFrame(
        [_line(7, 2), _line(7, 1, part=2), _line(7, 1), _line(7, 1), _line(None, 1), _line(None, 2),
         _line(3, None), _line(3, 1, flag=None), _line(3, 1), _line(9, 1)], _LINE)
    got = dirty._numbered(lines).select("n", *dirty._LINE)
    want = dense_ids(lines, "n", *dirty._LINE).where("l_orderkey IS NOT NULL").select("n", *dirty._LINE)
    assert sorted(got.collect(), key=lambda r: r.n) == sorted(want.collect(), key=lambda r: r.n)
    # Only the sizes of the orders are put in order; the lines are not dealt by range.
    assert "rangepartitioning" not in got._jdf.queryExecution().toString()


def test_raw_file_is_compressed_and_reads_as_written(spark, tmp_path):
    day = F.to_date(F.lit("2020-01-05"))
    made = {
        "lineitem": spark.createDataFrame([_line(1, 1), _line(1, 2), _line(2, 1)], _LINE).withColumn("l_shipdate", day),
        "orders": spark.sql("SELECT id AS o_orderkey, 5L AS o_custkey, '1-URGENT' AS o_orderpriority "
                            "FROM range(1, 3)").withColumn("o_orderdate", day),
        "customer": spark.sql("SELECT 5L AS c_custkey, 'Ann, \"Lee\"' AS c_name, 'HOME' AS c_mktsegment, 0 AS c_nationkey"),
        "nation": spark.sql("SELECT 0 AS n_nationkey, 'PERU' AS n_name, 0 AS n_regionkey"),
        "region": spark.sql("SELECT 0 AS r_regionkey, 'AMERICA' AS r_name"),
        "part": spark.sql("SELECT 1L AS p_partkey, 'pin' AS p_name, 'B1' AS p_brand, 'T' AS p_type, 3.0D AS p_retailprice"),
    }
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    star = tables.StarMart(spark, str(tmp_path))
    parts = [f for f in os.listdir(tables._raw_file(star).removeprefix("file:")) if f.startswith("part-")]
    assert parts and all(f.endswith(".csv.gz") for f in parts)
    back = [tuple(r) for r in tables._read_back(star).collect()]
    assert sorted(back, key=repr) == sorted([tuple(r) for r in tables._raw(star).collect()], key=repr)
    assert len(back) == 3
