"""Wide rows are taken a slice at a time, so one slice's shuffle lies on disk and not all."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallymart import session, sinks
from tallymart.catalog import dirty, tables
from tallymart.operators import clean
from tallymart.session import scratch_dir, scratch_scope


@pytest.fixture
def star(spark, tmp_path):
    """Forty orders of up to three lines, doubled parts and lines, and lines of no order."""
    lines = spark.sql("""
        SELECT IF(id % 17 = 5, NULL, id % 40) AS l_orderkey, CAST(id % 4 AS INT) AS l_linenumber,
               id % 6 AS l_partkey, 1L AS l_suppkey, 2.0D AS l_quantity, 10.0D AS l_extendedprice,
               0.0D AS l_discount, CAST(id % 9 AS DOUBLE) / 100 AS l_tax, 'R' AS l_returnflag,
               'O' AS l_linestatus, DATE'2020-02-05' AS l_shipdate
        FROM range(110)""")
    made = {
        "lineitem": lines.unionByName(lines.limit(20)),
        "orders": spark.sql("SELECT id AS o_orderkey, 5L AS o_custkey, '1-URGENT' AS o_orderpriority, "
                            "DATE'2020-01-05' AS o_orderdate FROM range(38)"),
        "customer": spark.sql("SELECT 5L AS c_custkey, 'Ann' AS c_name, 'HOME' AS c_mktsegment, 0 AS c_nationkey"),
        "nation": spark.sql("SELECT 0 AS n_nationkey, 'PERU' AS n_name, 0 AS n_regionkey"),
        "region": spark.sql("SELECT 0 AS r_regionkey, 'AMERICA' AS r_name"),
        "part": spark.sql("SELECT IF(id = 5, 4, id) AS p_partkey, 'pin' AS p_name, 'B1' AS p_brand, 'T' AS p_type, "
                          "3.0D AS p_retailprice FROM range(6)"),
    }
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/star/{name}.parquet")
    return tables.StarMart(spark, f"{tmp_path}/star")


def _in_slices(monkeypatch, star, n):
    monkeypatch.setattr(session, "SLICE_BYTES", -(-session.file_bytes(star.raw("lineitem")) // n))


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def _gone(spark, before):
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    return not _shuffle_files(spark) - before


def _scratch(spark):
    return set(os.listdir(scratch_dir(spark).removeprefix("file:")))


def _sorted(df):
    return sorted(map(repr, rows(df)))


def test_raw_rows_come_in_slices_of_orders(spark, star, monkeypatch):
    want = _sorted(dirty.raw_text(star))
    assert len(list(dirty.raw_slices(star))) == 1
    _in_slices(monkeypatch, star, 3)
    slices = [rows(part) for part in dirty.raw_slices(star)]
    assert len(slices) == 3 and sorted(repr(r) for part in slices for r in part) == want
    assert max(map(len, slices)) < len(want)


def test_the_raw_file_leaves_no_shuffle_files(spark, star):
    before = _shuffle_files(spark)
    with scratch_scope(spark):
        tables._raw_file(star)
        assert _gone(spark, before)


def test_copies_are_merged_a_slice_at_a_time(spark, star, monkeypatch):
    want = clean.drop_duplicates(clean.strip_strings(tables._raw(star)))
    columns, want = want.columns, _sorted(want)
    _in_slices(monkeypatch, star, 3)
    sizes, merge = [], clean.drop_duplicates

    def counted(df):
        sizes.append(df.count())
        return merge(df)

    monkeypatch.setattr(clean, "drop_duplicates", counted)
    n_raw = dirty.raw_text(star).count()
    lie = _scratch(spark)
    got = tables.ENTRIES["cln2_drop_duplicates"][0](star)
    assert got.columns == columns and _sorted(got) == want
    assert len(sizes) > 1 and sum(sizes) == n_raw and max(sizes) < sum(sizes)
    assert all(name.startswith("merged-") for name in _scratch(spark) - lie if not name.startswith("."))


def test_the_pipeline_merges_a_slice_at_a_time(spark, star, monkeypatch, tmp_path):
    with scratch_scope(spark):
        raw = tables._raw_file(star)
        whole = sinks.run_pipeline(spark, raw, str(tmp_path / "whole"))
        tagged = clean.tag_rows(tables._raw(star))
        assert dict(rows(whole.drops)) == dict(rows(clean.drop_report(tagged)))
        _in_slices(monkeypatch, star, 3)
        written, in_turn = [], sinks.stash_in_turn

        def noted(spark, parts, label):
            parts = list(parts)
            written.append((label, len(parts), sorted(parts[0].columns)))
            return in_turn(spark, parts, label)

        monkeypatch.setattr(sinks, "stash_in_turn", noted)
        assert os.path.isdir(raw.removeprefix("file:"))
        sliced = sinks.run_pipeline(spark, raw, str(tmp_path / "sliced"), remove_raw=True)
        assert not os.path.exists(raw.removeprefix("file:"))
    assert sliced.rows_read == whole.rows_read == dirty.raw_text(star).count()
    assert sorted(rows(sliced.drops)) == sorted(rows(whole.drops))
    assert sorted(rows(sliced.counts)) == sorted(rows(whole.counts))
    for name in ("orders", "sales"):
        assert _sorted(sliced.mart.tables[name]) == _sorted(whole.mart.tables[name])
    # Of the lines, only good rows are stored.
    assert all(label == "good" and n > 1 and "broken_rule" not in columns for label, n, columns in written)


def test_the_pipeline_query_leaves_only_its_tables(spark, star):
    lie = _scratch(spark)
    got = tables.ENTRIES["pipe_orders"][0](star)
    left = {name for name in _scratch(spark) - lie if not name.startswith(".")}
    assert left and all(name.startswith("pipeline-") for name in left)
    assert got.count() == got.select("order_id").distinct().count() > 0


def test_nothing_to_slice(spark, raw_of):
    with scratch_scope(spark):
        raw = raw_of({}).where(F.lit(False))
        assert [part.count() for part in clean.copies_together(spark, [raw], "none")] == [0]
