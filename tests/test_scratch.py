"""What is written once is written narrow, and leaves no shuffle behind."""

from __future__ import annotations

import time

import numpy as np

from tallymart.catalog import tables
from tallymart.llm.language import fit_machine
from tallymart.session import stash


def _shuffle_files(spark) -> set[str]:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_stash_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    kept = stash(spark.range(1000).repartition(3, "id"), "numbers")
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert kept.count() == 1000


def test_tables_of_names_do_not_write_the_cleaned_lines(raw_of, monkeypatch):
    raw, written = raw_of({}), []

    def noted(df, label, *more):
        written.append(sorted(df.columns))
        return stash(df, label, *more)

    monkeypatch.setattr(tables, "_raw", lambda mart: raw)
    monkeypatch.setattr(tables, "stash", noted)
    assert tables.ENTRIES["nrm3_customers"][0](None).count() == 1
    assert tables.ENTRIES["nrm5_sub_categories"][0](None).count() == 1
    assert written == [["category", "row_id", "sub_category"]]


def test_fitting_a_machine_holds_its_rows_twice_at_most():
    import tracemalloc

    rng = np.random.default_rng(1)
    x, y = rng.random((400, 8192), np.float32), np.repeat([1.0, -1.0], 200)
    tracemalloc.start()
    fit_machine(x, y, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * x.nbytes
