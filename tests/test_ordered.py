"""Ordered computations against brute force, with many blocks and hot values."""

import random

import numpy as np
import pytest

from conftest import rows
from pyspark.sql import functions as F
from tallymart.plans.counts import ValueCounts, bracketed_quantiles, exact_quantiles
from tallymart.plans.ordered import OrderedBlocks, dense_ids


def table(spark, n=500, seed=1):
    """(id, g, v): a third of all rows share one group and one value."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        hot = i % 3 == 0
        data.append((i, "hot" if hot else f"g{rng.randrange(40)}", 7 if hot else rng.randrange(30)))
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "id int, g string, v int")


def test_blocks_are_really_several(spark, many_blocks):
    _, df = table(spark)
    assert OrderedBlocks(df, "v", "id").rows.select("_block").distinct().count() > 1


def test_row_number(spark, many_blocks):
    data, df = table(spark)
    got = dict(rows(dense_ids(df, "n", F.desc("v"), "id"), "id", "n"))
    want = {r[0]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: (-r[2], r[0])))}
    assert got == want


@pytest.mark.parametrize("n,k", [(500, 4), (500, 7), (3, 5), (5, 5), (1, 4)])
def test_ntile(spark, many_blocks, n, k):
    data, df = table(spark, n)
    got = dict(rows(OrderedBlocks(df, "v", "id").ntile(k, "q"), "id", "q"))
    ordered = [r[0] for r in sorted(data, key=lambda r: (r[2], r[0]))]
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    want, at = {}, 0
    for bucket, size in enumerate(sizes):
        for i in ordered[at:at + size]:
            want[i] = bucket + 1
        at += size
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rank_within_groups(spark, many_blocks, seed):
    data, df = table(spark, seed=seed)
    got = dict(rows(OrderedBlocks(df, "g", F.desc("v"), "id").rank_within(["g"], "v", "r"),
                    "id", "r"))
    want = {i: 1 + sum(1 for _, h, w in data if h == g and w > v) for i, g, v in data}
    assert got == want


def test_rank_when_all_rows_are_peers(spark, many_blocks):
    df = spark.createDataFrame([(i, "g", 1) for i in range(200)], "id int, g string, v int")
    got = OrderedBlocks(df, "g", F.desc("v"), "id").rank_within(["g"], "v", "r")
    assert set(rows(got, "r")) == {(1,)}


@pytest.mark.parametrize("seed", [1, 2])
def test_previous_value(spark, many_blocks, seed):
    data, df = table(spark, seed=seed)
    got = dict(rows(OrderedBlocks(df, "g", "id").previous(["g"], "v", "p"), "id", "p"))
    want, last = {}, {}
    for i, g, v in sorted(data, key=lambda r: (r[1], r[0])):
        want[i], last[g] = last.get(g), v
    assert got == want


def test_running_sums(spark, many_blocks):
    data, df = table(spark)
    got = dict(rows(OrderedBlocks(df, "v", "id").running_sums(s="v"), "id", "s"))
    want, total = {}, 0
    for i, _, v in sorted(data, key=lambda r: (r[2], r[0])):
        total += v
        want[i] = total
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 10, 501])
def test_quantiles_interpolate_like_numpy(spark, many_blocks, n):
    data, df = table(spark, n)
    [got] = rows(exact_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.9}))
    assert got == pytest.approx(tuple(np.quantile([r[2] for r in data], [0.25, 0.5, 0.9])))


def test_quantiles_of_nothing_are_null(spark):
    df = spark.createDataFrame([], "v double")
    assert rows(exact_quantiles(df, "v", {"a": 0.5})) == [(None,)]


@pytest.mark.parametrize("n,accuracy", [(1, 100), (2, 100), (10, 100), (501, 20), (3000, 50), (3000, 10_000)])
def test_bracketed_quantiles_are_exact(spark, many_blocks, n, accuracy):
    """Ties, a hot value with a third of the rows, and nulls."""
    data, df = table(spark, n)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = bracketed_quantiles(df.withColumn("v", F.when(F.col("id") >= 0, F.col("v") * 1.5)), "v", shares, accuracy)
    assert got == pytest.approx(list(np.quantile([r[2] * 1.5 for r in data], shares)))


def test_bracketed_quantiles_of_distinct_values(spark, many_blocks):
    values = list(range(0, 20_000, 7))
    random.Random(4).shuffle(values)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert bracketed_quantiles(df, "v", [0.25, 0.5, 0.75], 100) == pytest.approx(
        list(np.quantile(values, [0.25, 0.5, 0.75])))
    assert bracketed_quantiles(df.where("v IS NULL"), "v", [0.5]) == [None]


def test_counts_give_ranks_and_span(spark, many_blocks):
    data, df = table(spark)
    counts = ValueCounts(df, "v")
    ordered = sorted(r[2] for r in data)
    ranks = [0, 17, 250, 499]
    assert counts.at_ranks(ranks) == {r: ordered[r] for r in ranks}
    assert counts.span == (ordered[0], ordered[-1], 500)


def test_blocks_are_windowed_where_they_lie(spark, many_blocks):
    _, df = table(spark)
    blocks = OrderedBlocks(df, "g", F.desc("v"), "id")
    for got in (blocks.previous(["g"], "v", "p"), blocks.running_sums(s="v"), blocks.rank_within(["g"], "v", "r")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        windows = [i for i, line in enumerate(lines) if "Window [" in line and "_block" in line and "_pos" in line]
        assert windows
        for i in windows:  # a sort at most lies between a window and the join or scan below it
            assert not any("Exchange hashpartitioning" in line for line in lines[i + 1:i + 3])
