"""One table of (value, copies) from which a column's distribution is read.

The data are read once, into a count per distinct value; a hot value is one row and its
copies meet in map-side partial sums. Minimum, maximum, bins, fences, flags and fliers
come from that table, and quantiles from its rows in value order: blocks of consecutive
values with the number of copies before each, so a rank names the block that holds it.

Figures come back as numbers, not as subqueries, so a plan built on them stays small.
"""

from __future__ import annotations

import math
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymart.functions.measures import real
from tallymart.plans.ordered import OrderedBlocks
from tallymart.session import stash

#: Interquartile ranges between a quartile and its fence.
REACH = 1.5


class Fences(NamedTuple):
    """Values strictly outside are outliers; nothing is one where there are no values."""

    low: float | None
    high: float | None

    def outside(self, x: Column) -> Column:
        if self.low is None:
            return F.lit(False)
        return F.coalesce((x < self.low) | (x > self.high), F.lit(False))


def fences_of(q1: float | None, q3: float | None) -> Fences:
    if q1 is None or q3 is None:
        return Fences(None, None)
    return Fences(q1 - REACH * (q3 - q1), q3 + REACH * (q3 - q1))


class ValueCounts:
    """How often each value of a numeric column occurs, nulls left out.

    ``by`` keeps a further column apart: bins are then counted for each of its values.
    """

    def __init__(self, df: DataFrame, column: str, by: str | None = None):
        self.by = by
        keys = [real(column).alias("value"), *([F.col(by)] if by else [])]
        self.table = stash(
            df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")),
            "value-counts")

    @cached_property
    def span(self) -> tuple[float | None, float | None, int]:
        """Minimum, maximum and the number of values."""
        low, high, n = self.table.agg(F.min("value"), F.max("value"), F.sum("copies")).first()
        return low, high, n or 0

    @cached_property
    def _ordered(self) -> OrderedBlocks:
        values = self.table if self.by is None else self.table.groupBy("value").agg(
            F.sum("copies").alias("copies"))
        return OrderedBlocks(values, "value")

    @cached_property
    def _blocks(self) -> list[tuple[int, int, int]]:
        """(block, copies before it, copies in it): one row a block, a bounded number."""
        rows = self._ordered.rows.groupBy("_block").agg(F.sum("copies").alias("n")).orderBy("_block").collect()
        out, before = [], 0
        for block, n in rows:
            out.append((block, before, n))
            before += n
        return out

    def at_ranks(self, ranks: list[int]) -> dict[int, float]:
        """The values at places 0..n-1 of the sorted data."""
        wanted = [(rank, block, rank - before) for rank in sorted(set(ranks))
                  for block, before, n in self._blocks if before <= rank < before + n]
        if not wanted:
            return {}
        inside = Window.partitionBy("_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        upto = self._ordered.rows.where(F.col("_block").isin([block for _, block, _ in wanted])).select(
            "_block", "value", "copies", F.sum("copies").over(inside).alias("upto"))
        here = [(F.col("_block") == block) & (F.col("upto") > place) & (F.col("upto") - F.col("copies") <= place)
                for _, block, place in wanted]
        found = upto.agg(*[F.max(F.when(test, F.col("value"))) for test in here]).first()
        return {rank: value for (rank, _, _), value in zip(wanted, found)}

    def quantiles(self, *shares: float) -> list[float | None]:
        """Linearly interpolated between the two nearest ranks; None without values."""
        n = sum(block[2] for block in self._blocks)
        if not n:
            return [None] * len(shares)
        exact = [share * (n - 1) for share in shares]
        values = self.at_ranks([r for x in exact for r in (math.floor(x), math.ceil(x))])
        return [interpolate(values[math.floor(x)], values[math.ceil(x)], x) for x in exact]

    def fences(self) -> Fences:
        return fences_of(*self.quantiles(0.25, 0.75))

    def bins(self, bins: int, kind: Column | None = None) -> DataFrame:
        """Equal-width bins from minimum to maximum, which lies in the last; per ``kind`` if given.

        Empty bins have no row. Where all values are equal the range is one wide around them.
        """
        low, high, _ = self.span
        if low is None:
            low, high = 0.0, 1.0
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = (high - low) / bins
        number = F.least(F.floor((F.col("value") - low) / width), F.lit(bins - 1))
        split = [] if kind is None else [kind.alias("kind")]
        keys = [*split, (number + 1).cast("int").alias("bin")]
        counted = self.table.groupBy(*keys).agg(F.sum("copies").alias("n"))
        return counted.withColumn("bin_from", low + (F.col("bin") - 1) * width).withColumn(
            "bin_to", low + F.col("bin") * width).orderBy(*(["kind"] if split else []), "bin")


def interpolate(low: float, high: float, place: float) -> float:
    return low + (high - low) * (place - math.floor(place))


def exact_quantiles(df: DataFrame, column: str, quantiles: dict[str, float]) -> DataFrame:
    """One row with linearly interpolated quantiles of a numeric column."""
    values = ValueCounts(df, column).quantiles(*quantiles.values())
    return one_row(df, dict(zip(quantiles, values)))


def one_row(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    schema = ", ".join(f"`{name}` double" for name in values)
    return df.sparkSession.createDataFrame([tuple(values.values())], schema)


def bracketed_quantiles(df: DataFrame, column: str, shares: list[float],
                        accuracy: int = 10_000) -> list[float | None]:
    """Exact quantiles from two scans, without sorting or counting all values.

    A sketch whose ranks err by at most n / ``accuracy`` gives for each quantile a lower
    and an upper value that enclose it. The second scan counts what lies below each
    bracket and, per value, what lies inside; only that is put in order. Inside are some
    4 n / ``accuracy`` values besides the copies of hot ones, which count as one row. The
    sketch holds some ``accuracy`` values a task. A bracket that misses its rank (the
    sketch's promise does not allow it) is opened to the whole column and counted again.
    """
    x = real(column)
    data = df.where(x.isNotNull()).select(x.alias("value"))
    margin = 2.0 / accuracy
    ends = [e for s in shares for e in (max(0.0, s - margin), min(1.0, s + margin))]
    n, cuts = data.agg(F.count(F.lit(1)), F.percentile_approx("value", ends, accuracy)).first()
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    brackets = list(zip(cuts[::2], cuts[1::2]))
    while True:
        inside = F.lit(False)
        for low, high in brackets:
            inside = inside | F.col("value").between(low, high)
        # One scan: values outside all brackets are counted by the gap that they lie in.
        bounds = sorted({b for pair in brackets for b in pair})
        gap = sum(((F.col("value") > b).cast("int") for b in bounds), F.lit(0))
        kept = F.when(inside, F.col("value"))
        counted = stash(data.groupBy(gap.alias("gap"), kept.alias("value")).agg(
            F.count(F.lit(1)).alias("copies")), "bracket-counts")
        below = {r["gap"]: r["n"] for r in counted.groupBy("gap").agg(F.sum("copies").alias("n")).collect()}
        answers, missed = [], []
        for k, ((low, high), place) in enumerate(zip(brackets, places)):
            within = counted.where(F.col("value").between(low, high))
            # `value > low` opens a gap behind the lowest value, so its copies stand in the gap before.
            first = sum(c for g, c in below.items() if g < bounds.index(low) + 1) - (
                within.where(F.col("value") == low).agg(F.sum("copies")).first()[0] or 0)
            size = within.agg(F.sum("copies")).first()[0] or 0
            lo, hi = math.floor(place) - first, math.ceil(place) - first
            if lo < 0 or hi >= size:
                missed.append(k)
                continue
            found = _Counted(within).at_ranks([lo, hi])
            answers.append(interpolate(found[lo], found[hi], place))
        if not missed:
            return answers
        low, high = data.agg(F.min("value"), F.max("value")).first()
        for k in missed:
            brackets[k] = (low, high)


class _Counted(ValueCounts):
    """A table of counts that is there already."""

    def __init__(self, table: DataFrame):
        self.by, self.table = None, table.select("value", "copies")
