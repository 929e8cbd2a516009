"""Ordered computations over a whole table without a one-task window.

A window without PARTITION BY, or with one hot partition, sends its rows to one
task. Here the rows are range-partitioned on the full order (ties included, so a
hot value is split too), written once, and every ordered function is a window
inside one block plus a carry from the blocks before it. The carries live in a
table with one row per block, at most ``spark.sql.shuffle.partitions`` rows,
which is what makes broadcasting it and windowing over it safe. The blocks are
stored bucketed by their number, so windows inside blocks need no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymart.session import stash_bucketed

_BLOCK, _POS = "_block", "_pos"
# monotonically_increasing_id keeps the row's place in its partition in 33 bits.
_PLACE_BITS = (1 << 33) - 1


class OrderedBlocks:
    """Rows of a table in a total order, stored as consecutive blocks."""

    def __init__(self, df: DataFrame, *order: Column | str):
        placed = (
            df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn(_BLOCK, F.spark_partition_id())
            .withColumn(_POS, F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS)))
        )
        self.columns = df.columns
        # Bucketed by block: what is windowed inside blocks is read where it lies.
        self.rows = stash_bucketed(placed, "ordered", _BLOCK)

    def _blocks(self, *facts: Column) -> DataFrame:
        return self.rows.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("_n"), *facts)

    def _with_offsets(self, rows: DataFrame) -> DataFrame:
        earlier = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        everything = Window.partitionBy()
        offsets = self._blocks().select(
            _BLOCK,
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
            F.sum("_n").over(everything).alias("_total"))
        return rows.join(F.broadcast(offsets), _BLOCK)

    def _finish(self, rows: DataFrame, **added: Column) -> DataFrame:
        return rows.select(*self.columns, *[c.alias(name) for name, c in added.items()])

    def row_number(self, name: str) -> DataFrame:
        """Dense numbers 1..n in the stored order."""
        return self._finish(
            self._with_offsets(self.rows), **{name: F.col("_offset") + F.col(_POS) + 1})

    def ntile(self, buckets: int, name: str) -> DataFrame:
        """Equal-sized buckets; the first ``n % buckets`` of them hold one row more."""
        rows = self._with_offsets(self.rows)
        number = F.col("_offset") + F.col(_POS)
        small = F.floor(F.col("_total") / buckets)
        larger = F.col("_total") % buckets
        in_larger = number < larger * (small + 1)
        bucket = F.when(in_larger, F.floor(number / (small + 1))).otherwise(
            larger + F.floor((number - larger * (small + 1)) / F.greatest(small, F.lit(1))))
        return self._finish(rows, **{name: (bucket + 1).cast("int")})

    def rank_within(self, groups: Sequence[str], value: str, name: str) -> DataFrame:
        """RANK per group, for an order that starts with ``groups`` then ``value``."""
        peers = self._run_start([*groups, value], "_peer_start")
        both = self._add_run_start(peers, list(groups), "_group_start")
        rank = F.col("_peer_start") - F.col("_group_start") + 1
        return self._finish(both, **{name: rank})

    def _run_start(self, keys: list[str], name: str) -> DataFrame:
        return self._add_run_start(self._with_offsets(self.rows), keys, name)

    def _add_run_start(self, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Number of the first row of each run of equal ``keys``.

        Only the head run of a block can have begun earlier; its start is carried
        from the last block in which a tail run began.
        """
        key = F.struct(*keys)
        ends = self._blocks(
            F.min_by(key, _POS).alias("_head"), F.max_by(key, _POS).alias("_tail"))
        tails = (
            self.rows.join(F.broadcast(ends.select(_BLOCK, "_tail")), _BLOCK)
            .where(key.eqNullSafe(F.col("_tail")))
            .groupBy(_BLOCK).agg(F.min(_POS).alias("_tail_pos"))
        )
        in_order = Window.orderBy(_BLOCK)
        before = in_order.rowsBetween(Window.unboundedPreceding, -1)
        began = ends.join(F.broadcast(tails), _BLOCK).select(
            _BLOCK, "_head", "_tail", "_tail_pos",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
            F.lag("_tail").over(in_order).alias("_previous_tail"))
        fresh_tail = (F.col("_tail_pos") > 0) | ~F.col("_tail").eqNullSafe(F.col("_previous_tail"))
        began = began.withColumn(
            "_tail_start", F.when(fresh_tail, F.col("_first") + F.col("_tail_pos") + 1))
        carry = began.select(
            _BLOCK,
            F.when(F.col("_head").eqNullSafe(F.col("_previous_tail")), F.col("_head")).alias("_open"),
            F.last("_tail_start", ignorenulls=True).over(before).alias("_carried"))
        own = F.col("_offset") + F.min(_POS).over(Window.partitionBy(_BLOCK, *keys)) + 1
        numbered = rows.join(F.broadcast(carry), _BLOCK).withColumn("_own", own)
        start = F.when(
            F.col("_open").isNotNull() & key.eqNullSafe(F.col("_open")), F.col("_carried")
        ).otherwise(F.col("_own"))
        return numbered.withColumn(name, start).drop("_open", "_carried", "_own")

    def previous(self, groups: Sequence[str], value: str, name: str) -> DataFrame:
        """LAG of ``value`` per group, for an order that starts with ``groups``."""
        last = F.struct(F.struct(*groups).alias("g"), F.col(value).alias("v"))
        carry = self._blocks(F.max_by(last, _POS).alias("_last")).select(
            _BLOCK, F.lag("_last").over(Window.orderBy(_BLOCK)).alias("_carried"))
        inside = Window.partitionBy(_BLOCK, *groups).orderBy(_POS)
        carried = F.when(
            (F.col(_POS) == 0) & F.struct(*groups).eqNullSafe(F.col("_carried.g")),
            F.col("_carried.v"))
        rows = self.rows.withColumn("_inside", F.lag(value).over(inside))
        rows = rows.join(F.broadcast(carry), _BLOCK)
        return self._finish(rows, **{name: F.coalesce(F.col("_inside"), carried)})

    def running_sums(self, only: Column | None = None, **sums: str) -> DataFrame:
        """Running totals (``name=column``) up to and including each row.

        ``only`` picks blocks by ``before_<name>`` and ``within_<name>``, the totals
        before and inside a block; the others are left out before any shuffle.
        """
        before = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        totals = self._blocks(*[F.sum(c).alias(f"within_{name}") for name, c in sums.items()])
        carry = totals.select(_BLOCK, *[f"within_{name}" for name in sums], *[
            F.coalesce(F.sum(f"within_{name}").over(before), F.lit(0)).alias(f"before_{name}")
            for name in sums])
        if only is not None:
            carry = carry.where(only)
        inside = Window.partitionBy(_BLOCK).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
        rows = self.rows.join(F.broadcast(carry), _BLOCK)
        return self._finish(rows, **{
            name: F.col(f"before_{name}") + F.sum(c).over(inside) for name, c in sums.items()})


def dense_ids(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Number the rows 1..n by a total order, in parallel."""
    return OrderedBlocks(df, *order).row_number(name)
