"""Ranks and running positions that no single task has to count.

Rows are spread by range, so that each task holds a stretch of the order; a position is
one in the stretch plus the sizes of the stretches before it. Only the sizes, a row per
stretch, meet in a window.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_ROW = (1 << 33) - 1  # monotonically_increasing_id() counts a task's rows in its lower 33 bits


def rank_sums(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """``keys, n, total, rank_sum``: per group the rows, the sum of the values and that of
    value times rank, ranks from 1 by rising value. Values are present and not null.

    A hot group spreads over many tasks: the sort is by (keys, value), in ranges.
    """
    ordered = df.repartitionByRange(*keys, value, tie).sortWithinPartitions(*keys, value, tie)
    at = F.monotonically_increasing_id()
    # The local position starts where the group does in this task.
    placed = ordered.select(*keys, F.col(value).alias("_v"), F.shiftright(at, 33).alias("_task"), at.bitwiseAND(_ROW).alias("_at"))
    parts = placed.groupBy(*keys, "_task").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first"), F.sum("_v").alias("_sum"), F.sum(F.col("_at") * F.col("_v")).alias("_moment"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    local = F.col("_moment") + (1 - F.col("_first")) * F.col("_sum")
    return parts.withColumn("_ranked", local + offset * F.col("_sum")).groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("_sum").alias("total"), F.sum("_ranked").alias("rank_sum"))


DAYS = 4096  # of one stretch of a calendar; dates from year 1 to 9999 make 892 of them


def numbered(periods: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Adds ``idx``, the place of each period in its group from 0, and ``n_periods``.

    A group has a period once, at most one a day, so a stretch of the calendar is a bounded
    number of rows and a group a bounded number of stretches.
    """
    stretch = F.floor(F.unix_date(F.col(period).cast("date")) / DAYS)
    placed = periods.withColumn("_stretch", stretch)
    sizes = placed.groupBy(*keys, "_stretch").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = group.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys, "_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("n_periods"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(period)
    met = placed.join(F.broadcast(starts), [*keys, "_stretch"])
    return met.withColumn("idx", F.col("_before") + F.row_number().over(inside) - 1).drop("_stretch", "_before")


def with_neighbours(numbered_rows: DataFrame, keys: Sequence[str], reach: int, what: Column, name: str, block: int = 4096) -> DataFrame:
    """Adds an array of ``what`` over the rows up to ``reach`` places before and after.

    Rows are dealt to blocks by ``idx``; those near a border also go to the block beyond it,
    as guests, so that every block sees the whole surroundings of its own rows.
    """
    own = F.floor(F.col("idx") / block)
    blocks = F.array_distinct(F.array(F.floor((F.col("idx") - reach) / block), own, F.floor((F.col("idx") + reach) / block)))
    dealt = numbered_rows.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    around = Window.partitionBy(*keys, "_block").orderBy("idx").rowsBetween(-reach, reach)
    return dealt.withColumn(name, F.collect_list(what).over(around)).where(F.col("_block") == F.col("_own")).drop("_own", "_block")
