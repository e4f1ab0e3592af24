"""Exact percentiles by recursive distributed selection.

Values are first counted by (group, value), which combines map-side and spreads a hot
group over all tasks. A group's values are one range. A range with more distinct values
than one task should sort is cut into bins by its own ends; bin totals, again combined
map-side, tell which bins hold a wanted rank, and only those are ranges of the next
round. Bins are equal in steps of the logarithm and of the value in turn, so that any
spread of values narrows by some thousand times a round. What is left is sorted within
ranges that are all small. Most data need no round at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import new_path
from .columns import quoted

IN_TASK_DISTINCT = 1_000_000  # most distinct values of a range that a task sorts: 16 MB
BINS = 4096


def percentiles(df: DataFrame, value: Column, probs: list[float], by: dict[str, Column] | None = None,
                distinct: int | None = None, in_task: int = IN_TASK_DISTINCT, weight: Column | None = None) -> DataFrame:
    """One row per group with ``p``, the exact percentiles as an array, and ``n``, its rows.

    With ``weight`` each row stands for so many.
    Groups must be non-null; null, NaN and infinite values count as rows only. ``distinct`` is the
    largest number of distinct values in any group when already known.
    """
    by = by or {}
    keys = list(by)
    number = value.cast("double")
    rows = df.select(*[c.alias(k) for k, c in by.items()], number.alias("_v"), (F.lit(1) if weight is None else weight).alias("_n"))
    finite = ~F.isnan("_v") & (F.abs("_v") < float("inf"))
    # Counting by value first spreads a hot group over all tasks. Adding zero folds -0.0 into 0.0.
    counted = (
        rows.select(*keys, F.when(finite, F.col("_v") + F.lit(0.0)).alias("_v"), "_n")
        .groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    )
    if distinct is None:
        distinct = counted.groupBy(*keys).agg(F.count("_v").alias("d")).agg(F.max("d")).first()[0] or 0
    if distinct > in_task:
        return _selected(_staged(counted, "counted"), keys, probs, in_task)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sized = counted.withColumn("_rows", F.sum("_n").over(group))
    sized = sized.withColumn("_total", F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))).over(group))
    return _picked(sized.withColumn("_start", F.lit(0)), keys, keys, probs, F.max("_rows"))


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranks(probs: list[float]) -> list[tuple[Column, Column]]:
    """For each percentile the lower rank (from 0) it is made of and the weight of the next one."""
    at = [(F.col("_total") - 1) * F.lit(float(p)) for p in probs]
    return [(F.floor(a), a - F.floor(a)) for a in at]


def _holds(start: Column, stop: Column, probs: list[float]) -> Column:
    """Whether a wanted rank lies in [start, stop)."""
    test = F.lit(False)
    for low, up in _ranks(probs):
        test = test | ((low >= start) & (low < stop)) | ((up > 0) & (low + 1 >= start) & (low + 1 < stop))
    return test


def _picked(placed: DataFrame, keys: list[str], ranges: list[str], probs: list[float], rows: Column) -> DataFrame:
    """Sorts each range's values, from rank ``_start`` on, and takes those of the wanted ranks."""
    inside = Window.partitionBy(*(ranges or [F.lit(0)])).orderBy(F.asc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_to", F.col("_start") + F.sum("_n").over(inside)).withColumn("_from", F.col("_to") - F.col("_n"))
    at = lambda rank: (rank >= F.col("_from")) & (rank < F.col("_to"))
    part = [F.sum(F.when(at(low), (1 - up) * F.col("_v")).otherwise(0.0) + F.when(at(low + 1) & (up > 0), up * F.col("_v")).otherwise(0.0))
            for low, up in _ranks(probs)]
    return ranked.groupBy(*keys).agg(F.when(F.count("_v") > 0, F.array(*part)).alias("p"), rows.alias("n"))


def _scaled(v: Column, lo: Column, hi: Column) -> Column:
    """The bin of a value in its range; rises with the value whatever is rounded."""
    share = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1))


def _logarithm(v: Column) -> Column:
    """Signed, and rising through zero: the least positive double has a logarithm of -1074."""
    return F.signum(v) * F.when(v == 0, 0.0).otherwise(F.log2(F.abs(v)) + 1100)


def _selected(counted: DataFrame, keys: list[str], probs: list[float], in_task: int) -> DataFrame:
    """Percentiles of groups some of which are too varied to sort in one task."""
    present = counted.where("_v is not null")
    found = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_distinct"), F.sum("_n").alias("_size")]
    whole = present.groupBy(*keys).agg(*found)
    ranges = _staged(whole.withColumn("_start", F.lit(0).cast("bigint")).withColumn("_total", F.col("_size")), "ranges")
    level = 0
    while not ranges.where(F.col("_distinct") > in_task).isEmpty():
        ranges = _staged(_narrowed(present, ranges, keys, probs, in_task, level, found), "ranges")
        level += 1
    # A group has at most two ranges per percentile.
    held = present.alias("c").join(ranges.alias("r"), _in_range(keys)).select(
        *[_of("c", k) for k in keys], "_v", "_n", "_lo", "_start", "_total")
    exact = _picked(held, keys, [*keys, "_lo"], probs, F.lit(None)).drop("n")
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("n"))
    return sizes.join(exact, keys, "left").select(*keys, "p", "n") if keys else exact.select("p", sizes.scalar().alias("n"))


def _of(side: str, name: str) -> Column:
    return F.col(side + ".`" + name.replace("`", "``") + "`")


def _in_range(keys: list[str]) -> Column:
    test = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    for k in keys:
        test = test & (_of("c", k) == _of("r", k))
    return test


def _narrowed(present: DataFrame, ranges: DataFrame, keys: list[str], probs: list[float], in_task: int, level: int, found: list[Column]) -> DataFrame:
    """The ranges with every too varied one replaced by its bins that hold a wanted rank."""
    large = ranges.where(F.col("_distinct") > in_task).select(*keys, "_lo", "_hi", F.col("_start").alias("_before"), "_total")
    met = present.alias("c").join(large.alias("r"), _in_range(keys))
    value, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    bin_ = _scaled(_logarithm(value), _logarithm(lo), _logarithm(hi)) if level % 2 == 0 else _scaled(value, lo, hi)
    own = [_of("c", k).alias(k) for k in keys]
    placed = met.select(*own, F.col("_lo").alias("_range"), bin_.alias("_bin"), "_v", "_n", "_before", "_total")
    bins = placed.groupBy(*keys, "_range", "_before", "_total", "_bin").agg(*found)
    earlier = Window.partitionBy(*keys, "_range").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    kept = bins.where(_holds(F.col("_start"), F.col("_start") + F.col("_size"), probs))
    return ranges.where(F.col("_distinct") <= in_task).unionByName(kept.select(ranges.columns))


def column_percentiles(df: DataFrame, columns: dict[str, Column], probs: list[float],
                       distinct: dict[str, int] | None = None,
                       in_task: int = IN_TASK_DISTINCT) -> dict[str, list[float] | None]:
    """Exact percentiles of whole columns, one list per column, on the driver."""
    if not columns:
        return {}
    most = max(distinct[n] for n in columns) if distinct else None
    cells = [F.struct(F.lit(i).alias("_c"), quoted(f"_{i}").alias("_x")) for i in range(len(columns))]
    frame = df.select(*[c.cast("double").alias(f"_{i}") for i, c in enumerate(columns.values())]).select(F.inline(F.array(*cells)))
    rows = percentiles(frame, F.col("_x"), probs, {"_c": F.col("_c")}, distinct=most, in_task=in_task).collect()
    p = {r["_c"]: r["p"] for r in rows}
    return {n: p.get(i) for i, n in enumerate(columns)}
