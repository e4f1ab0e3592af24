"""The single-table query shapes: aggregate, group, split, bin, correlate, list."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import finite, is_boolean, is_numeric, label, ref
from ..functions.quantiles import IN_TASK_DISTINCT, percentiles
from ..functions.moments import pair_moments
from ..specs import Filter, MAX_POINTS, SpecError
from .filters import apply_filters

def aggregate_column(df: DataFrame, measure: str | None, aggregation: str) -> Column:
    """The aggregate as a column; a measure is optional only for counting rows.

    A median is not among them: :func:`group_values` and :func:`scalar` compute it.
    """
    if measure is None:
        if aggregation == "count":
            return F.count(F.lit(1))
        raise SpecError(f"{aggregation} needs a measure column")
    col = ref(df, measure)
    made = {
        "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
        "count_distinct": F.count_distinct,
    }.get(aggregation)
    if made is None:
        raise SpecError(f"unsupported aggregation {aggregation!r}")
    return made(col)


def group_values(df: DataFrame, keys: dict[str, Column], measure: str | None, aggregation: str,
                 count: bool = True, in_task: int = IN_TASK_DISTINCT) -> DataFrame:
    """``keys..., value[, row_count]`` for non-null keys.

    Every aggregate combines map-side. A distinct count and a median are
    shuffled by value first, so a hot group never meets in one task.
    """
    present = df
    for col in keys.values():
        present = present.where(col.isNotNull())
    rows = [F.count(F.lit(1)).alias("row_count")] if count else []
    named = [c.alias(k) for k, c in keys.items()]
    if aggregation == "median" and measure is not None:
        exact = percentiles(present, ref(df, measure), [0.5], keys, in_task=in_task)
        return exact.select(*keys, F.col("p")[0].alias("value"), *([F.col("n").alias("row_count")] if count else []))
    return present.groupBy(*named).agg(aggregate_column(df, measure, aggregation).alias("value"), *rows)


# --- one number --------------------------------------------------------------


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows where the caller names a limit, else all."""
    return df if limit is None else df.limit(int(limit))


def row_count(df: DataFrame, filters: Iterable[Filter] = ()) -> DataFrame:
    return apply_filters(df, filters).agg(F.count(F.lit(1)).alias("n"))


def scalar(df: DataFrame, measure: str | None, aggregation: str, filters: Iterable[Filter] = (),
           in_task: int = IN_TASK_DISTINCT) -> DataFrame:
    """One row, one column ``value``."""
    kept = apply_filters(df, filters)
    if aggregation == "median" and measure is not None:
        p = percentiles(kept, ref(df, measure), [0.5], in_task=in_task)
        return p.agg(F.max(F.col("p")[0]).alias("value"))
    return kept.agg(aggregate_column(df, measure, aggregation).alias("value"))


def scalars(df: DataFrame, measure: str, aggregations: Sequence[str], filters: Iterable[Filter] = ()) -> DataFrame:
    """``aggregation, value`` for several aggregates of one measure.

    The table is read once: values are counted map-side, and everything, the distinct count
    and the median included, follows from the counted values.
    """
    kept = apply_filters(df, filters)
    counted = kept.groupBy(ref(df, measure).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_v").isNotNull())
    n = F.sum("_n")
    known = {
        "sum": F.sum(F.col("_v") * F.col("_n")), "avg": F.sum(F.col("_v") * F.col("_n")) / n, "min": F.min("_v"), "max": F.max("_v"),
        "count": F.coalesce(n, F.lit(0)), "count_distinct": F.count(F.lit(1)),
    }
    unknown = [a for a in aggregations if a not in known and a != "median"]
    if unknown:
        raise SpecError(f"unsupported aggregation {unknown[0]!r}")
    simple = [a for a in aggregations if a in known]
    cells = [F.struct(F.lit(a).alias("aggregation"), F.col(a).alias("value")) for a in simple]
    parts = []
    if simple:
        row = counted.agg(*[known[a].cast("double").alias(a) for a in simple])
        parts.append(row.select(F.inline(F.array(*cells))))
    if "median" in aggregations:
        parts.append(scalar(df, measure, "median", filters).select(F.lit("median").alias("aggregation"), F.col("value").cast("double").alias("value")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def distinct_count(df: DataFrame, column: str) -> Column:
    """The number of distinct values as a scalar: rows shuffle by value, none is expanded."""
    return df.select(ref(df, column).alias("_v")).where("_v is not null").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()


def equals(df: DataFrame, column: str, value) -> Column:
    """Row test: booleans natively, everything else as text."""
    if is_boolean(df, column) and isinstance(value, bool):
        return ref(df, column) == F.lit(value)
    return label(df, column) == F.lit(str(value))


def conditional_count(df: DataFrame, column: str, value, filters: Iterable[Filter] = ()) -> DataFrame:
    return apply_filters(df, filters).agg(F.count_if(equals(df, column, value)).alias("n"))


def flag_rate(df: DataFrame, column: str, value=True, filters: Iterable[Filter] = ()) -> DataFrame:
    """Share of rows in percent; a null flag stays in the denominator."""
    hits = F.count_if(equals(df, column, value))
    rate = F.try_divide(hits * 100.0, F.count(F.lit(1)))
    return apply_filters(df, filters).agg(rate.alias("value"))


def ratio(df: DataFrame, numerator: str, denominator: str | None = None, multiply: float = 1.0,
          filters: Iterable[Filter] = ()) -> DataFrame:
    """Sum over sum, or sum over the row count, in one pass."""
    below = F.sum(ref(df, denominator)) if denominator else F.count(F.lit(1))
    value = F.try_divide(F.sum(ref(df, numerator)).cast("double"), below) * multiply
    return apply_filters(df, filters).agg(value.alias("value"))


def column_range(df: DataFrame, column: str) -> DataFrame:
    col = ref(df, column)
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


# --- grouped -----------------------------------------------------------------

SORTS = {
    "value_desc": lambda: [F.desc_nulls_last("value"), F.asc("label")],
    "value_asc": lambda: [F.asc_nulls_last("value"), F.asc("label")],
    "x_asc": lambda: [F.asc("label")],
    "x_desc": lambda: [F.desc("label")],
}


def by_dimension(df: DataFrame, dimension: str, measure: str | None = None, aggregation: str = "count",
                 filters: Iterable[Filter] = (), limit: int | None = 20, sort: str = "value_desc",
                 include_count: bool = True) -> DataFrame:
    """``label, value[, row_count]``; equal values are ordered by label. No limit: all labels."""
    kept = apply_filters(df, filters)
    grouped = group_values(kept, {"label": label(df, dimension)}, measure, aggregation, include_count)
    order = SORTS.get(sort, SORTS["value_desc"])()
    return first_rows(grouped.orderBy(*order), limit)


def top_labels(df: DataFrame, column: str, measure: str | None, aggregation: str, limit: int) -> DataFrame:
    return by_dimension(df, column, measure, aggregation, limit=limit, include_count=False).select("label")


def leading_labels(df: DataFrame, column: str, measure: str | None, aggregation: str, limit: int,
                   filters: Iterable[Filter] = ()) -> list[str]:
    """The names of the leaders, at most ``limit``."""
    return [r[0] for r in top_labels(apply_filters(df, filters), column, measure, aggregation, limit).collect()]


def split_groups(df: DataFrame, key: Column, series: str, measure: str | None, aggregation: str,
                 series_limit: int, leaders: Sequence[str] | None = None) -> DataFrame:
    """``key, series, value`` for the leading series values.

    The leaders are ranked over all their rows, also those without a key. That
    list has at most ``series_limit`` rows, so it is broadcast and drops rows
    ahead of the grouping; no row without a leading series reaches a shuffle.
    Leaders that are known already need no scan of their own.
    """
    named = label(df, series)
    if leaders is not None:
        kept = df.where(named.isin(list(leaders)) if leaders else F.lit(False))
    else:
        kept = df.join(F.broadcast(top_labels(df, series, measure, aggregation, series_limit)), named == F.col("label"), "left_semi")
    return group_values(kept, {"key": key, "series": named}, measure, aggregation, count=False)


def by_dimension_and_series(df: DataFrame, dimension: str, series: str, measure: str | None = None,
                            aggregation: str = "count", filters: Iterable[Filter] = (), limit: int | None = 20,
                            series_limit: int = 6, leaders: Sequence[str] | None = None) -> DataFrame:
    """``label, series, value`` for the labels with the largest total over kept series."""
    kept = apply_filters(df, filters)
    cells = split_groups(kept, label(df, dimension), series, measure, aggregation, series_limit, leaders)
    # At most series_limit cells per label, so a label and its cells are one row.
    packed = cells.groupBy(F.col("key").alias("label")).agg(
        F.sum("value").alias("total"), F.array_sort(F.collect_list(F.struct("series", "value"))).alias("cells"))
    shown = first_rows(packed.orderBy(F.desc_nulls_last("total"), "label"), limit)
    return shown.select("label", F.inline("cells"))


def pivot_series(cells: DataFrame, key: str, order: Sequence[Column] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Series values as columns. Without ``names``, the few names in the cells are read."""
    names = sorted(names) if names is not None else [r[0] for r in cells.select("series").distinct().orderBy("series").collect()]
    wide = cells.groupBy(key).pivot("series", names).agg(F.sum("value"))
    if order:
        return wide.orderBy(*order)
    total = sum((F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names), F.lit(0))
    return wide.orderBy(F.desc(total), key)


def with_share(shown: DataFrame) -> DataFrame:
    """Adds ``share``: percent of the magnitude of the rows shown."""
    whole = F.sum(F.abs("value")).over(Window.partitionBy(F.lit(1)))
    share = F.round(F.try_divide(F.abs("value") * 100.0, whole), 2)
    return shown.withColumn("share", share)


def distinct_values(df: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """``value, n`` by falling frequency."""
    grouped = df.where(ref(df, column).isNotNull()).groupBy(label(df, column).alias("value"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(int(limit))


# --- rows --------------------------------------------------------------------


def detail(df: DataFrame, columns: Sequence[str], filters: Iterable[Filter] = (), limit: int | None = 200,
           order_by: str | None = None, descending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """Row-level table; top rows come from a bounded heap per task, not a full sort."""
    if not columns:
        raise SpecError("a table needs at least one column")
    kept = apply_filters(df, filters)
    if order_by:
        first = F.desc_nulls_last if descending else F.asc_nulls_last
        kept = kept.orderBy(first(ref(df, order_by)), *[ref(df, t) for t in ties])
    return first_rows(kept, limit).select(*[ref(df, c) for c in columns])


def scatter(df: DataFrame, x: str, y: str, filters: Iterable[Filter] = (), series: str | None = None,
            limit: int | None = MAX_POINTS, seed: int = 7, keys: Sequence[str] = ()) -> DataFrame:
    """A seeded uniform sample of the filtered points: the first in the order of a hash of
    the key columns (or all columns shown), so the partitioning has no say in it."""
    kept = apply_filters(df, filters).where(ref(df, x).isNotNull() & ref(df, y).isNotNull())
    cols = [ref(df, x).alias("x"), ref(df, y).alias("y")]
    if series:
        cols.append(label(df, series).alias("series"))
    named = [ref(df, k) for k in keys or [c for c in (x, y, series) if c]]
    pick = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in named]))
    points = kept.select(*cols, pick.alias("_pick"))
    return first_rows(points.orderBy("_pick", "x", "y"), limit).drop("_pick")


# --- numeric shape -----------------------------------------------------------


def histogram(df: DataFrame, column: str, bins: int = 20, filters: Iterable[Filter] = ()) -> DataFrame:
    """``bin_index, bin_start, bin_end, label, count`` with empty bins kept.

    The bounds are a scalar subquery of the same plan, so rows are binned by
    plain arithmetic and only one count per bin and task is shuffled.
    """
    if not is_numeric(df, column):
        raise SpecError(f"{column!r} is not numeric")
    bins = max(3, min(int(bins), 100))
    values = apply_filters(df, filters).select(finite(df, column).cast("double").alias("v"))
    values = values.where(F.col("v").isNotNull())
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    width = (hi - lo) / bins
    spot = F.when(hi > lo, F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = values.groupBy(spot.cast("bigint").alias("bin_index")).agg(F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bin_index"))
    start = lo + F.col("bin_index") * width
    end = lo + (F.col("bin_index") + 1) * width
    return (
        frame.join(counted, "bin_index", "left")
        .where(lo.isNotNull() & ((hi > lo) | (F.col("bin_index") == 0)))
        .select(
            "bin_index", F.round(start, 6).alias("bin_start"), F.round(end, 6).alias("bin_end"),
            F.when(hi > lo, F.concat_ws(" - ", _short(start), _short(end))).otherwise(_short(lo)).alias("label"),
            F.coalesce("count", F.lit(0)).alias("count"))
        .orderBy("bin_index")
    )


def _short(v: Column) -> Column:
    """A bound with about four significant digits."""
    size = F.abs(v)
    return (
        F.when((size >= 1000) | (size == F.floor(size)), F.format_string("%,.0f", v))
        .when(size >= 100, F.format_string("%.1f", v)).when(size >= 10, F.format_string("%.2f", v))
        .when(size >= 1, F.format_string("%.3f", v)).otherwise(F.format_string("%.4g", v))
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], filters: Iterable[Filter] = ()) -> DataFrame:
    """``x, y, value`` for all ordered pairs of any number of columns, from one scan."""
    numeric = [c for c in columns if is_numeric(df, c)]
    spark = df.sparkSession
    if len(numeric) < 2:
        return spark.createDataFrame([], "x string, y string, value double")
    spread = F.sqrt("var_x") * F.sqrt("var_y")
    r = F.when((F.col("var_x") > 0) & (F.col("var_y") > 0), F.col("cov") / spread)
    value = F.round(F.when((F.col("x") == F.col("y")) & r.isNotNull(), 1.0).otherwise(r), 4)
    half = pair_moments(apply_filters(df, filters), numeric).select("x", "y", value.alias("value"))
    both = half.unionByName(half.where("x < y").select(F.col("y").alias("x"), F.col("x").alias("y"), "value"))
    # Pairs without a common row have no moments, but a place in the matrix.
    names = spark.createDataFrame([(i, c) for i, c in enumerate(numeric)], "i int, name string")
    frame = names.select(F.col("i").alias("x"), F.col("name").alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(len(numeric) - 1))).alias("y"))
    frame = frame.join(F.broadcast(names.select(F.col("i").alias("y"), F.col("name").alias("_y"))), "y")
    return frame.join(both, ["x", "y"], "left").select(F.col("_x").alias("x"), F.col("_y").alias("y"), "value")
