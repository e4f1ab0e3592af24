"""Time buckets, trends, period comparison and anomalies.

Raw rows are only ever grouped. Windows run over stretches of a period table, which has
one row per period and measure, so that a long series is the work of several tasks.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import is_temporal, ref
from ..functions.quantiles import percentiles
from ..functions.ranks import numbered, with_neighbours
from ..functions.text import period_label
from ..specs import GRAINS, Filter, SpecError
from .aggregate import aggregate_column, group_values, split_groups
from .filters import apply_filters

PARTIAL_SHARE = 0.6
MIN_PERIODS = 3
ANOMALY_Z = 2.5


def bucket(df: DataFrame, date: str, grain: str) -> Column:
    if not is_temporal(df, date):
        raise SpecError(f"{date!r} is not a date column")
    grain = grain if grain in GRAINS else "month"
    # By dates, which know no time zone: a local midnight may not exist.
    day = ref(df, date).cast("date")
    return (day if grain == "day" else F.trunc(day, grain)).cast("timestamp_ntz")


def time_series(df: DataFrame, date: str, measure: str | None = None, aggregation: str = "count",
                grain: str = "month", filters: Iterable[Filter] = ()) -> DataFrame:
    """``period, value, row_count`` for the periods present, in order."""
    kept = apply_filters(df, filters)
    grouped = group_values(kept, {"period": bucket(df, date, grain)}, measure, aggregation)
    return grouped.orderBy("period")


def time_series_by(df: DataFrame, date: str, series: str, measure: str | None = None,
                   aggregation: str = "count", grain: str = "month", filters: Iterable[Filter] = (),
                   series_limit: int = 5, leaders: Sequence[str] | None = None) -> DataFrame:
    """``period, series, value`` for the leading series values."""
    kept = apply_filters(df, filters)
    cells = split_groups(kept, bucket(df, date, grain), series, measure, aggregation, series_limit, leaders)
    return cells.withColumnRenamed("key", "period").orderBy("period", "series")


def measure_periods(df: DataFrame, date: str, measures: Sequence[tuple[str | None, str]], grain: str) -> DataFrame:
    """``measure, period, value, row_count`` for several measures in one pass.

    ``measures`` holds (column or None for rows, aggregation) pairs.
    """
    period = bucket(df, date, grain)
    aggs = [aggregate_column(df, m, a).cast("double").alias(f"v{i}") for i, (m, a) in enumerate(measures)]
    wide = (
        df.where(ref(df, date).isNotNull()).groupBy(period.alias("period"))
        .agg(F.count(F.lit(1)).alias("row_count"), *aggs)
    )
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(m or "row count").alias("measure"), F.col(f"v{i}").alias("value"))
        for i, (m, _) in enumerate(measures)
    ]
    long = wide.select("period", "row_count", F.inline(F.array(*cells)))
    return long.where(F.col("value").isNotNull()).select("position", "measure", "period", "value", "row_count")


def _keys(periods: DataFrame) -> list[str]:
    return [c for c in ("position", "measure") if c in periods.columns]


def _placed(periods: DataFrame) -> DataFrame:
    """Adds each period's place ``idx`` and of its series ``n_periods``, ``last_period``,
    ``last_count`` and ``typical``, the median number of rows of the periods before the last.

    There are as many series as measures; their facts are broadcast. A series has at most
    one period a day of the calendar, so its row counts can be sorted in one task.
    """
    keys = _keys(periods)
    rows = numbered(periods, keys, "period")
    before, at_end = F.col("idx") < F.col("n_periods") - 1, F.col("idx") == F.col("n_periods") - 1
    typical = percentiles(rows.where(before), F.col("row_count"), [0.5], {k: F.col(k) for k in keys}, distinct=0)
    typical = typical.select(*keys, F.col("p")[0].alias("typical"))
    last = rows.where(at_end).select(*keys, F.col("period").alias("last_period"), F.col("row_count").alias("last_count"))
    if keys:
        return rows.join(F.broadcast(last.join(typical, keys, "left")), keys)
    return rows.withColumn("_end", last.select(F.struct("last_period", "last_count")).scalar()).select(
        rows["*"], "_end.*", typical.scalar().alias("typical"))


def _thin_end(least: int) -> Column:
    """Whether the last period is far emptier than is typical before it."""
    thin = (F.col("typical") > 0) & (F.col("last_count") < F.col("typical") * PARTIAL_SHARE)
    return F.coalesce((F.col("n_periods") > least) & thin, F.lit(False))


def mark_partial(periods: DataFrame, least: int = MIN_PERIODS) -> DataFrame:
    """Adds ``is_partial``: a last period far emptier than is typical before it."""
    partial = (F.col("idx") == F.col("n_periods") - 1) & _thin_end(least)
    return _placed(periods).select(*periods.columns, partial.alias("is_partial"))


def trend_points(periods: DataFrame, grain: str) -> DataFrame:
    """Complete periods with an index from 0 and a label; short series vanish.

    ``partial_period`` names the incomplete last period that was left out.
    """
    rows = _placed(periods).withColumn("_cut", _thin_end(MIN_PERIODS))
    complete = rows.withColumn("n_periods", F.col("n_periods") - F.col("_cut").cast("int")).where(F.col("idx") < F.col("n_periods"))
    return complete.where(F.col("n_periods") >= MIN_PERIODS).select(
        *periods.columns, F.when(F.col("_cut"), period_label(F.col("last_period"), grain)).alias("partial_period"),
        "idx", "n_periods", period_label(F.col("period"), grain).alias("label"))


def trend_summary(periods: DataFrame, grain: str) -> DataFrame:
    """One row per measure: ends, direction, fit, extremes, last step, volatility."""
    keys = _keys(periods)
    points = trend_points(periods, grain)
    low_first = F.struct("value", "idx")
    high_first = F.struct("value", (-F.col("idx")).alias("back"))
    # Rounded like the points themselves so later readers see one set of numbers.
    summary = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.min_by("value", "idx").alias("first_value"),
        F.max_by("value", "idx").alias("last_value"),
        F.min_by("label", "idx").alias("first_period"),
        F.max_by("label", "idx").alias("last_period"),
        F.max(F.when(F.col("idx") == F.col("n_periods") - 2, F.col("value"))).alias("previous_value"),
        F.max_by("label", high_first).alias("best_period"),
        F.max("value").alias("best_value"),
        F.min_by("label", low_first).alias("worst_period"),
        F.min("value").alias("worst_value"),
        F.avg("value").alias("_mean"),
        F.stddev("value").alias("_std"),
        F.regr_slope("value", "idx").alias("_slope"),
        F.regr_r2("value", "idx").alias("_r2"),
        F.max("partial_period").alias("partial_period"),
    )
    change = F.try_divide((F.col("last_value") - F.col("first_value")) * 100, F.abs("first_value"))
    varies = F.col("_std") > 0
    return summary.where(F.col("n_periods") > 0).withColumn("_change", change).select(
        *keys, "n_periods",
        F.round("first_value", 4).alias("first_value"), F.round("last_value", 4).alias("last_value"),
        "first_period", "last_period",
        F.round("_change", 2).alias("change_pct"),
        F.when(F.col("_change") > 5, "up").when(F.col("_change") < -5, "down").otherwise("flat").alias("direction"),
        F.when(varies, F.col("_slope")).alias("slope"),
        F.when(varies, F.col("_r2")).alias("r_squared"),
        "best_period", F.round("best_value", 4).alias("best_value"),
        "worst_period", F.round("worst_value", 4).alias("worst_value"),
        F.round(F.try_divide((F.col("last_value") - F.col("previous_value")) * 100,
                             F.abs("previous_value")), 2).alias("period_over_period_pct"),
        F.round(F.try_divide(F.col("_std") * 100, F.abs("_mean")), 2).alias("volatility_pct"),
        "partial_period",
    )


REACH = 3  # neighbours on either side, of a window of seven at most


def anomalies(periods: DataFrame, grain: str, per_measure: int | None = 4, limit: int | None = None) -> DataFrame:
    """Periods far from a centred rolling median of their neighbours; the oddest ``per_measure`` of each (None: all).

    The window is a third of the series, between 3 and 7 periods. A frame has a
    fixed size per plan, so the widest frame is collected once and each row
    takes the part its own series length asks for.
    """
    keys = _keys(periods)
    points = trend_points(periods, grain).where(F.col("n_periods") >= 6).withColumn("value", F.round("value", 4))
    width = F.greatest(F.lit(3), F.least(F.lit(7), F.floor(F.col("n_periods") / 3)))
    ahead = F.floor((width - 1) / 2)
    behind = width - 1 - ahead
    near = with_neighbours(points, keys, REACH, F.struct("idx", "value"), "_around")
    near = near.withColumn("_back", behind).withColumn("_ahead", ahead)
    local = F.array_sort(F.transform(
        F.filter("_around", lambda p: (p["idx"] >= F.col("idx") - F.col("_back"))
                 & (p["idx"] <= F.col("idx") + F.col("_ahead"))),
        lambda p: p["value"]))
    mid = near.withColumn("_local", local).withColumn("_k", F.size("_local"))
    low = F.element_at("_local", F.floor((F.col("_k") + 1) / 2).cast("int"))
    high = F.element_at("_local", F.floor((F.col("_k") + 2) / 2).cast("int"))
    judged = (
        mid.withColumn("expected", F.when(F.col("_k") >= 2, (low + high) / 2))
        .withColumn("_residual", F.col("value") - F.col("expected"))
        .select(*keys, "idx", "label", "value", "expected", "_residual")
    )
    spread = judged.groupBy(*keys).agg(F.stddev("_residual").alias("_spread"))
    met = judged.join(F.broadcast(spread), keys) if keys else judged.withColumn("_spread", spread.scalar())
    odd = met.withColumn("_z", F.try_divide(F.col("_residual"), F.col("_spread"))).where(F.abs("_z") >= ANOMALY_Z)
    deviation = F.coalesce(F.try_divide((F.col("value") - F.col("expected")) * 100, F.abs("expected")), F.lit(0.0))
    if per_measure is not None:
        # Few rows are odd, and each task keeps its oddest only.
        strongest = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(F.abs(F.round("_z", 2))), "idx")
        odd = odd.withColumn("_rank", F.row_number().over(strongest)).where(F.col("_rank") <= per_measure)
    found = odd.select(
        *keys, F.col("label").alias("period"), "value", F.round("expected", 4).alias("expected"),
        F.round(deviation, 2).alias("deviation_pct"), F.round("_z", 2).alias("z_score"), "idx")
    found = found.orderBy(F.desc(F.abs("z_score")), *[k for k in keys if k == "position"], "idx")
    return (found.limit(limit) if limit else found).drop("idx")
