"""Correlated pairs, outliers and distribution shape of numeric columns."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import finite_frame, quoted
from ..functions.quantiles import IN_TASK_DISTINCT, column_percentiles
from ..functions.moments import pair_moments
from ..functions.stats import pearson_p_value, sample_kurtosis, sample_skewness

MIN_ROWS = 20
MODERATE = 0.4
STRONG = 0.7

PAIRS_SCHEMA = ("x string, y string, coefficient double, strength string, direction string, "
                "p_value double, n long")


def correlation_pairs(df: DataFrame, columns: Sequence[str], limit: int | None = 12) -> DataFrame:
    """Pairs with |r| of at least 0.4, strongest first.

    One scan gives r, n and whether both sides have three distinct values, for any number of
    columns. Only the pairs to report reach the driver, which adds their p-values.
    """
    spark = df.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame([], PAIRS_SCHEMA)
    r = F.try_divide(F.col("cov"), F.sqrt("var_x") * F.sqrt("var_y"))
    strong = pair_moments(df, columns).where((F.col("x") < F.col("y")) & (F.col("n") >= MIN_ROWS) & F.col("varied")).select(
        "x", "y", "n", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r")).where(F.abs("r") >= MODERATE)
    strong = strong.orderBy(F.desc(F.abs(F.round("r", 4))), "x", "y")
    found = (strong if limit is None else strong.limit(limit)).collect()
    rows = [(columns[c.x], columns[c.y], round(c.r, 4), "strong" if abs(c.r) >= STRONG else "moderate",
             "positive" if c.r > 0 else "negative", pearson_p_value(c.r, c.n), c.n) for c in found]
    return spark.createDataFrame(rows, PAIRS_SCHEMA)


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``position, column, value`` with one row per present numeric cell."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), quoted(c).alias("value"))
        for i, c in enumerate(columns)
    ])
    return finite_frame(df, columns).select(F.inline(cells)).where(F.col("value").isNotNull())


def iqr_outliers(df: DataFrame, columns: Sequence[str], limit: int | None = 6,
                 in_task: int = IN_TASK_DISTINCT) -> DataFrame:
    """Count, share, fences and extremes of values beyond 1.5 IQR.

    The extremes are the three largest and two smallest *outliers*, so with a
    one-sided tail all five lie on that side. Rows are filtered against literal
    fences before any shuffle, and ranking keeps a few rows per task.
    """
    spark = df.sparkSession
    schema = ("column string, count long, pct double, lower_bound double, upper_bound double, "
              "extreme_values array<double>")
    if not columns:
        return spark.createDataFrame([], schema)
    quartiles = column_percentiles(finite_frame(df, columns), {c: quoted(c) for c in columns}, [0.25, 0.75], in_task=in_task)
    fences = {}
    for c, q in quartiles.items():
        if q and q[1] > q[0]:
            fences[c] = (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0]))
    usable = [c for c in columns if c in fences]
    if not usable:
        return spark.createDataFrame([], schema)
    low = F.coalesce(*[F.when(F.col("column") == c, F.lit(fences[c][0])) for c in usable])
    high = F.coalesce(*[F.when(F.col("column") == c, F.lit(fences[c][1])) for c in usable])
    cells = _long(df, usable).withColumn("low", low).withColumn("high", high)
    beyond = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    counts = cells.groupBy("position", "column", "low", "high").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(beyond).alias("count"))
    out = cells.where(beyond)
    group = Window.partitionBy("position")

    def ends(order, keep, name):
        ranked = out.withColumn("_r", F.row_number().over(group.orderBy(order))).where(F.col("_r") <= keep)
        return ranked.groupBy("position").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda v: F.round(v["value"], 4))
            .alias(name))

    ordered = (
        counts.where((F.col("n") >= MIN_ROWS) & (F.col("count") > 0))
        .join(ends(F.desc("value"), 3, "_top"), "position").join(ends(F.asc("value"), 2, "_bottom"), "position")
        .select("position", "column", "count", F.round(F.col("count") * 100.0 / F.col("n"), 2).alias("pct"),
                F.round("low", 4).alias("lower_bound"), F.round("high", 4).alias("upper_bound"),
                F.concat("_top", "_bottom").alias("extreme_values"))
        .orderBy(F.desc("pct"), "position")
    )
    return (ordered.limit(limit) if limit else ordered).drop("position")


def _varied(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with four distinct values: two different ones lie between the ends."""
    value = {c: quoted(c) for c in columns}
    ends = df.agg(*[F.array(F.min(v), F.max(v)).alias(c) for c, v in value.items()]).first()
    between = {c: F.when((v > F.lit(ends[c][0])) & (v < F.lit(ends[c][1])), v) for c, v in value.items()}
    inner = df.agg(*[(F.min(v) < F.max(v)).alias(c) for c, v in between.items()]).first()
    return [c for c in columns if inner[c]]


def distribution_shape(df: DataFrame, columns: Sequence[str], distinct: dict[str, int] | None = None) -> DataFrame:
    """``column, shape, skew, kurtosis`` for columns with 20 rows and 4 distinct values."""
    spark = df.sparkSession
    schema = "column string, shape string, skew double, kurtosis double"
    if not columns:
        return spark.createDataFrame([], schema)
    df = finite_frame(df, columns)
    varied = [c for c in columns if distinct[c] >= 4] if distinct else _varied(df, columns)
    if not varied:
        return spark.createDataFrame([], schema)
    aggs = []
    for i, c in enumerate(varied):
        v = quoted(c)
        aggs += [F.count(v).alias(f"n{i}"), sample_skewness(v).alias(f"s{i}"), sample_kurtosis(v).alias(f"k{i}")]
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"n{i}").alias("n"),
                 F.col(f"s{i}").alias("s"), F.col(f"k{i}").alias("k"))
        for i, c in enumerate(varied)
    ])
    shape = (
        F.when(F.col("s").isNull(), "unknown").when(F.col("s") > 1.0, "right-skewed")
        .when(F.col("s") < -1.0, "left-skewed").when(F.col("k") < -1.0, "uniform-ish").otherwise("normal-ish")
    )
    rows = df.agg(*aggs).select(F.inline(cells)).where(F.col("n") >= MIN_ROWS).orderBy("position")
    return rows.select("column", shape.alias("shape"), F.round("s", 4).alias("skew"), F.round("k", 4).alias("kurtosis"))


def distribution_bins(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """``column, bin_index, bin_start, bin_end, count`` for all columns in two scans."""
    long = _long(df, columns)
    edges = finite_frame(df, columns).agg(*[F.struct(F.min(quoted(c)).alias("lo"), F.max(quoted(c)).alias("hi")).alias(f"c{i}")
                                            for i, c in enumerate(columns)]).first()
    known = [i for i in range(len(columns)) if edges[f"c{i}"]["lo"] is not None]

    def edge(which):
        return F.coalesce(*[F.when(F.col("position") == i, F.lit(edges[f"c{i}"][which])) for i in known])

    if not known:
        return df.sparkSession.createDataFrame(
            [], "column string, bin_index long, bin_start double, bin_end double, count long")
    width = (F.col("hi") - F.col("lo")) / bins
    spot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)))
    placed = long.withColumn("lo", edge("lo")).withColumn("hi", edge("hi"))
    counted = placed.groupBy("position", F.coalesce(spot, F.lit(0)).alias("bin_index")).agg(
        F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.createDataFrame(
        [(i, columns[i], b) for i in known for b in range(bins)], "position int, column string, bin_index long")
    filled = frame.join(counted, ["position", "bin_index"], "left").withColumn("lo", edge("lo")).withColumn("hi", edge("hi"))
    return filled.select(
        "column", "bin_index",
        F.round(F.col("lo") + F.col("bin_index") * width, 4).alias("bin_start"),
        F.round(F.col("lo") + (F.col("bin_index") + 1) * width, 4).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count")).orderBy("position", "bin_index")
