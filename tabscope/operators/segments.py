"""How a measure splits over the values of a dimension."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import label, ref
from ..functions.ranks import rank_sums
from ..specs import Filter
from .aggregate import aggregate_column, by_dimension
from .filters import apply_filters


def dimension_values(df: DataFrame, dimensions: Sequence[str], measure: str | None, aggregation: str,
                     filters: Iterable[Filter] = ()) -> DataFrame:
    """``position, dimension, label, value, row_count`` for several dimensions in one scan.

    Each row is tagged once per dimension and combined map-side, so the shuffle
    carries one row per task and category.
    """
    kept = apply_filters(df, filters)
    tags = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(d).alias("dimension"), label(df, d).alias("label"))
        for i, d in enumerate(dimensions)
    ])
    value = [] if measure is None else [ref(df, measure)]
    tagged = kept.select(*value, F.inline(tags)).where(F.col("label").isNotNull())
    grouped = tagged.groupBy("position", "dimension", "label").agg(
        aggregate_column(tagged, measure, aggregation).cast("double").alias("value"),
        F.count(F.lit(1)).alias("row_count"))
    return grouped.where(F.col("value").isNotNull())


def single_dimension(df: DataFrame, dimension: str, measure: str | None, aggregation: str,
                     filters: Iterable[Filter] = ()) -> DataFrame:
    rows = by_dimension(df, dimension, measure, aggregation, filters, limit=None)
    return rows.where(F.col("value").isNotNull()).select(
        F.lit(0).alias("position"), F.lit(dimension).alias("dimension"), "label",
        F.col("value").cast("double").alias("value"), "row_count")


KEYS = ("position", "dimension")


def dimension_totals(values: DataFrame) -> DataFrame:
    """One row per dimension of more than one category: their number, the total, mixed signs.

    A measure with mixed signs nets out near zero, so its shares are taken of
    the summed magnitude instead of the signed total.
    """
    negative = F.max(F.col("value") < 0)
    return values.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_categories"), negative.alias("has_negative"),
        F.when(negative, F.sum(F.abs("value"))).otherwise(F.sum("value")).alias("total"),
    ).where(F.col("n_categories") > 1)


def trailing(top: int) -> Column:
    """How many trailing categories are shown beside the leading ones."""
    return F.least(F.lit(3), F.greatest(F.lit(0), F.col("n_categories") - top))


def with_shares(values: DataFrame) -> DataFrame:
    """Every category with its dimension's totals and its share of them."""
    # One row per dimension, of which there are as many as columns at most.
    met = values.join(F.broadcast(dimension_totals(values)), list(KEYS))
    part = F.when(F.col("has_negative"), F.abs("value")).otherwise(F.col("value"))
    share = F.round(F.when(F.col("total") == 0, 0.0).otherwise(F.try_divide(part * 100.0, F.col("total"))), 2)
    return met.withColumn("share_pct", share)


def ranked_ends(values: DataFrame, top: int, bottom: int = 3) -> DataFrame:
    """The first ``top`` and last ``bottom`` categories of each dimension with rank and share.

    Either end is cut to as many rows per task before its shuffle, so no task ranks a
    whole dimension; ranks from the end follow from the number of categories.
    """
    met = with_shares(values)
    group = Window.partitionBy(*KEYS)
    first = met.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "label"))).where(F.col("rank") <= top)
    last = met.withColumn("_back", F.row_number().over(group.orderBy("value", F.desc("label")))).where(F.col("_back") <= bottom)
    last = last.withColumn("rank", (F.col("n_categories") + 1 - F.col("_back")).cast("int")).drop("_back").where(F.col("rank") > top)
    return first.unionByName(last)


def segment_rows(values: DataFrame, top: int = 8) -> DataFrame:
    """The leading categories and up to three trailing ones, as ranked rows."""
    ends = ranked_ends(values, top)
    side = F.when(F.col("rank") <= top, "top").when(F.col("rank") > F.col("n_categories") - trailing(top), "bottom")
    return (
        ends.withColumn("side", side).where(F.col("side").isNotNull())
        .select(*KEYS, "side", "rank", "label", F.round("value", 4).alias("value"), "share_pct", "row_count")
        .orderBy("position", "rank")
    )


def segment_summary(values: DataFrame) -> DataFrame:
    """One row per dimension: categories, concentration, Gini, leader and laggard."""
    last = (F.col("rank") == F.col("n_categories")) & (trailing(8) > 0)
    at_end = lambda c: F.max(F.when(last, F.col(c)))
    at_front = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    ends = ranked_ends(values, 8, 1).groupBy(*KEYS).agg(
        F.max("n_categories").alias("n_categories"), F.max("total").alias("_total"), F.max("has_negative").alias("has_negative"),
        F.sum(F.when(F.col("rank") <= 3, F.col("share_pct"))).alias("_three"),
        at_front("label").alias("leader"), at_front("value").alias("_first"), at_front("share_pct").alias("leader_share_pct"),
        at_end("label").alias("laggard"), at_end("value").alias("_last"), at_end("share_pct").alias("laggard_share_pct"))
    sums = rank_sums(values.select(*KEYS, "value", "label"), KEYS, "value", "label")
    spread = 2 * F.col("rank_sum") - (F.col("n") + 1) * F.col("s.total")
    plain = (F.col("_total") > 0) & (F.col("n_categories") > 2) & ~F.col("has_negative")
    return ends.join(F.broadcast(sums.alias("s")), list(KEYS)).select(
        *KEYS, "n_categories", F.round("_total", 4).alias("total"),
        F.when(F.col("_total") != 0, F.round("_three", 2)).alias("concentration_pct"),
        F.round(F.when(plain, F.try_divide(spread, F.col("n") * F.col("s.total"))), 4).alias("gini"),
        "has_negative", F.when(F.col("has_negative"), "absolute_total").otherwise("total").alias("share_basis"),
        "leader", F.round("_first", 4).alias("leader_value"), "leader_share_pct",
        "laggard", F.round("_last", 4).alias("laggard_value"), "laggard_share_pct",
    ).orderBy("position")
