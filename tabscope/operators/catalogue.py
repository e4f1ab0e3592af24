"""Descriptions of a profiled table: fields, filters, dictionary, semantic model."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ref
from ..functions.text import humanize
from ..specs import KpiSpec, TableProfile, ViewSpec
from ..vocabulary import DATA_CATEGORIES, FORMAT_STRINGS, TABULAR_TYPES, VISUAL_TYPES
from . import aggregate, roles

MAX_FILTERS = 5
MAX_OPTIONS = 60


def field_catalogue(spark, profile: TableProfile) -> DataFrame:
    rows = []
    for c in profile.columns:
        is_measure = c.name in profile.measures
        averaged = c.role in ("percentage", "ratio", "demographic")
        rows.append((
            c.name, humanize(c.name), c.inferred_type, c.role, is_measure,
            c.name in profile.dimensions or c.groupable, c.inferred_type == "datetime", c.unique, c.missing_pct,
            "avg" if averaged else "sum" if is_measure else "count",
            profile.grain(c.name) if c.name == profile.primary_date else None))
    return spark.createDataFrame(rows, (
        "name string, label string, inferred_type string, semantic_role string, is_measure boolean, "
        "is_dimension boolean, is_temporal boolean, unique long, missing_pct double, suggested_aggregation string, "
        "default_grain string"))


def data_dictionary(spark, profile: TableProfile) -> DataFrame:
    rows = [
        (c.name, humanize(c.name), c.inferred_type, c.role, c.role_confidence, "; ".join(c.role_evidence), c.missing_pct,
         c.unique, c.name in profile.measures, c.name in profile.dimensions, ", ".join(c.sample_values[:3]))
        for c in profile.columns
    ]
    return spark.createDataFrame(rows, (
        "column string, display_name string, type string, role string, role_confidence double, role_evidence string, "
        "missing_pct double, unique_values long, is_measure boolean, is_dimension boolean, example_values string"))


def model_columns(spark, profile: TableProfile) -> DataFrame:
    rows = [
        (c.name, humanize(c.name), TABULAR_TYPES[c.inferred_type], c.role, DATA_CATEGORIES.get(c.role, "Uncategorized"),
         FORMAT_STRINGS.get(c.role), "sum" if c.name in profile.measures else "none", c.is_unique_key,
         c.role == "identifier" and c.is_unique_key, c.missing_pct, c.unique)
        for c in profile.columns
    ]
    return spark.createDataFrame(rows, (
        "name string, display_name string, data_type string, semantic_role string, data_category string, "
        "format_string string, summarize_by string, is_key boolean, is_hidden boolean, missing_pct double, "
        "unique_values long"))


def model_measures(spark, specs: Sequence[KpiSpec]) -> DataFrame:
    rows = [(s.name, s.id, s.calculation, s.format, s.why, s.source_columns) for s in specs]
    return spark.createDataFrame(rows, (
        "name string, identifier string, expression string, format string, description string, "
        "source_columns array<string>"))


def model_visuals(spark, views: Sequence[ViewSpec]) -> DataFrame:
    rows = [(v.id, VISUAL_TYPES[v.type], v.type, v.title, v.x, v.y, v.series, v.aggregation, v.time_grain, list(v.columns))
            for v in views]
    return spark.createDataFrame(rows, (
        "id string, visual_type string, native_type string, title string, category_axis string, value_axis string, "
        "series string, aggregation string, time_grain string, columns array<string>"))


def measure_ranking(spark, profile: TableProfile) -> DataFrame:
    rows = [(i + 1, n, roles.aggregation_for(profile, n), n == profile.primary_measure)
            for i, n in enumerate(roles.ranked_measures(profile))]
    return spark.createDataFrame(rows, "rank int, measure string, aggregation string, is_primary boolean")


def dimension_ranking(spark, profile: TableProfile) -> DataFrame:
    rows = [(i + 1, n, round(score, 4)) for i, (n, score) in enumerate(roles.dimension_scores(profile))]
    return spark.createDataFrame(rows, "rank int, dimension string, score double")


def column_roles(spark, profile: TableProfile) -> DataFrame:
    rows = [(c.name, c.inferred_type, c.role, c.role_confidence) for c in profile.columns]
    return spark.createDataFrame(rows, "column string, inferred_type string, role string, confidence double")


def filter_columns(profile: TableProfile) -> list[str]:
    """Columns offered as multi-selects, best first."""
    usable = [profile.get(n) for n in roles.segmentable(profile)]
    usable.sort(key=lambda c: (c.role not in ("geo", "dimension"), c.unique))
    return [c.name for c in usable[:MAX_FILTERS - (1 if profile.primary_date else 0)]]


def filter_options(df: DataFrame, profile: TableProfile) -> DataFrame:
    """``column, kind, operator, option, low, high``: a date range, then one row per option.

    Options come from one pass over all chosen columns, combined map-side.
    """
    parts = []
    date = profile.primary_date
    if date:
        ends = aggregate.column_range(df, date)
        parts.append(ends.where(F.col("lo").isNotNull()).select(
            F.lit(date).alias("column"), F.lit("date_range").alias("kind"), F.lit("between").alias("operator"),
            F.lit(None).cast("string").alias("option"), F.col("lo").cast("timestamp_ntz").alias("low"),
            F.col("hi").cast("timestamp_ntz").alias("high")))
    names = filter_columns(profile)
    if names:
        tags = [F.struct(F.lit(n).alias("column"), ref(df, n).cast("string").alias("option")) for n in names]
        options = df.select(F.inline(F.array(*tags))).where(F.col("option").isNotNull()).distinct()
        none = F.lit(None).cast("timestamp_ntz")
        parts.append(options.select("column", F.lit("multi_select").alias("kind"), F.lit("in").alias("operator"),
                                    "option", none.alias("low"), none.alias("high")))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "column string, kind string, operator string, option string, low timestamp_ntz, high timestamp_ntz")
    return reduce(DataFrame.unionByName, parts)
