"""All analyses that apply to a profiled table, from a handful of scans."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, functions as F

from ..operators import distributions, roles, segments, timeseries
from ..session import new_path
from ..specs import TableProfile


@dataclass(frozen=True)
class Limits:
    """How much of each analysis is kept; None keeps all. As they stand, what a summary shows."""

    trends: int | None = 3
    segments: int | None = 5
    anomalies: int | None = 8
    shapes: int | None = 6
    correlations: int | None = 12
    outliers: int | None = 6
    anomalies_per_measure: int | None = 4


EVERYTHING = Limits(*[None] * len(fields(Limits)))


def stored(table: DataFrame, name: str) -> DataFrame:
    """A result table of any size, written once to the shared folder."""
    path = new_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def frozen(small: DataFrame) -> DataFrame:
    """A result table of bounded size as a local relation, so readers do not rescan."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


@dataclass
class Analysis:
    row_count: int
    grain: str | None
    trends: DataFrame
    points: DataFrame
    anomalies: DataFrame
    segments: DataFrame
    segment_rows: DataFrame
    correlations: DataFrame
    outliers: DataFrame
    distributions: DataFrame
    notes: list[str] = field(default_factory=list)

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in (
            "trends", "points", "anomalies", "segments", "segment_rows", "correlations", "outliers", "distributions")}


def analyze(df: DataFrame, profile: TableProfile, limits: Limits = Limits()) -> Analysis:
    """All analyses. What claims are checked against should come of ``EVERYTHING``."""
    notes = []
    date = profile.primary_date
    grain = profile.grain(date) if date else "month"
    spark = df.sparkSession
    if date:
        named = roles.ranked_measures(profile)[:limits.trends]
        measures = [(m, roles.aggregation_for(profile, m)) for m in named] or [(None, "count")]
        periods = stored(timeseries.measure_periods(df, date, measures, grain), "periods")
    else:
        notes.append("no date column: trends skipped")
        periods = spark.createDataFrame(
            [], "position int, measure string, period timestamp_ntz, value double, row_count long")
    points = timeseries.trend_points(periods, grain)
    trends = frozen(timeseries.trend_summary(periods, grain).orderBy("position"))
    odd = stored(timeseries.anomalies(periods, grain, limits.anomalies_per_measure, limits.anomalies), "anomalies")

    dimensions = roles.segmentable(profile)[:limits.segments]
    measure = profile.primary_measure
    how = roles.aggregation_for(profile, measure) if measure else "count"
    if dimensions:
        values = stored(segments.dimension_values(df, dimensions, measure, how), "segments")
    else:
        notes.append("no dimension with few values: segments skipped")
        values = spark.createDataFrame(
            [], "position int, dimension string, label string, value double, row_count long")

    numeric = roles.correlatable(profile)
    pairs = distributions.correlation_pairs(df, numeric, limits.correlations)
    if len(profile.measures) >= 2 and pairs.isEmpty():
        notes.append("no pair of measures is correlated enough to report")
    shapes = distributions.distribution_shape(df, numeric, {n: profile.get(n).unique for n in numeric})
    return Analysis(
        profile.n_rows, grain if date else None, trends, points, odd,
        frozen(segments.segment_summary(values).withColumn("measure", F.lit(measure or "row count"))),
        segments.segment_rows(values), pairs, frozen(distributions.iqr_outliers(df, numeric, limits.outliers)),
        frozen(shapes if limits.shapes is None else shapes.limit(limits.shapes)), notes)


def bundle_facts(analysis: Analysis) -> DataFrame:
    """``analysis, subject, figure, value``: the numbers of all analyses but their points, one a row."""
    def facts(table: DataFrame, name: str, subject: str, figures: list[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(f).alias("figure"), F.col(f).cast("double").alias("value")) for f in figures])
        return table.select(F.lit(name).alias("analysis"), F.col(subject).alias("subject"), F.inline(cells)).where("value is not null")

    pairs = analysis.correlations.withColumn("pair", F.concat_ws(" ", "x", "y"))
    odd = analysis.anomalies.withColumn("at", F.concat_ws(" ", "measure", "period"))
    parts = [
        facts(analysis.trends, "trend", "measure", ["n_periods", "first_value", "last_value", "best_value", "worst_value", "change_pct"]),
        facts(analysis.segments, "segment", "dimension", ["n_categories", "total", "gini", "concentration_pct", "leader_value", "laggard_value"]),
        facts(analysis.distributions, "distribution", "column", ["skew", "kurtosis"]),
        facts(odd, "anomaly", "at", ["value", "expected", "z_score"]),
        facts(pairs, "correlation", "pair", ["coefficient", "n"]),
        facts(analysis.outliers, "outliers", "column", ["count", "lower_bound", "upper_bound"])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
