"""Rule-based findings and the evidence behind them.

Findings are projections of the analysis tables: a rule selects rows and spells
out their numbers. Nothing is stated that a table does not hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import compact_number, humanize, signed_percent
from ..plans.bundle import Analysis
from ..specs import TableProfile
from ..vocabulary import COST_NAME_PARTS
from .clean import CleaningReport

CONCENTRATED = 65.0
MOSTLY_MISSING = 20.0
SKEWED = 1.5
APART = 15.0
MOVED = 5.0
MIN_BODY = 40
TREND_COSTS = tuple(p for p in COST_NAME_PARTS if p != "loss")


def title_case(c: Column, names: list[str]) -> Column:
    """Display name of a column-name value; the few names come from the profile."""
    out = c
    for name in names:
        out = F.when(c == name, F.lit(humanize(name))).otherwise(out)
    return out


def whole(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%,.0f", c.cast("double"))).otherwise("n/a")


def tenth(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.1f", c.cast("double"))).otherwise("n/a")


def _finding(source: DataFrame, order: int, insight_id: Column, category: str, severity: Column, confidence: float,
             title: Column, body: Column, evidence: list[Column]) -> DataFrame:
    """``evidence``: the labels, as in the evidence index, of the figures that a finding rests on."""
    return source.select(
        F.lit(order).alias("position"), insight_id.alias("insight_id"), F.lit(category).alias("category"),
        severity.alias("severity"), F.lit(confidence).alias("confidence"), title.alias("title"), body.alias("body"),
        F.array_compact(F.array(*evidence)).alias("evidence"))


def _named(profile: TableProfile) -> list[str]:
    return [c.name for c in profile.columns] + ["row count"]


def insights(profile: TableProfile, analysis: Analysis, kpis: DataFrame, report: CleaningReport) -> DataFrame:
    """``position, insight_id, category, severity, confidence, title, body, evidence``."""
    names = _named(profile)
    found = [
        _trend(analysis, names), _divergence(analysis, names), _segments(analysis, names),
        _anomaly(analysis, names), _correlation(analysis, names), _skew(profile, analysis, names),
        _quality(kpis.sparkSession, report), _recommendation(analysis, kpis, names),
    ]
    return reduce(DataFrame.unionByName, found).orderBy("position", "insight_id")


def _trend(analysis: Analysis, names: list[str]) -> DataFrame:
    t = analysis.trends.where(F.col("position") == 0)
    label = title_case(F.col("measure"), names)
    verb = F.when(F.col("direction") == "up", "rose").when(F.col("direction") == "down", "fell").otherwise("stayed level")
    cost = F.lower("measure").rlike("|".join(TREND_COSTS))
    severity = F.when(F.col("direction") == "flat", "neutral").when(
        (F.col("direction") == "up") != cost, "positive").otherwise("warning")
    steadiness = F.when(
        F.col("r_squared") > 0.5, F.concat(F.lit(" A straight line explains it well (R2 "), F.format_string("%.2f", "r_squared"), F.lit(").")),
    ).when(F.col("volatility_pct") > 40, F.concat(F.lit(" Single periods vary a lot ("), whole(F.col("volatility_pct")), F.lit("% of the mean)."))).otherwise("")
    partial = F.when(F.col("partial_period").isNotNull(), F.concat(F.lit(" "), F.col("partial_period"), F.lit(" is incomplete and left out."))).otherwise("")
    body = F.concat(
        label, F.lit(" "), verb, F.lit(" by "), tenth(F.abs(F.coalesce("change_pct", F.lit(0.0)))), F.lit("% from "),
        F.col("first_period"), F.lit(" to "), F.col("last_period"), F.lit("; best "), F.lit(analysis.grain or "period"),
        F.lit(" "), F.col("best_period"), F.lit(", weakest "), F.col("worst_period"), F.lit("."), steadiness, partial)
    title = F.concat(label, F.lit(" "), verb, F.lit(" "), signed_percent(F.col("change_pct")))
    return _finding(t, 1, F.lit("headline_trend"), "trend", severity, 0.95, title, body, [
        F.concat(label, F.lit(" change over period")), *[F.concat(F.lit(f"{end} {analysis.grain or 'period'} for "), label) for end in ("Best", "Worst")]])


def _divergence(analysis: Analysis, names: list[str]) -> DataFrame:
    pair = analysis.trends.where(F.col("position") < 2).agg(
        F.count("change_pct").alias("n"), F.max_by("measure", "change_pct").alias("fast"),
        F.min_by("measure", "change_pct").alias("slow"), F.max("change_pct").alias("hi"), F.min("change_pct").alias("lo"))
    apart = pair.where((F.col("n") == 2) & (F.col("hi") - F.col("lo") > APART))
    fast, slow = title_case(F.col("fast"), names), title_case(F.col("slow"), names)
    body = F.concat(fast, F.lit(" changed "), signed_percent(F.col("hi")), F.lit(" while "), slow, F.lit(" changed "),
                    signed_percent(F.col("lo")), F.lit(": "), tenth(F.col("hi") - F.col("lo")), F.lit(" points apart."))
    return _finding(apart, 2, F.lit("measure_divergence"), "trend", F.lit("neutral"), 0.75,
                    F.concat(fast, F.lit(" outpaces "), slow), body, [F.concat(c, F.lit(" change over period")) for c in (fast, slow)])


def _segments(analysis: Analysis, names: list[str]) -> DataFrame:
    s = analysis.segments
    first = Window.partitionBy(F.lit(1)).orderBy("position")
    two = s.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= 2)
    dimension, measure = title_case(F.col("dimension"), names), title_case(F.col("measure"), names)
    heavy = (F.col("concentration_pct") > CONCENTRATED) & (F.col("n_categories") > 3)
    laggard = F.when(F.col("laggard").isNotNull(), F.concat(
        F.lit(" Last is "), F.col("laggard"), F.lit(" with "), whole(F.col("laggard_value")), F.lit("."))).otherwise("")
    heavily = F.when(heavy, F.concat(F.lit(" Three values make up "), whole(F.col("concentration_pct")), F.lit("%."))).otherwise("")
    signed = F.when(F.col("has_negative"), " Shares refer to magnitudes, as signs are mixed.").otherwise("")
    body = F.concat(F.col("leader"), F.lit(" has the most "), measure, F.lit(": "), whole(F.col("leader_value")), F.lit(" or "),
                    tenth(F.col("leader_share_pct")), F.lit("% over "), F.col("n_categories").cast("string"), F.lit(" values of "),
                    dimension, F.lit("."), laggard, heavily, signed)
    return _finding(two, 3, F.concat(F.lit("segment_"), F.col("dimension")), "segment",
                    F.when(heavy, "warning").otherwise("neutral"), 0.9,
                    F.concat(F.col("leader"), F.lit(" leads by "), dimension), body, [
                        F.concat(F.lit("Top "), dimension), F.when(heavy, F.concat(F.lit("Top 3 "), dimension, F.lit(" share"))),
                        F.when(F.col("laggard").isNotNull(), F.concat(F.lit("Lowest "), dimension))])


def _anomaly(analysis: Analysis, names: list[str]) -> DataFrame:
    a = analysis.anomalies.limit(1)
    label = title_case(F.col("measure"), names)
    body = F.concat(label, F.lit(" was "), whole(F.col("value")), F.lit(" in "), F.col("period"), F.lit(" where neighbouring periods suggest "),
                    whole(F.col("expected")), F.lit(" ("), signed_percent(F.col("deviation_pct")), F.lit(", z "),
                    F.format_string("%+.1f", "z_score"), F.lit("). Check the source before calling it a trend."))
    return _finding(a, 4, F.lit("anomaly"), "anomaly", F.when(F.col("deviation_pct") < 0, "warning").otherwise("neutral"), 0.8,
                    F.concat(label, F.lit(" stands out in "), F.col("period")), body, [F.concat(label, F.lit(" in "), F.col("period"))])


def _correlation(analysis: Analysis, names: list[str]) -> DataFrame:
    c = analysis.correlations.limit(1)
    x, y = title_case(F.col("x"), names), title_case(F.col("y"), names)
    body = F.concat(x, F.lit(" and "), y, F.lit(" have a "), F.col("strength"), F.lit(" "), F.col("direction"), F.lit(" correlation, r = "),
                    F.format_string("%.2f", "coefficient"), F.lit(" over "), whole(F.col("n")), F.lit(" rows. It does not show which drives which."))
    way = F.when(F.col("direction") == "positive", " rise and fall together").otherwise(" move against each other")
    return _finding(c, 5, F.lit("correlation"), "correlation", F.lit("neutral"), 0.85, F.concat(x, F.lit(" and "), y, way), body, [
        F.concat(F.lit("Correlation: "), x, F.lit(" vs "), y)])


def _skew(profile: TableProfile, analysis: Analysis, names: list[str]) -> DataFrame:
    d = analysis.distributions.where(F.abs("skew") > SKEWED).limit(1)
    label = title_case(F.col("column"), names)
    gap = F.lit("")
    for name in names:
        stats = (profile.get(name).numeric if profile.get(name) else None) or {}
        if stats.get("median"):
            text = (f" Mean {stats['mean']:,.1f} against median {stats['median']:,.1f}, "
                    f"{abs(stats['mean'] - stats['median']) / abs(stats['median']) * 100:.0f}% apart.")
            gap = F.when(F.col("column") == name, text).otherwise(gap)
    body = F.concat(label, F.lit(" is "), F.col("shape"), F.lit(" with a skew of "), F.format_string("%.2f", "skew"),
                    F.lit("; the median describes it better."), gap)
    return _finding(d, 6, F.concat(F.lit("distribution_"), F.col("column")), "distribution", F.lit("neutral"), 0.8,
                    F.concat(label, F.lit(" is strongly "), F.col("shape")), body, [F.concat(label, F.lit(" skew"))])


def _quality(spark, report: CleaningReport) -> DataFrame:
    gaps = [(m[0], m[2]) for m in report.missing if m[2] >= MOSTLY_MISSING]
    parts = []
    if report.duplicates_removed:
        parts.append(f"{report.duplicates_removed:,} duplicate rows were removed")
    if gaps:
        parts.append("many values are missing in " + ", ".join(f"{n} ({p:.1f}%)" for n, p in gaps[:3]))
    schema = "text string, quality double"
    rows = [("; ".join(parts), report.quality)] if parts else []
    body = F.concat(F.lit("Keep in mind: "), F.col("text"), F.lit(". Missing numbers are skipped, never filled in."))
    return _finding(spark.createDataFrame(rows, schema), 7, F.lit("data_quality"), "quality",
                    F.when(F.col("quality") < 85, "warning").otherwise("neutral"), 1.0,
                    F.lit("Limits of the data"), body, [
                        F.lit("Data quality score"), F.lit("Duplicate rows removed") if report.duplicates_removed else F.lit(None).cast("string"),
                        *[F.lit(f"{n} missing values") for n, _ in gaps[:3]]])


def _recommendation(analysis: Analysis, kpis: DataFrame, names: list[str]) -> DataFrame:
    """The first that applies: a concentrated segment, an unfavourable KPI, outliers."""
    dimension = title_case(F.col("dimension"), names)
    dense = analysis.segments.where((F.col("concentration_pct") > CONCENTRATED) & (F.col("n_categories") >= 5)).select(
        F.lit(1).alias("rule"), F.col("position").cast("double").alias("rank"), F.lit("warning").alias("severity"),
        F.lit(0.7).alias("confidence"), F.concat(F.lit("Rely less on the top values of "), dimension).alias("title"),
        F.concat(whole(F.col("concentration_pct")), F.lit("% comes from three of "), F.col("n_categories").cast("string"),
                 F.lit(" values, led by "), F.col("leader"), F.lit("; see whether the others can grow.")).alias("body"),
        F.array(F.concat(F.lit("Top 3 "), dimension, F.lit(" share"))).alias("evidence"))
    worse = kpis.where(~F.col("is_favorable") & (F.abs("change_pct") >= MOVED)).select(
        F.lit(2).alias("rule"), F.col("position").cast("double").alias("rank"), F.lit("warning").alias("severity"),
        F.lit(0.75).alias("confidence"), F.concat(F.col("name"), F.lit(" is heading the wrong way")).alias("title"),
        F.concat(F.col("name"), F.lit(" is "), F.col("formatted_value"), F.lit(", "), signed_percent(F.col("change_pct")),
                 F.lit(" "), F.col("period_label"), F.lit("; find the segment behind it.")).alias("body"), F.array("name").alias("evidence"))
    column = title_case(F.col("column"), names)
    far = analysis.outliers.select(
        F.lit(3).alias("rule"), (-F.col("pct")).alias("rank"), F.lit("neutral").alias("severity"),
        F.lit(0.7).alias("confidence"), F.concat(F.lit("Look into extreme values of "), column).alias("title"),
        F.concat(whole(F.col("count")), F.lit(" rows ("), tenth(F.col("pct")), F.lit("%) lie below "), whole(F.col("lower_bound")),
                 F.lit(" or above "), whole(F.col("upper_bound")), F.lit(" and pull averages along.")).alias("body"),
        F.array(F.concat(column, F.lit(" outliers"))).alias("evidence"))
    best = dense.unionByName(worse).unionByName(far).orderBy("rule", "rank").limit(1)
    return best.select(F.lit(8).alias("position"), F.lit("recommendation").alias("insight_id"),
                       F.lit("recommendation").alias("category"), "severity", "confidence", "title", "body", "evidence")


# --- evidence ----------------------------------------------------------------


def normal_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(c, "`", "")), r"(?U)\s+", " "))


def evidence_index(profile: TableProfile, analysis: Analysis, kpis: DataFrame, report: CleaningReport,
                   gaps: int | None = None) -> DataFrame:
    """``key, metric, value, detail``: every computed figure a claim may cite; of the columns
    with missing values the first ``gaps`` (None: all).

    The metric labels are fixed formats. A label occurring twice keeps its
    later figure.
    """
    names = _named(profile)
    spark = kpis.sparkSession

    def rows(source: DataFrame, order: int, metric: Column, value: Column, detail: Column) -> DataFrame:
        return source.select(F.lit(order).alias("position"), metric.alias("metric"), value.alias("value"), detail.alias("detail"))

    def named(column: str) -> Column:
        return title_case(F.col(column), names)

    moved = F.when(F.col("change_pct").isNotNull(), F.concat(
        F.lit(", "), signed_percent(F.col("change_pct")), F.lit(" "), F.col("period_label"))).otherwise("")
    grain = analysis.grain or "period"
    t, s, a = analysis.trends, analysis.segments, analysis.anomalies
    c, o, d = analysis.correlations, analysis.outliers, analysis.distributions
    quality = spark.createDataFrame(
        [("Data quality score", f"{report.quality:.0f}/100", f"{report.rows_after:,} rows after cleaning")]
        + ([("Duplicate rows removed", f"{report.duplicates_removed:,}", "before any figure was computed")]
           if report.duplicates_removed else [])
        + [(f"{m[0]} missing values", f"{m[2]:.1f}%", m[3]) for m in report.missing[:gaps]],
        "metric string, value string, detail string")
    parts = [
        rows(kpis, 1, F.col("name"), F.col("formatted_value"), F.concat(F.col("calculation"), moved)),
        rows(t, 2, F.concat(named("measure"), F.lit(" change over period")), signed_percent(F.col("change_pct")),
             F.concat(F.col("first_period"), F.lit(" to "), F.col("last_period"))),
        rows(t, 3, F.concat(F.lit(f"Best {grain} for "), named("measure")), F.col("best_period"), whole(F.col("best_value"))),
        rows(t, 4, F.concat(F.lit(f"Worst {grain} for "), named("measure")), F.col("worst_period"), whole(F.col("worst_value"))),
        rows(s, 5, F.concat(F.lit("Top "), named("dimension")), F.col("leader"),
             F.concat(whole(F.col("leader_value")), F.lit(" ("), tenth(F.col("leader_share_pct")), F.lit("%)"))),
        rows(s.where(F.col("laggard").isNotNull()), 6, F.concat(F.lit("Lowest "), named("dimension")), F.col("laggard"),
             F.concat(whole(F.col("laggard_value")), F.lit(" ("), tenth(F.col("laggard_share_pct")), F.lit("%)"))),
        rows(s.where(F.col("concentration_pct").isNotNull()), 7, F.concat(F.lit("Top 3 "), named("dimension"), F.lit(" share")),
             F.concat(tenth(F.col("concentration_pct")), F.lit("%")), F.concat(F.lit("of "), F.col("n_categories").cast("string"), F.lit(" categories"))),
        rows(c, 8, F.concat(F.lit("Correlation: "), named("x"), F.lit(" vs "), named("y")),
             F.concat(F.lit("r = "), F.format_string("%.2f", "coefficient")),
             F.concat(F.col("strength"), F.lit(" "), F.col("direction"), F.lit(", n = "), whole(F.col("n")))),
        rows(a, 9, F.concat(named("measure"), F.lit(" in "), F.col("period")), whole(F.col("value")),
             F.concat(F.lit("expected "), whole(F.col("expected")))),
        rows(o, 10, F.concat(named("column"), F.lit(" outliers")), F.concat(whole(F.col("count")), F.lit(" rows")),
             F.concat(tenth(F.col("pct")), F.lit("% beyond 1.5 IQR"))),
        rows(d.where(F.col("skew").isNotNull()), 11, F.concat(named("column"), F.lit(" skew")), F.format_string("%.2f", "skew"), F.col("shape")),
        rows(quality, 12, F.col("metric"), F.col("value"), F.col("detail")),
    ]
    every = reduce(DataFrame.unionByName, parts).withColumn("key", normal_label(F.col("metric")))
    latest = F.max_by(F.struct("metric", "value", "detail"), F.col("position")).alias("e")
    return every.groupBy("key").agg(latest).select("key", "e.metric", "e.value", "e.detail")


GRAM = 3


def _grams(c: Column) -> Column:
    """All pieces of up to GRAM characters, each once."""
    places = F.sequence(F.lit(1), F.length(c))
    return F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length(c) - i + 1)), lambda n: F.substring(c, i, n)))))


def _start(c: Column) -> Column:
    return F.substring(c, F.lit(1), F.least(F.lit(GRAM), F.length(c)))


def resolve_labels(labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """``key, metric`` for the distinct keys that name a figure.

    A key names the figure of the same key. Others name the only figure whose key contains
    them or lies within them: where a text contains another, its pieces contain the other's
    first letters, so pairs that share those are joined and then tested. Figures with the
    same first letters for every key there is would all meet; labels are not so.
    """
    keys = labels.select("key").where(F.col("key") != "").distinct()
    figures = evidence.select(F.col("key").alias("figure"), "metric")
    exact = keys.join(figures, F.col("key") == F.col("figure")).select("key", "metric")
    rest = keys.join(figures, F.col("key") == F.col("figure"), "left_anti")
    within = rest.withColumn("_g", _start(F.col("key"))).join(figures.withColumn("_g", F.explode(_grams(F.col("figure")))), "_g").where(
        F.contains("figure", "key"))
    around = rest.withColumn("_g", F.explode(_grams(F.col("key")))).join(figures.withColumn("_g", _start(F.col("figure"))), "_g").where(
        F.contains("key", "figure"))
    near = within.select("key", "figure", "metric").union(around.select("key", "figure", "metric")).groupBy("key").agg(
        F.count_distinct("figure").alias("_n"), F.min("metric").alias("metric")).where("_n = 1")
    return exact.unionByName(near.select("key", "metric"))


def resolve_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claim_id, accepted, evidence, category, severity`` for claims with cited labels ``refs``.

    Labels are resolved once each, by joins, however many claims cite them. A claim without a
    category or severity counts as a neutral summary.
    """
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in claims.columns else F.lit(default)
    told = claims.select(
        F.struct(F.monotonically_increasing_id().alias("_row"), F.col("claim_id").alias("claim_id"), F.trim("title").alias("title"),
                 F.trim("body").alias("body"), given("category", "summary").alias("category"), given("severity", "neutral").alias("severity")).alias("c"), "refs")
    # Rows are numbered before their labels are listed one by one.
    told = told.select("c", F.posexplode_outer("refs").alias("_at", "_ref")).withColumn("key", normal_label(F.col("_ref")))
    found = told.join(resolve_labels(told.where("key is not null"), evidence), "key", "left")
    cited = F.sort_array(F.collect_list(F.when(F.col("metric").isNotNull(), F.struct("_at", "metric"))))
    rows = found.groupBy("c").agg(F.array_distinct(F.transform(cited, lambda m: m["metric"])).alias("evidence"))
    solid = (F.length("c.body") >= MIN_BODY) & (F.length("c.title") > 0) & (F.size("evidence") > 0)
    return rows.select("c.claim_id", F.coalesce(solid, F.lit(False)).alias("accepted"), "evidence", "c.category", "c.severity")


def dataset_summary(profile: TableProfile, kpis: DataFrame, analysis: Analysis) -> DataFrame:
    """One row, one sentence."""
    opening = f"{profile.n_rows:,} rows, {len(profile.columns)} columns"
    dates = (profile.get(profile.primary_date).datetime if profile.primary_date else None) or {}
    if dates.get("min"):
        opening += f", {str(dates['min'])[:10]} to {str(dates['max'])[:10]}"
    kpi = kpis.where(F.col("position") == 0).select(F.concat(F.lower("name"), F.lit(" of "), F.col("formatted_value"))).scalar()
    names = _named(profile)
    split = analysis.segments.orderBy("position").limit(1).select(
        F.concat(F.lit("split over "), F.col("n_categories").cast("string"), F.lit(" values of "),
                 F.lower(title_case(F.col("dimension"), names)))).scalar()
    return kpis.sparkSession.range(1).select(F.concat(F.concat_ws(", ", F.lit(opening), kpi, split), F.lit(".")).alias("summary"))
