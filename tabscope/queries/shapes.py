"""Filters, aggregates, grouped tables, time buckets and numeric shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregate as A, distributions as D, segments as S, timeseries as T
from ..operators.filters import apply_filters
from ..specs import Filter
from .registry import query, table


def money(df: DataFrame, *names: str, places: int = 2) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, places))
    return df


def summed(df: DataFrame, filters) -> DataFrame:
    return apply_filters(df, filters).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


SUMMED = "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE "


@query("filter_eq", SUMMED + "o_orderpriority = '1-URGENT' AND o_orderdate = TIMESTAMP '1996-01-02'")
def filter_eq(spark, sf):
    return summed(table(spark, sf, "orders"), [
        Filter("o_orderpriority", "eq", "1-URGENT"), Filter("o_orderdate", "eq", "1996-01-02"),
        Filter("o_orderstatus", "eq", "")])


@query("filter_in", SUMMED + "CAST(o_custkey AS VARCHAR) IN ('1', '2', '77') AND o_orderstatus IN ('F', 'O')")
def filter_in(spark, sf):
    return summed(table(spark, sf, "orders"), [
        Filter("o_custkey", "in", ["1", "2", "77", None, ""]), Filter("o_orderstatus", "in", ["F", "O"])])


@query("filter_between_dates",
       SUMMED + "o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1997-02-28' AND o_totalprice >= 1000")
def filter_between_dates(spark, sf):
    return summed(table(spark, sf, "orders"), [
        Filter("o_orderdate", "between", ["1996-03-01", "1997-02-28"]), Filter("o_totalprice", "between", [1000, None])])


@query("filter_gte_lte", SUMMED + "o_totalprice >= 100000 AND o_totalprice <= 250000.5")
def filter_gte_lte(spark, sf):
    return summed(table(spark, sf, "orders"), [
        Filter("o_totalprice", "gte", 100000), Filter("o_totalprice", "lte", 250000.5)])


@query("detail_table", """
    SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
    WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100""")
def detail_table(spark, sf):
    return A.detail(table(spark, sf, "orders"), ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"],
                    [Filter("o_orderstatus", "eq", "F")], 100, "o_totalprice", ties=["o_orderkey"])


@query("row_count", "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 25")
def row_count(spark, sf):
    return A.row_count(table(spark, sf, "lineitem"), [Filter("l_quantity", "gte", 25)])


@query("scalar_aggs", """
    SELECT 'sum' AS aggregation, round(sum(l_extendedprice), 2) AS value FROM lineitem
    UNION ALL SELECT 'avg', round(avg(l_extendedprice), 4) FROM lineitem
    UNION ALL SELECT 'min', min(l_extendedprice) FROM lineitem
    UNION ALL SELECT 'max', max(l_extendedprice) FROM lineitem
    UNION ALL SELECT 'count', CAST(count(l_extendedprice) AS DOUBLE) FROM lineitem
    UNION ALL SELECT 'count_distinct', CAST(count(DISTINCT l_extendedprice) AS DOUBLE) FROM lineitem
    UNION ALL SELECT 'median', round(median(l_extendedprice), 4) FROM lineitem""")
def scalar_aggs(spark, sf):
    df = table(spark, sf, "lineitem")
    every = A.scalars(df, "l_extendedprice", ("sum", "avg", "min", "max", "count", "count_distinct", "median"))
    return every.select("aggregation", F.when(F.col("aggregation") == "sum", F.round("value", 2)).otherwise(F.round("value", 4)).alias("value"))


@query("agg_by_dimension", """
    SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value, count(*) AS row_count
    FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def agg_by_dimension(spark, sf):
    return money(A.by_dimension(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "sum"), "value")


@query("topk_asc", """
    SELECT CAST(o_custkey AS VARCHAR) AS label, round(avg(o_totalprice), 4) AS value, count(*) AS row_count
    FROM orders GROUP BY 1 ORDER BY avg(o_totalprice) ASC NULLS LAST, label LIMIT 10""")
def topk_asc(spark, sf):
    return money(A.by_dimension(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "avg", limit=10,
                                sort="value_asc"), "value", places=4)


@query("median_by_dimension", """
    SELECT l_returnflag AS label, round(median(l_extendedprice), 4) AS value, count(*) AS row_count
    FROM lineitem GROUP BY 1""")
def median_by_dimension(spark, sf):
    return money(A.by_dimension(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "median"),
                 "value", places=4)


@query("median_by_dimension_spread", """
    SELECT l_returnflag AS label, round(median(l_extendedprice), 4) AS value, count(*) AS row_count
    FROM lineitem GROUP BY 1""")
def median_by_dimension_spread(spark, sf):
    """The same medians by the bucketed way used when a group is too varied for one task."""
    df = table(spark, sf, "lineitem")
    return money(A.group_values(df, {"label": F.col("l_returnflag")}, "l_extendedprice", "median", in_task=100),
                 "value", places=4)


@query("distinct_by_dimension", """
    SELECT o_orderstatus AS label, count(DISTINCT o_custkey) AS value, count(*) AS row_count
    FROM orders GROUP BY 1""")
def distinct_by_dimension(spark, sf):
    return A.by_dimension(table(spark, sf, "orders"), "o_orderstatus", "o_custkey", "count_distinct")


@query("column_range", "SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def column_range(spark, sf):
    return A.column_range(table(spark, sf, "lineitem"), "l_shipdate")


@query("distinct_values", """
    SELECT CAST(p_brand AS VARCHAR) AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL
    GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def distinct_values(spark, sf):
    return A.distinct_values(table(spark, sf, "part"), "p_brand", 10)


@query("dim_by_series_topk", """
    WITH kept AS (SELECT p_type FROM part WHERE p_type IS NOT NULL GROUP BY 1
                  ORDER BY sum(p_retailprice) DESC NULLS LAST, p_type LIMIT 3),
    cells AS (SELECT p_brand AS label, p_type AS series, sum(p_retailprice) AS value
              FROM part WHERE p_brand IS NOT NULL AND p_type IN (SELECT p_type FROM kept) GROUP BY 1, 2),
    shown AS (SELECT label FROM cells GROUP BY 1 ORDER BY sum(value) DESC NULLS LAST, label LIMIT 10)
    SELECT label, series, round(value, 2) AS value FROM cells WHERE label IN (SELECT label FROM shown)""")
def dim_by_series_topk(spark, sf):
    return money(A.by_dimension_and_series(table(spark, sf, "part"), "p_brand", "p_type", "p_retailprice", "sum",
                                           limit=10, series_limit=3), "value")


@query("pivot_view", """
    SELECT l_returnflag AS label,
           round(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 2) AS "F",
           round(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 2) AS "O"
    FROM lineitem GROUP BY 1""")
def pivot_view(spark, sf):
    df = table(spark, sf, "lineitem")
    names = A.leading_labels(df, "l_linestatus", "l_extendedprice", "sum", 6)
    cells = A.by_dimension_and_series(df, "l_returnflag", "l_linestatus", "l_extendedprice", "sum", leaders=names)
    return money(A.pivot_series(cells, "label", names=names), "F", "O")


@query("share_view", """
    WITH shown AS (SELECT p_brand AS label, sum(p_retailprice) AS value, count(*) AS row_count
                   FROM part GROUP BY 1 ORDER BY value DESC NULLS LAST, label LIMIT 12)
    SELECT label, round(value, 2) AS value, row_count,
           round(abs(value) * 100.0 / sum(abs(value)) OVER (), 2) AS share FROM shown""")
def share_view(spark, sf):
    return money(A.with_share(A.by_dimension(table(spark, sf, "part"), "p_brand", "p_retailprice", "sum", limit=12)), "value")


SERIES = """
    SELECT date_trunc('{grain}', o_orderdate) AS period, round(sum(o_totalprice), 2) AS value, count(*) AS row_count
    FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1"""


def _series(grain):
    def run(spark, sf):
        return money(T.time_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "sum", grain), "value")
    return run


for _grain in ("day", "week", "month", "quarter", "year"):
    query(f"time_series_{_grain}", SERIES.format(grain=_grain).replace("AS period", "::TIMESTAMP AS period"))(_series(_grain))


@query("time_series_by_series", """
    WITH kept AS (SELECT event_type FROM events WHERE event_type IS NOT NULL GROUP BY 1
                  ORDER BY sum(value) DESC NULLS LAST, event_type LIMIT 3)
    SELECT date_trunc('day', ts)::TIMESTAMP AS period, event_type AS series, round(sum(value), 2) AS value
    FROM events WHERE ts IS NOT NULL AND event_type IN (SELECT event_type FROM kept) GROUP BY 1, 2""")
def time_series_by_series(spark, sf):
    return money(T.time_series_by(table(spark, sf, "events"), "ts", "event_type", "value", "sum", "day", series_limit=3), "value")


@query("histogram", """
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    c AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin_index, count(*) AS n
          FROM lineitem, b WHERE l_extendedprice IS NOT NULL GROUP BY 1)
    SELECT r.i AS bin_index, round(lo + r.i * ((hi - lo) / 20), 6) AS bin_start,
           round(lo + (r.i + 1) * ((hi - lo) / 20), 6) AS bin_end, coalesce(n, 0) AS count
    FROM range(20) r(i), b LEFT JOIN c ON c.bin_index = r.i""")
def histogram(spark, sf):
    return A.histogram(table(spark, sf, "lineitem"), "l_extendedprice").drop("label")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_matrix", "\n UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 4) AS value FROM lineitem" for a in NUMBERS for b in NUMBERS))
def correlation_matrix(spark, sf):
    return A.correlation_matrix(table(spark, sf, "lineitem"), NUMBERS)


@query("flag_rate", """
    SELECT round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 4) AS value FROM lineitem""")
def flag_rate(spark, sf):
    return money(A.flag_rate(table(spark, sf, "lineitem"), "l_returnflag", "R"), "value", places=4)


@query("conditional_count", "SELECT count(*) AS n FROM labels WHERE toxic = 1")
def conditional_count(spark, sf):
    flags = table(spark, sf, "labels").withColumn("toxic", F.col("toxic") == 1)
    return A.conditional_count(flags, "toxic", True)


def sales_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn(
        "discount_value", F.col("l_extendedprice") * F.col("l_discount")).withColumn(
        "net_price", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn(
        "revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))


@query("ratio_kpi", """
    SELECT round(100.0 * sum(l_extendedprice * l_discount) / sum(l_extendedprice), 4) AS value FROM lineitem""")
def ratio_kpi(spark, sf):
    return money(A.ratio(sales_lines(spark, sf), "discount_value", "l_extendedprice", 100.0), "value", places=4)


@query("time_series_many_periods", """
    SELECT TIMESTAMP '1900-01-01' + CAST(o_orderkey AS INTEGER) * INTERVAL 1 DAY AS period, round(sum(o_totalprice), 2) AS value,
           count(*) AS row_count FROM orders GROUP BY 1""")
def time_series_many_periods(spark, sf):
    """As many days as orders: no period is left out, however many there are."""
    day = F.lit("1900-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("o_orderkey").cast("int"))
    df = table(spark, sf, "orders").withColumn("day", day)
    return money(T.time_series(df, "day", "o_totalprice", "sum", "day"), "value")


@query("segment_many_categories", """
    WITH v AS (SELECT CAST(l_partkey AS VARCHAR) AS label, sum(l_quantity) AS value FROM lineitem GROUP BY 1),
    r AS (SELECT value, row_number() OVER (ORDER BY value, label) AS i, count(*) OVER () AS n FROM v)
    SELECT max(n) AS n_categories, round(sum(value), 2) AS total,
           round(sum((2 * i - n - 1) * value) / (max(n) * sum(value)), 4) AS gini FROM r""")
def segment_many_categories(spark, sf):
    values = S.dimension_values(table(spark, sf, "lineitem"), ["l_partkey"], "l_quantity", "sum")
    return money(S.segment_summary(values).select("n_categories", "total", "gini"), "total")


@query("segment_order_keys", """
    WITH v AS (SELECT CAST(l_orderkey AS VARCHAR) AS label, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rank, row_number() OVER (ORDER BY value, label) AS i,
                 count(*) OVER () AS n, sum(value) OVER () AS total FROM v)
    SELECT max(n) AS n_categories, round(sum(CASE WHEN rank <= 3 THEN round(value * 100 / total, 2) END), 2) AS concentration_pct,
           round(sum((2 * i - n - 1) * value) / (max(n) * sum(value)), 4) AS gini, arg_min(label, rank) AS leader,
           round(max(value), 2) AS leader_value, arg_max(label, rank) AS laggard, round(min(value), 2) AS laggard_value FROM r""")
def segment_order_keys(spark, sf):
    """As many categories as orders: ranks and Gini without a window over all of them."""
    values = S.dimension_values(table(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", "sum")
    return money(S.segment_summary(values).select(
        "n_categories", "concentration_pct", "gini", "leader", "leader_value", "laggard", "laggard_value"), "leader_value", "laggard_value")


@query("scatter_sample", """
    SELECT l_quantity AS x, l_extendedprice AS y, l_linestatus AS series FROM lineitem WHERE l_returnflag = 'R'
    ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber), x, y LIMIT 500""")
def scatter_sample(spark, sf):
    return A.scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice",
                     [Filter("l_returnflag", "in", ["R"])], "l_linestatus", 500, keys=["l_orderkey", "l_linenumber"])


# --- distributions -----------------------------------------------------------

PAIRS = ["l_quantity", "l_extendedprice", "net_price", "revenue"]
PAIR_VIEW = """lines AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net_price,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) AS revenue FROM lineitem)"""


@query("correlation_pairs", "WITH " + PAIR_VIEW + ", pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r, count(*) AS n FROM lines"
    for i, a in enumerate(PAIRS) for b in PAIRS[i + 1:]) + """)
    SELECT x, y, round(r, 4) AS coefficient, CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
           CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, n FROM pairs WHERE n >= 20 AND abs(r) >= 0.4""")
def correlation_pairs(spark, sf):
    return D.correlation_pairs(sales_lines(spark, sf), PAIRS).drop("p_value")


@query("iqr_outliers", """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM events),
    f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, n FROM q),
    o AS (SELECT value, lo, hi, n FROM events, f WHERE value < lo OR value > hi)
    SELECT 'value' AS "column", count(*) AS count, round(count(*) * 100.0 / max(n), 2) AS pct,
           round(max(lo), 4) AS lower_bound, round(max(hi), 4) AS upper_bound, round(max(value), 4) AS largest,
           round(min(value), 4) AS smallest FROM o""")
def iqr_outliers(spark, sf):
    found = D.iqr_outliers(table(spark, sf, "events"), ["value", "user_id"])
    return found.select("column", "count", "pct", "lower_bound", "upper_bound",
                        F.col("extreme_values")[0].alias("largest"), F.col("extreme_values")[3].alias("smallest"))


SHAPE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "revenue"]


@query("distribution_shape", "WITH " + PAIR_VIEW.replace("l_quantity,", "l_quantity, l_discount,") + " , s AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", skewness({c}) AS s, kurtosis({c}) AS k FROM lines" for c in SHAPE_COLUMNS) + """)
    SELECT "column", CASE WHEN s > 1 THEN 'right-skewed' WHEN s < -1 THEN 'left-skewed'
           WHEN k < -1 THEN 'uniform-ish' ELSE 'normal-ish' END AS shape, round(s, 4) AS skew, round(k, 4) AS kurtosis FROM s""")
def distribution_shape(spark, sf):
    return D.distribution_shape(sales_lines(spark, sf), SHAPE_COLUMNS)


@query("distribution_bins", """
    WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    c AS (SELECT least(floor((value - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin_index, count(*) AS n
          FROM events, b WHERE value IS NOT NULL GROUP BY 1)
    SELECT 'value' AS "column", r.i AS bin_index, round(lo + r.i * ((hi - lo) / 20), 4) AS bin_start,
           round(lo + (r.i + 1) * ((hi - lo) / 20), 4) AS bin_end, coalesce(n, 0) AS count
    FROM range(20) r(i), b LEFT JOIN c ON c.bin_index = r.i""")
def distribution_bins(spark, sf):
    return D.distribution_bins(table(spark, sf, "events"), ["value"])


# --- trends ------------------------------------------------------------------

PERIODS = """
periods AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS value,
                   count(*) AS row_count FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY period DESC) AS from_end, count(*) OVER () AS n_all FROM periods),
typical AS (SELECT median(row_count) AS t FROM numbered WHERE from_end > 1),
marked AS (SELECT period, value, row_count,
                  coalesce(from_end = 1 AND n_all > 3 AND t > 0 AND row_count < 0.6 * t, false) AS is_partial
           FROM numbered, typical),
points AS (SELECT period, value, row_count, strftime(period, '%Y-%m') AS label,
                  row_number() OVER (ORDER BY period) - 1 AS idx, count(*) OVER () AS n_periods
           FROM marked WHERE NOT is_partial)
"""


def monthly(spark, sf) -> DataFrame:
    return T.time_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "sum", "month")


@query("trend_partial_period", f"WITH {PERIODS} SELECT period, row_count, is_partial FROM marked")
def trend_partial_period(spark, sf):
    return T.mark_partial(monthly(spark, sf)).select("period", "row_count", "is_partial")


@query("trend_points", f"WITH {PERIODS} SELECT idx, label, round(value, 2) AS value, row_count FROM points")
def trend_points(spark, sf):
    points = T.trend_points(monthly(spark, sf), "month")
    return money(points.select(F.col("idx").cast("bigint").alias("idx"), "label", "value", "row_count"), "value")


@query("trend_summary", f"""WITH {PERIODS}, s AS (
    SELECT count(*) AS n_periods, arg_min(value, idx) AS first_value, arg_max(value, idx) AS last_value,
           arg_min(label, idx) AS first_period, arg_max(label, idx) AS last_period,
           max(value) AS best_value, min(value) AS worst_value, avg(value) AS m, stddev(value) AS sd FROM points)
    SELECT n_periods, round(first_value, 2) AS first_value, round(last_value, 2) AS last_value, first_period, last_period,
           round((last_value - first_value) * 100 / abs(first_value), 2) AS change_pct,
           CASE WHEN (last_value - first_value) * 100 / abs(first_value) > 5 THEN 'up'
                WHEN (last_value - first_value) * 100 / abs(first_value) < -5 THEN 'down' ELSE 'flat' END AS direction,
           (SELECT label FROM points ORDER BY value DESC, idx LIMIT 1) AS best_period, round(best_value, 2) AS best_value,
           (SELECT label FROM points ORDER BY value, idx LIMIT 1) AS worst_period, round(worst_value, 2) AS worst_value,
           round(sd * 100 / abs(m), 2) AS volatility_pct,
           (SELECT strftime(period, '%Y-%m') FROM marked WHERE is_partial) AS partial_period FROM s""")
def trend_summary(spark, sf):
    out = T.trend_summary(monthly(spark, sf), "month").drop("slope", "r_squared", "period_over_period_pct")
    return money(out, "first_value", "last_value", "best_value", "worst_value")


@query("trend_regression", f"""WITH {PERIODS}
    SELECT round(regr_slope(value, idx), 2) AS slope, round(regr_r2(value, idx), 4) AS r_squared FROM points""")
def trend_regression(spark, sf):
    return T.trend_summary(monthly(spark, sf), "month").select(
        F.round("slope", 2).alias("slope"), F.round("r_squared", 4).alias("r_squared"))


@query("trend_pop", f"""WITH {PERIODS}, l AS (SELECT idx, value, lag(value) OVER (ORDER BY idx) AS prev FROM points)
    SELECT round((value - prev) * 100 / abs(prev), 2) AS period_over_period_pct FROM l ORDER BY idx DESC LIMIT 1""")
def trend_pop(spark, sf):
    return T.trend_summary(monthly(spark, sf), "month").select("period_over_period_pct")


@query("trend_anomalies", f"""WITH {PERIODS}, v AS (SELECT idx, label, round(value, 4) AS value FROM points WHERE n_periods >= 21),
    r AS (SELECT *, median(value) OVER (ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS expected FROM v),
    z AS (SELECT *, (value - expected) / stddev(value - expected) OVER () AS z FROM r)
    SELECT label AS period, round(value, 2) AS value, round(expected, 2) AS expected,
           round((value - expected) * 100 / abs(expected), 2) AS deviation_pct, round(z, 2) AS z_score
    FROM z WHERE abs(z) >= 2.5 ORDER BY abs(z) DESC LIMIT 4""")
def trend_anomalies(spark, sf):
    return money(T.anomalies(monthly(spark, sf), "month"), "value", "expected")


DAYS = """
periods AS (SELECT TIMESTAMP '1900-01-01' + CAST(l_orderkey AS INTEGER) * INTERVAL 1 DAY AS period, sum(l_extendedprice) AS value,
                   count(*) AS row_count FROM lineitem GROUP BY 1),
""" + PERIODS[PERIODS.index("numbered AS"):].replace("'%Y-%m'", "'%Y-%m-%d'")


def daily(spark, sf) -> DataFrame:
    """A day for every order: far more periods than one stretch of the calendar has."""
    day = F.lit("1900-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("l_orderkey").cast("int"))
    return T.time_series(table(spark, sf, "lineitem").withColumn("day", day), "day", "l_extendedprice", "sum", "day")


@query("anomalies_many_periods", f"""WITH {DAYS}, v AS (SELECT idx, label, round(value, 4) AS value FROM points WHERE n_periods >= 21),
    r AS (SELECT *, median(value) OVER (ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS expected FROM v),
    z AS (SELECT *, (value - expected) / stddev(value - expected) OVER () AS z FROM r)
    SELECT label AS period, round(value, 2) AS value, round(expected, 2) AS expected, round(z, 2) AS z_score FROM z WHERE abs(z) >= 2.5""")
def anomalies_many_periods(spark, sf):
    out = T.anomalies(daily(spark, sf), "day", per_measure=1 << 30)
    return money(out.select("period", "value", "expected", "z_score"), "value", "expected")


@query("trend_many_periods", f"""WITH {DAYS}, s AS (
    SELECT count(*) AS n_periods, arg_min(label, idx) AS first_period, arg_max(label, idx) AS last_period,
           arg_min(value, idx) AS first_value, arg_max(value, idx) AS last_value, stddev(value) AS sd, avg(value) AS m,
           regr_slope(value, idx) AS slope FROM points)
    SELECT n_periods, first_period, last_period, round(first_value, 2) AS first_value, round(last_value, 2) AS last_value,
           round(slope, 4) AS slope, round(sd * 100 / abs(m), 2) AS volatility_pct FROM s""")
def trend_many_periods(spark, sf):
    out = T.trend_summary(daily(spark, sf), "day").withColumn("slope", F.round("slope", 4))
    return money(out.select("n_periods", "first_period", "last_period", "first_value", "last_value", "slope", "volatility_pct"),
                 "first_value", "last_value")


# --- segments ----------------------------------------------------------------

SEGMENT = """
    WITH v AS (SELECT {label} AS label, sum({value}) AS value, count(*) AS row_count FROM {table} GROUP BY 1
               ORDER BY value DESC NULLS LAST, label LIMIT 1000),
    t AS (SELECT *, count(*) OVER () AS n_categories, bool_or(value < 0) OVER () AS has_negative,
                 row_number() OVER (ORDER BY value DESC, label) AS rank,
                 row_number() OVER (ORDER BY value, label) AS i,
                 CASE WHEN bool_or(value < 0) OVER () THEN sum(abs(value)) OVER () ELSE sum(value) OVER () END AS total FROM v),
    s AS (SELECT *, round((CASE WHEN has_negative THEN abs(value) ELSE value END) * 100.0 / total, 2) AS share_pct FROM t)
"""
BRANDS = SEGMENT.format(label="p_brand", value="p_retailprice", table="part")
SIGNED = SEGMENT.format(label="l_returnflag", table="lineitem",
                        value="CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END")


@query("segment_analysis", BRANDS + """
    SELECT CASE WHEN rank <= 8 THEN 'top' ELSE 'bottom' END AS side, rank, label, round(value, 2) AS value, share_pct, row_count
    FROM s WHERE rank <= 8 OR rank > n_categories - least(3, greatest(0, n_categories - 8))""")
def segment_analysis(spark, sf):
    values = S.single_dimension(table(spark, sf, "part"), "p_brand", "p_retailprice", "sum")
    rows = S.segment_rows(values).select("side", F.col("rank").cast("bigint").alias("rank"), "label", "value", "share_pct", "row_count")
    return money(rows, "value")


@query("segment_gini", BRANDS + """
    SELECT max(n_categories) AS n_categories, round(sum(CASE WHEN rank <= 3 THEN share_pct END), 2) AS concentration_pct,
           round(sum((2 * i - n_categories - 1) * value) / (max(n_categories) * sum(value)), 4) AS gini FROM s""")
def segment_gini(spark, sf):
    values = S.single_dimension(table(spark, sf, "part"), "p_brand", "p_retailprice", "sum")
    return S.segment_summary(values).select("n_categories", "concentration_pct", "gini")


@query("segment_signed_share", SIGNED + "SELECT label, round(value, 2) AS value, share_pct, has_negative FROM s")
def segment_signed_share(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn(
        "signed", F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")))
    values = S.single_dimension(lines, "l_returnflag", "signed", "sum")
    return money(S.with_shares(values).select("label", "value", "share_pct", "has_negative"), "value")


@query("segments_in_one_scan", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS label, round(sum(o_totalprice), 2) AS value, count(*) AS row_count FROM orders GROUP BY 2"
    for d in ("o_orderstatus", "o_orderpriority")))
def segments_in_one_scan(spark, sf):
    values = S.dimension_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice", "sum")
    return money(values.drop("position"), "value")
