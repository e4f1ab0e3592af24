import pytest
from helpers import SMALL, rows_of
from pyspark.sql import functions as F

from tabscope.operators import aggregate as A, distributions as D, segments as S, timeseries as T
from tabscope.operators.filters import apply_filters
from tabscope.specs import Filter, SpecError


@pytest.fixture(scope="module")
def typed(spark):
    rows = [("a", 1, 2.0, True), ("a", 2, None, False), ("b", 3, 6.0, None), (None, 4, 8.0, True), ("c.d", 7, 1.0, True)]
    return spark.createDataFrame(rows, "`na.me` string, k int, v double, flag boolean")


def test_filters(typed):
    def n(*filters):
        return apply_filters(typed, filters).count()

    assert n(Filter("na.me", "eq", "a")) == 2
    assert n(Filter("na.me", "eq", "")) == 5 and n(Filter("na.me", "in", [None, ""])) == 5
    assert n(Filter("k", "in", ["1", "07", 7])) == 2
    assert n(Filter("flag", "in", [True])) == 3
    assert n(Filter("v", "in", ["2.0"])) == 1
    assert n(Filter("k", "between", [2, None]), Filter("k", "between", ["", 4])) == 3
    assert n(Filter("k", "between", [1])) == 5
    with pytest.raises(SpecError):
        n(Filter("'; drop table", "eq", 1))
    with pytest.raises(SpecError):
        apply_filters(typed, [Filter("k", "eq", 1)], allowed={"v"})


def test_aggregates_need_a_measure_unless_counting(typed):
    assert A.scalar(typed, None, "count").first()[0] == 5
    assert A.scalar(typed, "v", "count").first()[0] == 4
    for how in ("sum", "count_distinct"):
        with pytest.raises(SpecError):
            A.scalar(typed, None, how)
    assert A.flag_rate(typed, "flag").first()[0] == pytest.approx(60.0)
    assert A.ratio(typed, "v", "k", 100.0).first()[0] == pytest.approx(100.0)


def test_groups_skip_null_labels_and_sort(typed):
    assert rows_of(A.by_dimension(typed, "na.me", "v", "sum")) == [("b", 6.0, 1), ("a", 2.0, 2), ("c.d", 1.0, 1)]
    assert [r[0] for r in rows_of(A.by_dimension(typed, "na.me", sort="x_desc"))] == ["c.d", "b", "a"]


def test_split_ranks_labels_by_their_total(spark):
    rows = [("x", "s1", 1.0), ("x", "s2", 9.0), ("y", "s1", 5.0), ("z", "s1", 2.0), ("z", "s3", 100.0), (None, "s2", 50.0)]
    df = spark.createDataFrame(rows, "l string, s string, v double")
    got = rows_of(A.by_dimension_and_series(df, "l", "s", "v", "sum", limit=2, series_limit=2))
    assert got == [("z", "s3", 100.0), ("x", "s2", 9.0)]


def test_histogram_covers_every_row_and_keeps_empty_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 2, 10]], "v double")
    rows = A.histogram(df, "v", 5).collect()
    assert [r["count"] for r in rows] == [3, 1, 0, 0, 1] and rows[-1]["bin_end"] == 10.0
    same = A.histogram(df.where("v = 0"), "v", 5).collect()
    assert [(r["bin_start"], r["bin_end"], r["count"]) for r in same] == [(0.0, 0.0, 2)]
    assert A.histogram(df.where("v > 99"), "v", 5).collect() == []


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, 3.0) for i in range(40)], "a double, b double, c double")
    got = {(r["x"], r["y"]): r["value"] for r in A.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == got["b", "a"] == 1.0 and got["a", "c"] is None and got["c", "c"] is None
    pairs = D.correlation_pairs(df, ["a", "b", "c"]).collect()
    assert [(p["x"], p["y"], p["strength"], p["n"]) for p in pairs] == [("a", "b", "strong", 40)]


def test_two_valued_columns_are_no_pair(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2) * 3 + i * 0.001) for i in range(60)], "a double, b double")
    assert D.correlation_pairs(df, ["a", "b"]).count() == 0


def test_scatter_filters_before_it_samples(spark):
    df = spark.range(10000).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"),
                                   (F.col("id") % 100 == 0).alias("rare"))
    assert A.scatter(df, "x", "y", [Filter("rare", "eq", True)], limit=50).count() == 50


def test_one_sided_outliers(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(v,) for v in (50.0, 60.0, 70.0, 80.0)], "v double")
    row = D.iqr_outliers(df, ["v"]).first()
    assert row["count"] == 4 and row["extreme_values"] == [80.0, 70.0, 60.0, 50.0, 60.0]


def test_shapes(spark):
    df = spark.range(1000).select(F.exp(F.col("id") / 100).alias("steep"), F.col("id").cast("double").alias("even"),
                                  (F.col("id") % 3).alias("few"))
    got = {r["column"]: r["shape"] for r in D.distribution_shape(df, ["steep", "even", "few"]).collect()}
    assert got == {"steep": "right-skewed", "even": "uniform-ish"}


# --- time --------------------------------------------------------------------


def test_partial_last_period_is_left_out(spark):
    days = spark.range(92).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int))").alias("d"), F.lit(10.0).alias("v"))
    row = T.trend_summary(T.time_series(days, "d", "v", "sum", "month"), "month").first()
    assert row["partial_period"] == "2024-04" and row["last_period"] == "2024-03" and row["n_periods"] == 3


def test_rising_series(spark):
    months = spark.range(24).select(F.expr("add_months(date'2022-01-01', cast(id as int))").cast("timestamp_ntz").alias("d"),
                                    (100 + 25.0 * F.col("id")).alias("v"))
    row = T.trend_summary(T.time_series(months, "d", "v", "sum", "month"), "month").first()
    assert row["direction"] == "up" and row["r_squared"] == pytest.approx(1.0) and row["slope"] == pytest.approx(25.0)
    assert row["best_period"] == "2023-12" and row["worst_period"] == "2022-01"
    assert T.trend_summary(T.time_series(months.limit(2), "d", "v", "sum", "month"), "month").count() == 0


def test_anomaly_window_matches_a_centred_rolling_median(spark):
    import pandas as pd

    values = [10, 11, 10, 12, 11, 90, 10, 11, 12, 10, 11, 10, 12.5]
    rows = spark.createDataFrame(
        [(i, float(v)) for i, v in enumerate(values)], "i int, v double").select(
        F.expr("add_months(date'2022-01-01', i)").cast("timestamp_ntz").alias("d"), "v")
    got = T.anomalies(T.time_series(rows, "d", "v", "sum", "month"), "month").collect()
    s = pd.Series(values, dtype=float)
    rolling = s.rolling(4, center=True, min_periods=2).median()
    z = (s - rolling) / (s - rolling).std()
    assert [r["period"] for r in got] == ["2022-06"]
    assert got[0]["expected"] == rolling[5] and got[0]["z_score"] == pytest.approx(round(z[5], 2))


# --- segments ----------------------------------------------------------------


def test_signed_shares_use_magnitudes(spark):
    df = spark.createDataFrame([(c, v) for c, v in (("a", 50.0), ("b", -30.0), ("c", 15.0), ("d", -5.0)) for _ in range(10)], "c string, v double")
    row = S.segment_summary(S.single_dimension(df, "c", "v", "sum")).first()
    shares = [r["share_pct"] for r in S.segment_rows(S.single_dimension(df, "c", "v", "sum")).collect()]
    assert row["has_negative"] and row["gini"] is None and row["share_basis"] == "absolute_total"
    assert sum(shares) == pytest.approx(100.0) and all(0 <= s <= 100 for s in shares)


def test_one_scan_equals_single_dimensions(spark):
    df = spark.read.parquet(f"{SMALL}/orders.parquet")
    both = S.dimension_values(df, ["o_orderstatus", "o_orderpriority"], "o_totalprice", "sum")
    for i, d in enumerate(("o_orderstatus", "o_orderpriority")):
        one = {r["label"]: round(r["value"], 2) for r in S.single_dimension(df, d, "o_totalprice", "sum").collect()}
        assert {r["label"]: round(r["value"], 2) for r in both.where(F.col("position") == i).collect()} == one


# --- plans that must hold at scale -------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_and_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    text = plan(A.by_dimension(df, "l_returnflag", "l_quantity", "sum", [Filter("l_linestatus", "in", ["F"]), Filter("l_suppkey", "in", ["3"])]))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string>" in text
    assert "EqualTo(l_linestatus,F)" in text and "EqualTo(l_suppkey,3)" in text
    assert "partial_sum" in text and "TakeOrderedAndProject" in text


def test_ranking_is_cut_before_the_shuffle(spark):
    from tabscope.operators.profile import top_values

    df = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    text = plan(top_values(df, {"l_shipmode": F.col("l_returnflag")}))
    assert text.count("WindowGroupLimit") >= 2


def test_no_plan_multiplies_rows(spark):
    from tabscope.queries import QUERIES

    for name in ("histogram", "dim_by_series_topk", "iqr_outliers", "segments_in_one_scan", "median_by_dimension_spread"):
        text = plan(QUERIES[name](spark, SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
