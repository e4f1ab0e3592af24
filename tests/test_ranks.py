import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.functions import ranks
from tabscope.operators import segments as S
from tabscope.operators import timeseries as T


def test_rank_sums_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if k % 3 else f"g{k % 7}", float(np.round(v, 1)), f"l{k}") for k, v in enumerate(rng.normal(0, 4, 3000))]
    got = {r["g"]: r for r in ranks.rank_sums(spark.createDataFrame(rows, "g string, v double, l string").repartition(5), ["g"], "v", "l").collect()}
    for g in {r[0] for r in rows}:
        values = np.sort([r[1] for r in rows if r[0] == g])
        assert (got[g]["n"], got[g]["total"]) == (len(values), pytest.approx(values.sum()))
        assert got[g]["rank_sum"] == pytest.approx((values * np.arange(1, len(values) + 1)).sum())


def test_no_window_over_a_whole_dimension(spark):
    values = spark.range(50_000).select(
        (F.col("id") % 1).cast("int").alias("position"), F.concat(F.lit("k"), F.col("id") % 1).alias("dimension"),
        F.col("id").cast("string").alias("label"), (F.col("id") % 977).cast("double").alias("value"), F.lit(1).cast("bigint").alias("row_count"))
    summary = S.segment_summary(values)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    # Ranks from either end are cut per task before their window, and the third window has a row per task.
    assert plan.count("WindowGroupLimit") >= plan.count("Window [") and "_task" in plan
    v = np.sort(np.arange(50_000) % 977).astype(float)
    n = len(v)
    assert summary.first()["gini"] == pytest.approx(((2 * np.arange(1, n + 1) - n - 1) * v).sum() / (n * v.sum()), abs=1e-4)
    rows = S.segment_rows(values).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5, 6, 7, 8, n - 2, n - 1, n]
    assert rows[0]["label"] == "10746" and rows[-1]["label"] == "9770"


@pytest.fixture(scope="module")
def long_series(spark):
    """Two measures with a gap and odd days, one of them longer than several stretches and blocks."""
    rng = np.random.default_rng(6)
    start = datetime.datetime(1801, 1, 1)
    rows = []
    for position, (name, n) in enumerate((("a", 13_000), ("b", 40))):
        days = np.cumsum(rng.integers(1, 4, n))
        values = np.round(rng.normal(100, 5, n) + np.where(rng.random(n) < 0.01, 80, 0), 4)
        rows += [(position, name, start + datetime.timedelta(days=int(d)), float(v), int(c)) for d, v, c in zip(days, values, rng.integers(5, 9, n))]
    rows[-1] = (*rows[-1][:4], 1)
    schema = "position int, measure string, period timestamp_ntz, value double, row_count long"
    return spark.createDataFrame(rows, schema).repartition(6), rows


def test_periods_are_numbered_across_stretches(long_series):
    df, rows = long_series
    got = ranks.numbered(df, ["position", "measure"], "period").collect()
    for name, n in (("a", 13_000), ("b", 40)):
        order = sorted(r[2] for r in rows if r[1] == name)
        own = {r["period"]: (r["idx"], r["n_periods"]) for r in got if r["measure"] == name}
        assert own == {p: (i, n) for i, p in enumerate(order)}


def test_neighbours_reach_over_blocks(spark):
    rows = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("idx"))
    got = ranks.with_neighbours(rows, ["g"], 3, F.col("idx"), "near", block=10).collect()
    assert len(got) == 1000
    assert all(r["near"] == list(range(max(0, r["idx"] - 3), min(1000, r["idx"] + 4))) for r in got)


def test_anomalies_of_a_long_series(long_series):
    df, rows = long_series
    want = set()
    for name in "ab":
        own = sorted(r for r in rows if r[1] == name)[: -1 if name == "b" else None]
        own.sort(key=lambda r: r[2])
        v = np.array([r[3] for r in own])
        n = len(v)
        width = max(3, min(7, n // 3))
        ahead = (width - 1) // 2
        expected = np.array([np.median(v[max(0, i - (width - 1 - ahead)): i + ahead + 1]) for i in range(n)])
        z = (v - expected) / np.std(v - expected, ddof=1)
        want |= {(name, own[i][2].date().isoformat(), round(float(expected[i]), 4)) for i in np.flatnonzero(abs(z) >= 2.5)}
    got = T.anomalies(df, "day", per_measure=1 << 30).collect()
    assert {(r["measure"], r["period"], r["expected"]) for r in got} == want
    assert len(want) > 100
    summary = {r["measure"]: r for r in T.trend_summary(df, "day").collect()}
    assert summary["b"]["partial_period"] is not None and summary["b"]["n_periods"] == 39
    assert summary["a"]["partial_period"] is None and summary["a"]["n_periods"] == 13_000
