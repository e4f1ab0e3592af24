import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.functions.quantiles import column_percentiles, percentiles
from tabscope.functions.stats import pearson_p_value
from tabscope.operators import aggregate as A

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, with repeated and extreme values."""
    rng = np.random.default_rng(5)
    groups = np.where(rng.random(6000) < 0.7, "hot", rng.choice(list("abc"), 6000))
    values = np.where(rng.random(6000) < 0.3, 7.0, np.round(rng.lognormal(3, 2, 6000), 3))
    rows = [(str(g), float(v)) for g, v in zip(groups, values)] + [("single", 1.5)]
    return spark.createDataFrame(rows, "g string, v double"), rows


def test_bucketed_percentiles_equal_brute_force(skewed):
    df, rows = skewed
    got = {r["g"]: r["p"] for r in percentiles(df, F.col("v"), PROBS, {"g": F.col("g")}, in_task=10).collect()}
    for g in {g for g, _ in rows}:
        assert got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g], PROBS))


def test_both_ways_agree_on_whole_columns(skewed):
    df, rows = skewed
    expected = pytest.approx(np.quantile([v for _, v in rows], PROBS))
    assert column_percentiles(df, {"v": F.col("v")}, PROBS)["v"] == expected
    assert column_percentiles(df, {"v": F.col("v")}, PROBS, in_task=10)["v"] == expected


def test_median_of_a_varied_group(skewed):
    df, rows = skewed
    got = {r["k"]: (r["value"], r["row_count"]) for r in A.group_values(df, {"k": F.col("g")}, "v", "median", in_task=10).collect()}
    hot = [v for g, v in rows if g == "hot"]
    assert got["hot"] == (pytest.approx(np.median(hot)), len(hot))


def test_p_values():
    assert pearson_p_value(0.5, 20) == pytest.approx(0.0247696, rel=1e-4)
    assert pearson_p_value(0.1, 100) == pytest.approx(0.3222174, rel=1e-4)
    assert pearson_p_value(1.0, 10) == 0.0


def quantile(values, p):
    """The mean of two neighbours by their distance; by halves, so that no difference overflows."""
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    return values[low] * (1 - (at - low)) + (values[low + 1] * (at - low) if at > low else 0.0)


def test_extreme_values(spark):
    rng = np.random.default_rng(8)
    wide = [float(x) for x in 10.0 ** rng.uniform(-308, 308, 900)]
    values = {"wide": wide + [-x for x in wide[::3]] + [0.0, -0.0, 5e-324, 1.7e308, -1.7e308],
              "near": [1.0 + k * 2**-52 for k in range(500)], "one": [4.0] * 300, "tiny": [k * 5e-324 for k in range(300)]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("none", None), ("none", float("nan")), ("wide", float("inf")), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in percentiles(df, F.col("v"), PROBS, {"g": F.col("g")}, in_task=7).collect()}
    for g, vs in values.items():
        assert got[g]["p"] == pytest.approx([quantile(vs, p) for p in PROBS], rel=1e-12, abs=0), g
    assert got["none"]["p"] is None and got["none"]["n"] == 2 and got["one"]["n"] == 301
    assert percentiles(df.where("false"), F.col("v"), PROBS).collect()[0]["p"] is None


def test_many_distinct_values(spark):
    """Two million different values of uneven spread, far more than a task sorts."""
    n = 2_000_000
    df = spark.range(n).select(F.exp((F.col("id") * 7919 % n) / 100_000.0).alias("v"))
    p = percentiles(df, F.col("v"), PROBS)
    assert p.first()["p"] == pytest.approx(np.quantile(np.exp(np.arange(n) / 100_000), PROBS), rel=1e-9)


def test_ranges_are_small_and_few(spark, monkeypatch):
    """What is sorted in one task is at most what was asked for, whatever the number of values."""
    from tabscope.functions import quantiles

    seen = []
    staged = quantiles._staged

    def watched(df, name):
        made = staged(df, name)
        if name == "ranges":
            seen.append(made.selectExpr("max(_distinct)", "count(*)").first())
        return made

    monkeypatch.setattr(quantiles, "_staged", watched)
    df = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("g"), (F.col("id") * 1.5).alias("v"))
    percentiles(df, F.col("v"), [0.1, 0.5], {"g": F.col("g")}, in_task=40).collect()
    assert seen[0][0] > 40 >= seen[-1][0]
    assert seen[-1][1] <= 8
