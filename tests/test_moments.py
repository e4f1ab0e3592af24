import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.functions.moments import pair_moments
from tabscope.operators import aggregate as A, distributions as D


def brute(values):
    out = {}
    for i in range(values.shape[1]):
        for j in range(i, values.shape[1]):
            both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
            x, y = values[both, i], values[both, j]
            if len(x):
                out[i, j] = (len(x), x.mean(), y.mean(), ((x - x.mean()) ** 2).sum(), ((y - y.mean()) ** 2).sum(),
                             ((x - x.mean()) * (y - y.mean())).sum(), len(set(x)) > 2 and len(set(y)) > 2)
    return out


def test_pairs_against_plain_sums(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(0, 1, (400, 9))
    values[:, 1] = values[:, 0] * 2 + rng.normal(0, 0.1, 400) + 1e9
    values[:, 2] = rng.integers(0, 2, 400)
    values[:, 3] = 5.0
    values[:, 4] = np.nan
    values[::2, 5] = np.nan
    values[1::2, 6] = np.nan
    values[:, 7] = np.where(rng.random(400) < 0.5, np.nan, rng.integers(0, 3, 400))
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in values]
    df = spark.createDataFrame(rows, ", ".join(f"`c.{i}` double" for i in range(9))).repartition(7)
    names = [f"c.{i}" for i in range(9)]
    for block in (2, 64):
        got = {(r["x"], r["y"]): r for r in pair_moments(df, names, block).collect()}
        want = brute(values)
        assert set(got) == set(want)
        for k, (n, *sums, varied) in want.items():
            assert (got[k]["n"], got[k]["varied"]) == (n, varied), k
            assert [got[k][c] for c in ("mean_x", "mean_y", "var_x", "var_y", "cov")] == pytest.approx(sums, rel=1e-7, abs=1e-6), k
    assert pair_moments(df.limit(0), names).count() == 0


def test_a_rare_third_value_counts(spark):
    df = spark.range(3000).repartition(5).select((F.col("id") % 2).cast("double").alias("a"), F.when(F.col("id") == 1234, 0.5).otherwise(F.col("id") % 2).alias("b"))
    got = {(r["x"], r["y"]): r["varied"] for r in pair_moments(df, ["a", "b"]).collect()}
    assert got == {(0, 0): False, (0, 1): False, (1, 1): True}


def test_very_wide_table(spark):
    """A thousand columns: a plan that compiles and half a million pairs from one scan."""
    df = spark.range(300).select(*[F.sin(F.col("id") * (i + 1) / 7.0).alias(f"c{i}") for i in range(1000)]).repartition(3)
    names = df.columns
    values = np.sin(np.arange(300)[:, None] * (np.arange(1000) + 1) / 7.0)
    want = np.corrcoef(values.T)
    matrix = A.correlation_matrix(df, names)
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 400_000
    picked = matrix.where("x in ('c0', 'c77', 'c999') and y in ('c3', 'c500', 'c998')").collect()
    assert len(picked) == 9
    assert all(r["value"] == pytest.approx(want[int(r["x"][1:]), int(r["y"][1:])], abs=1e-4) for r in picked)
    assert matrix.count() == 1_000_000
