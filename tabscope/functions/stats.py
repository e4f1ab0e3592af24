"""Sample-corrected moments, guarded correlation and the Pearson p-value."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def sample_skewness(c: Column) -> Column:
    n = F.count(c).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(F.stddev_pop(c) > 0, F.skewness(c) * factor)


def sample_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    outer = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(F.stddev_pop(c) > 0, outer * ((n + 1) * F.kurtosis(c) + 6))


def correlation(a: Column, b: Column) -> Column:
    """Pearson over rows where both are present; null without variance.

    The built-in raises under ANSI mode for a constant input, hence covariance
    over deviations with a guarded division.
    """
    spread_a = F.stddev_pop(F.when(b.isNotNull(), a))
    spread_b = F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread_a * spread_b)


def pearson_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation, by the t distribution with n-2 degrees."""
    freedom = n - 2
    if freedom < 1:
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    return _beta_tail(1.0 - r * r, freedom / 2.0, 0.5)


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its even/odd continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(1.0 - x, b, a)
    log_front = (a * math.log(x) + b * math.log1p(-x)
                 - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    # Evaluate the fraction from the tail inwards with a fixed generous depth.
    value = 1.0
    for k in range(400, 0, -1):
        m = k // 2
        if k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1.0 + term / value
    return math.exp(log_front) / (a * value)
