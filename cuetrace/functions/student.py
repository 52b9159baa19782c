"""Student t and F distribution functions for small result tables.

Every call works on the rows of an already aggregated table (one per frame, measure or
signal): t quantiles as built-in expressions, tails of F in Arrow batches inside the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function, evaluated bottom-up."""
    value = 1.0
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + even / (1 + odd / value)
    first = -(a + b) * x / (a + 1)
    return 1 / (1 + first / value)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    return math.exp(log_front) / a * _beta_fraction(a, b, x)


def t_upper(t: float, df: float) -> float:
    """P(T > t) for t >= 0."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t)) / 2


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t for p > 0.5, by bisection."""
    low, high = 0.0, 2.0
    while t_upper(high, df) > 1 - p:
        low, high = high, 2 * high
    while (mid := (low + high) / 2) not in (low, high):
        if t_upper(mid, df) > 1 - p:
            low = mid
        else:
            high = mid
    return high


def f_upper(f: float, df1: float, df2: float) -> float:
    """P(F > f) of the F distribution."""
    return beta_cdf(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


NEWTON_STEPS = 40


def t_quantile(confidence: float):
    """Column function: two-sided t quantile for a column of whole degrees of freedom; NULL below 1.

    A built-in expression, so that results need no Python. With theta = atan(t / sqrt(df)), P(|T| < t) is a finite sum of
    powers of cos(theta) (Abramowitz & Stegun 26.7.3-4) and its derivative is c cos(theta)^(df - 1). The sum grows ever
    more slowly with theta, so Newton steps from 0 never pass the quantile.
    """
    def inside(theta: Column, odd: Column, terms: Column) -> Column:
        """P(|T| < t): the next term is the last one times cos^2 times (2k - 1) / 2k, or 2k / (2k + 1) if odd."""
        def add(state: Column, k: Column) -> Column:
            ratio = F.when(odd, 2.0 * k / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
            term = state["term"] * ratio * F.cos(theta) * F.cos(theta)
            return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

        first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
        more = F.when(terms > 1, F.sequence(F.lit(1.0).cast("int"), terms - 1)).otherwise(F.array().cast("array<int>"))
        whole = F.aggregate(more, F.struct(first.alias("term"), first.alias("sum")), add, lambda s: s["sum"])
        some = F.when(terms > 0, whole).otherwise(F.lit(0.0))
        return F.when(odd, (theta + F.sin(theta) * some) * (2.0 / math.pi)).otherwise(F.sin(theta) * some)

    def solved(df: Column) -> Column:
        odd, terms = df % 2 == 1, F.floor(df / 2).cast("int")
        # c of 1 is 2 / pi, of 2 it is 1, and of df + 2 that of df times (df + 1) / df.
        smaller = F.when(df > 2, F.sequence(F.when(odd, 1).otherwise(2), df - 2, F.lit(2))).otherwise(
            F.array().cast("array<int>"))
        scale = F.aggregate(smaller, F.when(odd, F.lit(2.0 / math.pi)).otherwise(F.lit(1.0)),
                            lambda c, k: c * (k + 1.0) / k)

        def step(constants: Column) -> Column:
            def newton(theta: Column, _) -> Column:
                slope = constants["scale"] * F.pow(F.cos(theta), constants["df"] - 1.0)
                return theta + (F.lit(confidence) - inside(theta, constants["odd"], constants["terms"])) / slope

            theta = F.aggregate(F.array_repeat(F.lit(0), NEWTON_STEPS), F.lit(0.0), newton)
            return F.tan(theta) * F.sqrt(constants["df"])

        constants = F.struct(df.cast("double").alias("df"), odd.alias("odd"), terms.alias("terms"), scale.alias("scale"))
        return F.get(F.transform(F.array(constants), step), F.lit(0))

    def quantile(df: Column) -> Column:
        return F.when(df >= 1, F.get(F.transform(F.array(df.cast("int")), solved), F.lit(0)))

    return quantile


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Column function: P(F > f); NULL for a NULL f."""
    return pd.Series([f_upper(*row) if not np.isnan(row).any() else None
                      for row in zip(f, df1, df2)], dtype="float64")
