"""Tail probabilities for test results.

They run on result rows (a handful), never on data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)), na_action="ignore")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_two_sided_value(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t with ``df`` degrees of freedom."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_value(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")


def correlation_p(r: Column, df: Column) -> Column:
    """p of a correlation: t = r * sqrt(df / (1 - r^2)); null for |r| >= 1 or df <= 0."""
    t = r * F.sqrt(df / (F.lit(1.0) - r * r))
    return F.when((F.abs(r) < 1) & (df > 0), t_two_sided(t, df.cast("double")))


def kolmogorov_upper(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample p: 2 * sum (-1)^(k-1) exp(-2 k^2 lambda^2), clipped to [0, 1].

    Small lambda needs the companion (theta) form of the same series.
    """
    lam2 = d * d * n1 * n2 / (n1 + n2)
    alternating = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * lam2),
    )
    lam = F.sqrt(lam2)
    theta = F.aggregate(
        F.sequence(F.lit(1), F.lit(20)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.exp(-(2 * k - 1) * (2 * k - 1) * F.lit(math.pi**2) / (F.lit(8.0) * lam2)),
    )
    small = F.lit(1.0) - F.lit(math.sqrt(2.0 * math.pi)) / lam * theta
    p = F.when(lam2 <= 0, F.lit(1.0)).when(lam < 1.0, small).otherwise(alternating)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
