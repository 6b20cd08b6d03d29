"""Upper tail probabilities of the chi-square and F distributions, as Arrow-batched UDFs.

They run on feature-score tables, which hold one row per feature.
"""

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, Lentz fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1 - a
    c = 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def _beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_regularised(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / (1 + term * d or 1e-300)
            c = 1 + term / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def chi2_tail(score: float, df: float) -> float:
    return math.erfc(math.sqrt(score / 2)) if df == 1 else _gamma_upper(df / 2, score / 2)


def f_tail(score: float, df1: float, df2: float) -> float:
    if math.isinf(score):
        return 0.0
    return _beta_regularised(df2 / 2, df1 / 2, df2 / (df2 + df1 * score))


@F.pandas_udf(DoubleType())
def chi2_p_value(score: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) else chi2_tail(s, d) for s, d in zip(score, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def f_p_value(score: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(s) else f_tail(s, a, b) for s, a, b in zip(score, df1, df2)], dtype="float64"
    )


def digamma(x):
    """Digamma function of positive values: six steps of its recurrence, then the asymptotic series."""
    x = x.cast("double")
    shift = sum((1 / (x + i) for i in range(1, 6)), 1 / x)
    y = x + 6
    square = 1 / (y * y)
    series = F.ln(y) - 0.5 / y - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    return series - shift
