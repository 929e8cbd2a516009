"""Student-t distribution for already-aggregated rows.

Spark has no t distribution. These pandas UDFs run on the few rows left after an
aggregation. Below a hundred degrees of freedom the tail probability is a continued
fraction of the regularised incomplete beta function. From there on that fraction loses
digits, for its argument comes ever closer to one, and the density is integrated
instead, with its constant from the asymptotic series of lgamma(a + 1/2) - lgamma(a).
The quantile is a bisection on either.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Executors then need no copy of this package to run the functions below.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
#: Degrees of freedom from which the density is integrated.
_MANY = 100.0
_PANELS = 40
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta, by modified Lentz steps; NaN if it does not converge."""
    front, top, bottom = 1.0, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    bottom = 1.0 / (bottom if abs(bottom) > _TINY else _TINY)
    front = bottom
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            bottom = 1.0 + term * bottom
            bottom = 1.0 / (bottom if abs(bottom) > _TINY else _TINY)
            top = 1.0 + term / top
            top = top if abs(top) > _TINY else _TINY
            front *= top * bottom
        if abs(top * bottom - 1.0) < 1e-15:
            return front
    return math.nan  # not converged


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def _log_peak(df: float) -> float:
    """Logarithm of the density at zero, for many degrees of freedom.

    lgamma(a + 1/2) - lgamma(a) as a series: both are of the size of a log a, so their
    difference would keep no digit of what matters.
    """
    a = df / 2.0
    rise = (0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a ** 3) - 1 / (640 * a ** 5)
            + 17 / (14336 * a ** 7))
    return rise - 0.5 * math.log(math.pi * df)


def _tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0 and many degrees of freedom.

    Gauss-Legendre panels, each as wide as the density takes to fall to 1/e beyond t;
    behind the last one less than 1e-15 of the tail is left.
    """
    width = (df + t * t) / ((df + 1) * max(t, 1.0))
    u = t + width * (np.arange(_PANELS)[:, None] + (_NODES + 1) / 2)
    fall = (df + 1) / 2 * np.log1p(u / df * u)
    return float((np.exp(_log_peak(df) - fall) @ _WEIGHTS).sum() * width / 2)


def two_sided_p(t: float, df: float) -> float:
    """P(|T| > |t|) with ``df`` degrees of freedom."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if t == 0 or math.isinf(t):
        return float(t == 0)
    if df >= _MANY:
        return min(1.0, 2.0 * _tail(abs(t), df))
    return _beta_share(df / 2.0, 0.5, df / (df + t * t))


def quantile(p: float, df: float) -> float:
    """The t below which a share ``p`` of the distribution lies."""
    if math.isnan(p) or math.isnan(df) or df <= 0 or not 0.0 < p < 1.0:
        return math.nan
    tail = 2.0 * min(p, 1.0 - p)
    low, high = 0.0, 1.0
    while two_sided_p(high, df) > tail:
        low, high = high, high * 2.0
    if math.isnan(two_sided_p(high, df)):
        return math.nan
    for _ in range(200):
        middle = (low + high) / 2.0
        if middle in (low, high):
            break
        here = two_sided_p(middle, df)
        if math.isnan(here):
            return math.nan
        low, high = (middle, high) if here > tail else (low, middle)
    return math.copysign((low + high) / 2.0, p - 0.5)


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    pairs = zip(t.astype(float), df.astype(float))
    return pd.Series([two_sided_p(*pair) for pair in pairs], dtype=float)


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    pairs = zip(p.astype(float), df.astype(float))
    return pd.Series([quantile(*pair) for pair in pairs], dtype=float)
