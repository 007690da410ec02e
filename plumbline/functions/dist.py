"""Tail probabilities for a handful of scalars or a small column (no scipy needed)."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_N = NormalDist()


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf2(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t; normal when `dof` is infinite."""
    if math.isinf(dof):
        return math.erfc(abs(t) / math.sqrt(2))
    return beta_cdf(dof / (dof + t * t), dof / 2, 0.5)


def t_ppf(p: float, dof: float) -> float:
    """Upper quantile of Student's t for p > 0.5, by bisection."""
    if math.isinf(dof):
        return norm_ppf(p)
    lo, hi = 0.0, 2.0
    while 1 - t_sf2(hi, dof) / 2 < p:
        hi *= 2
        if hi > 1e12:
            return math.inf
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - t_sf2(mid, dof) / 2 < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of chi-square through the regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = k / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    """2 (1 - Phi(|z|)), for tables of slices or hypotheses."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))
