"""Special functions for p-values (scipy is not available).

They run on result tables with one row per feature / experiment, through an
Arrow-batched pandas UDF; the statistics themselves are Spark aggregates.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _gammq(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) (series for x < a+1, continued fraction otherwise)."""
    if x is None or a is None or math.isnan(x) or a <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b, c, d = x + 1.0 - a, 1.0 / 1e-300, 1.0 / (x + 1.0 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf_scalar(x: float, dof: float) -> float:
    if x is None or dof is None or dof <= 0 or math.isnan(x):
        return float("nan")
    return _gammq(dof / 2.0, x / 2.0)


def norm_sf_scalar(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def kolmogorov_sf_scalar(lam: float) -> float:
    """P(K > lam) for the Kolmogorov distribution (asymptotic two-sample KS)."""
    if lam is None or math.isnan(lam):
        return float("nan")
    if lam < 0.18:
        return 1.0
    s, k = 0.0, 1
    while k < 200:
        t = 2.0 * (-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam)
        s += t
        if abs(t) < 1e-16:
            break
        k += 1
    return min(1.0, max(0.0, s))


def ks_pvalue_scalar(d: float, n1: float, n2: float) -> float:
    """Asymptotic two-sample KS p-value with the Stephens small-sample adjustment."""
    if d is None or not n1 or not n2:
        return float("nan")
    en = math.sqrt(n1 * n2 / (n1 + n2))
    return kolmogorov_sf_scalar((en + 0.12 + 0.11 / en) * d)


@pandas_udf(T.DoubleType())
def _chi2_sf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf_scalar(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, k)], dtype="float64")


@pandas_udf(T.DoubleType())
def _norm_sf(z: pd.Series) -> pd.Series:
    return pd.Series([norm_sf_scalar(a) if pd.notna(a) else None for a in z], dtype="float64")


@pandas_udf(T.DoubleType())
def _ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([ks_pvalue_scalar(a, b, c) if pd.notna(a) else None for a, b, c in zip(d, n1, n2)], dtype="float64")


def chi2_sf(x: Column, dof: Column) -> Column:
    return _chi2_sf(x.cast("double"), dof.cast("double"))


def norm_sf(z: Column) -> Column:
    return _norm_sf(z.cast("double"))


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    return _ks_p(d.cast("double"), n1.cast("double"), n2.cast("double"))


def two_sided_normal_p(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * norm_sf(F.abs(z)))
