"""Cox proportional hazards, concordance and STL decomposition.

Cox: Newton-Raphson with Efron ties.  Each iteration is one Spark job: per
distinct time the sums of r = exp(x.b), x r and x x' r (all rows and events
only) -> risk-set suffix sums (bucketed running sums) -> closed sums over the tied
deaths of each time -> a single aggregate of log-likelihood, gradient and Hessian
(p + p^2 numbers), so the cost follows the distinct times.  The p x p solve runs on the driver.  Covariates are
standardised first (as the reference library does); the penalty is
0.5 * penalizer * ||b||^2 on the standardised scale.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlab.functions.special import norm_sf_scalar
from churnlab.operators.prefix import prefix_sum
from churnlab.session import cut_lineage


def tie_sums(c, d, direct: int = 32):
    """Columns h0, h1, h2: sums over l = 0 .. d - 1 of log(c - l), 1 / (c - l), 1 / (c - l)^2, for c >= d.

    The ``direct`` smallest values are added one by one; the others are differences of log-gamma, digamma and trigamma,
    whose expansions are exact to double precision from 32 on, so the cost does not depend on d."""
    k = F.least(d, F.lit(float(direct)))
    low = F.transform(F.sequence(F.lit(1), k.cast("int")), lambda i: c - d + i)
    y, m = c - d + k + 1.0, d - k  # the rest: y, y + 1 .. y + m - 1
    z = y + m

    def added(f):
        return F.aggregate(low, F.lit(0.0), lambda a, x: a + f(x))

    def series(x, terms):
        return sum(F.lit(a) / F.pow(x, F.lit(float(e))) for e, a in terms)

    log_gamma = ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680))
    digamma = ((1, -1 / 2), (2, -1 / 12), (4, 1 / 120), (6, -1 / 252), (8, 1 / 240))
    trigamma = ((2, 1 / 2), (3, 1 / 6), (5, -1 / 30), (7, 1 / 42), (9, -1 / 30))
    ratio = F.log1p(m / y)
    h0 = (y - 0.5) * ratio + m * F.log(z) - m + series(z, log_gamma) - series(y, log_gamma)
    h1 = ratio + series(z, digamma) - series(y, digamma)
    h2 = m / (y * z) + series(y, trigamma) - series(z, trigamma)
    rest = [F.when(m > 0, h).otherwise(0.0) for h in (h0, h1, h2)]
    fs = (F.log, lambda x: 1.0 / x, lambda x: 1.0 / (x * x))
    return [(added(f) + r).alias(f"h{i}") for i, (f, r) in enumerate(zip(fs, rest))]


def _cox_pass(d: DataFrame, p: int, beta: np.ndarray):
    xb = sum(F.col(f"x{j}") * F.lit(float(beta[j])) for j in range(p)) if p else F.lit(0.0)
    r = F.exp(xb)
    e = F.col("e")
    aggs = [F.sum(r).alias("a0"), F.sum(r * e).alias("d0"), F.sum(e).alias("d"), F.sum(xb * e).alias("xbe")]
    for j in range(p):
        aggs += [F.sum(F.col(f"x{j}") * r).alias(f"a1_{j}"), F.sum(F.col(f"x{j}") * r * e).alias(f"d1_{j}"),
                 F.sum(F.col(f"x{j}") * e).alias(f"xe_{j}")]
        for k in range(j, p):
            aggs += [F.sum(F.col(f"x{j}") * F.col(f"x{k}") * r).alias(f"a2_{j}_{k}"),
                     F.sum(F.col(f"x{j}") * F.col(f"x{k}") * r * e).alias(f"d2_{j}_{k}")]
    per_t = d.groupBy("t").agg(*aggs)
    svals = ["a0"] + [f"a1_{j}" for j in range(p)] + [f"a2_{j}_{k}" for j in range(p) for k in range(j, p)]
    cum = prefix_sum(per_t, "t", svals, descending=True, materialize=False, prefix="s_")
    # phi_l = a0 - l / d * d0 = q (c - l): the sums over the tied deaths l = 0 .. d - 1 have closed forms
    ev = cum.filter(F.col("d") > 0).withColumn("q", F.col("d0") / F.col("d")).withColumn("c", F.col("s_a0") / F.col("q"))
    ev = ev.withColumn("h", F.struct(*tie_sums(F.col("c"), F.col("d")))).select("*", "h.h0", "h.h1", "h.h2")
    c, n, q, h1, h2 = (F.col(x) for x in ("c", "d", "q", "h1", "h2"))
    p1, p1f = h1 / q, (c * h1 - n) / (q * n)  # sums of 1 / phi and of l / d / phi
    p2, p2f, p2ff = h2 / (q * q), (c * h2 - h1) / (q * q * n), (c * c * h2 - 2.0 * c * h1 + n) / (q * q * n * n)
    out = [F.sum(n * F.log(q) + F.col("h0")).alias("logphi")]
    for j in range(p):
        sj, dj = F.col(f"s_a1_{j}"), F.col(f"d1_{j}")
        out.append(F.sum(sj * p1 - dj * p1f).alias(f"g_{j}"))
        for k in range(j, p):
            sk, dk = F.col(f"s_a1_{k}"), F.col(f"d1_{k}")
            outer = sj * sk * p2 - (sj * dk + sk * dj) * p2f + dj * dk * p2ff
            out.append(F.sum(F.col(f"s_a2_{j}_{k}") * p1 - F.col(f"d2_{j}_{k}") * p1f - outer).alias(f"h_{j}_{k}"))
    tot = ev.agg(*out).first()
    ev1 = per_t.agg(F.sum("xbe").alias("xbe"), *[F.sum(f"xe_{j}").alias(f"xe_{j}") for j in range(p)]).first()
    ll = float(ev1["xbe"] or 0.0) - float(tot["logphi"] or 0.0)
    g = np.array([float(ev1[f"xe_{j}"] or 0.0) - float(tot[f"g_{j}"] or 0.0) for j in range(p)])
    h = np.zeros((p, p))
    for j in range(p):
        for k in range(j, p):
            h[j, k] = h[k, j] = -float(tot[f"h_{j}_{k}"] or 0.0)
    return ll, g, h


def cox_ph(df: DataFrame, duration: str, event: str, covariates, penalizer: float = 0.1, max_iter: int = 25,
           tol: float = 1e-9, min_rows: int = 20) -> DataFrame:
    """Hazard ratio, 95 % CI, p-value per covariate (complete rows only), plus log-likelihood and n."""
    cov = list(covariates)
    if duration in cov:
        raise ValueError("the duration column cannot also be a covariate")
    sub = df.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("double").alias("e"),
                    *[F.col(c).cast("double").alias(c) for c in cov]).dropna()
    st = sub.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cov],
                 *[F.stddev_samp(c).alias(f"s_{c}") for c in cov]).first()
    n = int(st["n"])
    if n < min_rows:
        raise ValueError(f"Cox PH needs at least {min_rows} complete rows, got {n}")
    mean = np.array([float(st[f"m_{c}"]) for c in cov])
    sd = np.array([float(st[f"s_{c}"] or 1.0) or 1.0 for c in cov])
    d = cut_lineage(sub.select("t", "e", *[((F.col(c) - F.lit(mean[j])) / F.lit(sd[j])).alias(f"x{j}") for j, c in enumerate(cov)]))
    p = len(cov)
    beta = np.zeros(p)

    def pen(ll, g, h, b):
        return ll - 0.5 * penalizer * float(b @ b), g - penalizer * b, h - penalizer * np.eye(p)

    ll, g, h = pen(*_cox_pass(d, p, beta), beta)
    for _ in range(max_iter):
        step = np.linalg.solve(h, g)
        new = beta - step
        ll2, g2, h2 = pen(*_cox_pass(d, p, new), new)
        halv = 0
        while ll2 < ll - 1e-12 and halv < 10:  # step halving keeps the likelihood increasing
            step = step / 2
            new = beta - step
            ll2, g2, h2 = pen(*_cox_pass(d, p, new), new)
            halv += 1
        beta, ll, g, h = new, ll2, g2, h2
        if np.max(np.abs(step)) < tol:
            break
    cov_m = np.linalg.inv(-h)
    se = np.sqrt(np.diag(cov_m))
    rows = []
    for j, c in enumerate(cov):
        coef, s = beta[j] / sd[j], se[j] / sd[j]
        z = coef / s if s > 0 else float("nan")
        pv = 2.0 * norm_sf_scalar(abs(z)) if z == z else float("nan")
        rows.append((c, float(coef), float(math.exp(coef)), float(math.exp(coef - 1.959963984540054 * s)),
                     float(math.exp(coef + 1.959963984540054 * s)), float(s), float(z), float(min(1.0, pv)), pv < 0.05, float(ll), n))
    return df.sparkSession.createDataFrame(rows, "covariate string, coef double, hazard_ratio double, ci_lower double, ci_upper double, "
                                                "se double, z double, p_value double, significant boolean, log_likelihood double, n bigint")


def cox_concordance(df: DataFrame, duration: str, event: str, risk: str) -> DataFrame:
    """Harrell's C: share of comparable pairs (T_i < T_j, i an event) ordered correctly (risk_i > risk_j),
    ties in risk count 1/2.  Exact for any number of distinct times and risks, without row pairs.

    Distinct times are ranked.  Two different ranks part at exactly one binary level: there they share the higher
    bits and have 0 and 1 below.  So each distinct (time, risk) is put once per level into the group of its higher
    bits; within a group, a running count over risk of the rows with bit 1 (later) gives, for the events with bit 0,
    how many later rows have a lower or equal risk.  Rows grow by the number of levels (log2 of distinct times).
    """
    d = df.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"),
                  F.col(risk).cast("double").alias("r")).dropna()
    cells = cut_lineage(d.groupBy("t", "r").agg(F.count(F.lit(1)).alias("n"), F.sum("e").cast("long").alias("ev")))
    times = prefix_sum(cells.groupBy("t").agg(F.lit(1).alias("one")), "t", ["one"]).select("t", (F.col("cum_one") - 1).cast("long").alias("rank"))
    times = cut_lineage(times)
    levels = max(1, (int(times.count()) - 1).bit_length())
    x = cells.join(times, "t").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    x = x.select("level", F.expr("rank >> (level + 1)").alias("grp"), "r", F.when(F.expr("(rank >> level) & 1 = 1"), F.col("n")).otherwise(0).alias("later"),
                 F.when(F.expr("(rank >> level) & 1 = 0"), F.col("ev")).otherwise(0).alias("ev"))
    g = x.groupBy("level", "grp", "r").agg(F.sum("later").alias("later"), F.sum("ev").alias("ev"))
    g = prefix_sum(g, "r", ["later"], by=["level", "grp"], totals=True)
    r = g.agg(F.sum(F.col("ev") * (F.col("cum_later") - F.col("later"))).alias("concordant"), F.sum(F.col("ev") * F.col("later")).alias("tied_risk"),
              F.sum(F.col("ev") * F.col("tot_later")).alias("comparable"))
    return r.withColumn("concordance", (F.col("concordant") + 0.5 * F.col("tied_risk")) / F.col("comparable"))


# ---------------------------------------------------------------------------------------------
# STL (robust LOESS decomposition), one series per group through applyInPandas
# ---------------------------------------------------------------------------------------------
def _loess(y: np.ndarray, w: np.ndarray, span: int, at: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
    """Local linear LOESS with tricube weights; ``at`` positions may lie outside [0, n-1]."""
    n = len(y)
    x = np.arange(n, dtype=float) if x is None else x
    q = min(span, n)
    out = np.empty(len(at))
    for k, a in enumerate(at):
        dist = np.abs(x - a)
        h = np.sort(dist)[q - 1]
        if span > n:
            h += (span - n) / 2.0
        h = max(h, 1e-12)
        u = np.clip(dist / h, 0, 1)
        ww = (1 - u ** 3) ** 3 * w
        sw = ww.sum()
        if sw <= 0:
            out[k] = y.mean()
            continue
        xm = (ww * x).sum() / sw
        ym = (ww * y).sum() / sw
        sxx = (ww * (x - xm) ** 2).sum()
        b = (ww * (x - xm) * (y - ym)).sum() / sxx if sxx > 1e-12 else 0.0
        out[k] = ym + b * (a - xm)
    return out


def _odd(v: float) -> int:
    i = int(math.ceil(v))
    return i if i % 2 == 1 else i + 1


def stl_numpy(y: np.ndarray, period: int = 12, seasonal: int = 13, robust: bool = True):
    n = len(y)
    trend_span = _odd(1.5 * period / (1 - 1.5 / seasonal))
    low_span = _odd(period + 1)
    inner, outer = (2, 15) if robust else (2, 1)
    rw = np.ones(n)
    trend = np.zeros(n)
    season = np.zeros(n)
    for _ in range(outer):
        for _ in range(inner):
            detr = y - trend
            c = np.zeros(n + 2 * period)
            for s0 in range(period):
                idx = np.arange(s0, n, period)
                sub = detr[idx]
                at = np.arange(-1, len(idx) + 1, dtype=float)
                sm = _loess(sub, rw[idx], seasonal, at)
                c[np.arange(s0, n + 2 * period, period)[: len(at)]] = sm
            ma = np.convolve(c, np.ones(period) / period, mode="valid")
            ma = np.convolve(ma, np.ones(period) / period, mode="valid")
            ma = np.convolve(ma, np.ones(3) / 3, mode="valid")
            low = _loess(ma, np.ones(len(ma)), low_span, np.arange(n, dtype=float))
            season = c[period: period + n] - low
            trend = _loess(y - season, rw, trend_span, np.arange(n, dtype=float))
        if robust:
            r = np.abs(y - season - trend)
            h = 6 * np.median(r)
            u = np.clip(r / h, 0, 1) if h > 0 else np.zeros(n)
            rw = (1 - u ** 2) ** 2
    return trend, season, y - trend - season


STL_OUT = T.StructType([T.StructField("series", T.StringType()), T.StructField("month", T.StringType()),
                        T.StructField("value", T.DoubleType()), T.StructField("trend", T.DoubleType()),
                        T.StructField("seasonal", T.DoubleType()), T.StructField("residual", T.DoubleType()),
                        T.StructField("trend_strength", T.DoubleType()), T.StructField("seasonal_strength", T.DoubleType())])


def stl_decompose(series: DataFrame, by: str, period: int = 12, seasonal: int = 13) -> DataFrame:
    """Robust STL per series (``by``) on (month, value) rows; needs 2 x period points; gaps interpolated."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        y = pdf["value"].astype(float).interpolate(limit_direction="both").to_numpy()
        if len(y) < 2 * period:
            return pd.DataFrame(columns=[f.name for f in STL_OUT.fields])
        tr, se, re = stl_numpy(y, period, seasonal)
        vr = float(np.var(re))
        ts = max(0.0, 1 - vr / (vr + float(np.var(tr)))) if vr + float(np.var(tr)) > 0 else 0.0
        ss = max(0.0, 1 - vr / (vr + float(np.var(se)))) if vr + float(np.var(se)) > 0 else 0.0
        return pd.DataFrame({"series": pdf[by].astype(str).to_numpy(), "month": pdf["month"].to_numpy(), "value": y, "trend": tr,
                             "seasonal": se, "residual": re, "trend_strength": round(ts, 4), "seasonal_strength": round(ss, 4)})
    return series.groupBy(by).applyInPandas(fn, STL_OUT)
