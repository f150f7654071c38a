"""Exact quantiles by narrowing, KS and PSI without a table of distinct values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlab.operators import select as SL
from churnlab.operators import stats as ST


def frame(spark, **cols):
    rows = list(zip(*[[None if v is None else float(v) for v in c] for c in cols.values()], strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)


@pytest.mark.parametrize("small", [50, 100_000])
def test_quantiles_match_numpy_with_ties_and_narrowing(spark, small):
    rng = np.random.default_rng(1)
    n = 4000
    hot = rng.normal(size=n)
    hot[: n // 3] = 0.5  # a third of all rows hold one value
    data = dict(smooth=rng.lognormal(size=n), hot=hot, few=rng.integers(0, 4, n), same=np.full(n, 7.0), zero=np.where(rng.random(n) < 0.5, -0.0, 0.0))
    probs = [0.0, 0.1, 0.25, 0.5, 0.503, 0.9, 1.0]
    got = SL.exact_quantiles(frame(spark, **data), data, probs, small=small, grid=20)
    for c, x in data.items():
        for p in probs:
            assert got[c][p] == pytest.approx(np.quantile(x, p), abs=1e-12), (c, p)


def test_quantiles_edges(spark):
    d = frame(spark, a=[None, 3, 1, None], none=[None] * 4, nan=[1, math.nan, 2, math.nan])
    got = SL.exact_quantiles(d, ["a", "none", "nan"], [0.0, 0.5, 1.0], small=1, grid=4)
    assert got["a"] == {0.0: 1.0, 0.5: 2.0, 1.0: 3.0} and "none" not in got
    assert got["nan"][0.0] == 1.0 and math.isnan(got["nan"][1.0])  # NaN is the largest value
    assert SL.exact_quantiles(d.limit(0), ["a"], [0.5]) == {}


def ks(x, y):
    at = np.unique(np.concatenate([x, y]))
    return np.max(np.abs(np.searchsorted(np.sort(x), at, "right") / len(x) - np.searchsorted(np.sort(y), at, "right") / len(y)))


@pytest.mark.parametrize(("grid", "small"), [(4, 10), (4, 50_000), (400, 50_000)])
def test_ks_matches_brute_force(spark, grid, small):
    rng = np.random.default_rng(2)
    tied = lambda m, n: np.where(rng.random(n) < 0.33, 0.1, rng.normal(m, 1, n))
    ref = dict(a=rng.normal(size=900), b=tied(0, 900), c=rng.integers(0, 3, 900).astype(float), d=np.zeros(900))
    cur = dict(a=rng.normal(0.2, 1, 700), b=tied(0.3, 700), c=rng.integers(0, 4, 700).astype(float), d=-np.zeros(700))
    got = {r.feature: r.statistic for r in ST.drift_ks_stat(frame(spark, **ref), frame(spark, **cur), list(ref), grid=grid, small=small).collect()}
    assert got == {c: pytest.approx(ks(ref[c], cur[c]), abs=1e-12) for c in ref}


def test_ks_and_psi_without_values(spark):
    a, none = frame(spark, x=[1, 2, 3]), frame(spark, x=[None, None])
    assert ST.drift_ks_stat(a, none, ["x"]).collect() == [] and ST.drift_ks_stat(none, none, ["x"]).collect() == []
    assert ST.psi(none, a, ["x"]).collect() == []


def test_only_the_narrowed_interval_moves(spark, monkeypatch):
    """Of a continuous column the last step sees an interval, not the distinct values."""
    d = spark.range(20_000).select((F.xxhash64("id") / 2.0**63).alias("x"))
    seen = []
    finish = SL._finish
    monkeypatch.setattr(SL, "_finish", lambda df, spans: seen.extend(s.n for s in spans) or finish(df, spans))
    got = SL.exact_quantiles(d, ["x"], [0.5], small=1000)
    assert 0 < sum(seen) <= 1000 and got["x"][0.5] == pytest.approx(d.agg(F.percentile("x", 0.5)).first()[0])
