"""Surrogates on quartile conditions against a plain numpy version on the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlab.operators import surrogate as SU

COLS, CATS = ["a", "b"], ["c"]


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(rng.integers(0, 3)), ["x", "y", None][int(rng.choice(3, p=[0.6, 0.3, 0.1]))], 1.0) for i in range(800)]
    return spark.createDataFrame(rows, "customer_id long, a double, b double, c string, other double")


def score(df):
    return df.withColumn("p", 1 / (1 + F.exp(-(F.col("a") - 0.5 * F.col("b") + F.when(F.col("c") == "x", 1.0).otherwise(0.0) * F.col("other")))))


def test_weights_match_numpy_and_draws_follow_the_training_table(spark, train):
    df, n = train.filter("customer_id < 4"), 4000
    fit = SU.fit_binned(train, COLS, CATS)
    t = train.toPandas()
    nb = score(SU.neighbours(df, fit, n, 42, "customer_id")).toPandas()
    got = {r.customer_id: r for r in SU.surrogate_binned(df, COLS, score, CATS, n=n, train=train).collect()}
    edges = {c: np.unique(np.quantile(t[c], [0.25, 0.5, 0.75])) for c in COLS}
    for _, own in t[t.customer_id < 4].iterrows():
        m = nb[nb.customer_id == own.customer_id].sort_values("_i")
        assert len(m) == n and m.iloc[0][["a", "b"]].tolist() == [own.a, own.b]
        f = np.ones((n, 4))
        for j, c in enumerate(COLS):
            bins, home = np.searchsorted(edges[c], m[c]), np.searchsorted(edges[c], own[c])
            f[:, j + 1] = bins == home
            tb = np.searchsorted(edges[c], t[c])
            for b in np.unique(tb):
                inside, drawn = t[c][tb == b], m[c][bins == b]
                assert abs(len(drawn) / n - len(inside) / len(t)) < 0.04
                assert drawn.min() >= inside.min() - 1e-9 and drawn.max() <= inside.max() + 1e-9
        f[:, 3] = m.c == (own.c or "")
        assert abs((m.c == "x").mean() - (t.c == "x").mean()) < 0.04
        w = np.sqrt(np.exp(-(3 - f[:, 1:].sum(1)) / (0.75 * np.sqrt(3)) ** 2))
        a = f.T @ (w[:, None] * f) + np.diag([0.0, 1, 1, 1])
        coef = np.linalg.solve(a, f.T @ (w * m.p))
        r = got[own.customer_id]
        assert np.allclose([r.intercept, *r.weights], coef, atol=1e-9) and r.local_pred == pytest.approx(coef.sum())
        assert len(r.conditions) == 3 and r.conditions[2] == f"c = {own.c or ''}"


def test_missing_values_and_empty_tables(spark, train):
    df = spark.createDataFrame([(1, None, 2.0, None, 1.0)], train.schema)
    r = SU.surrogate_binned(df, COLS, score, CATS, n=50, train=train).collect()
    assert len(r) == 1 and np.isfinite(r[0].weights).all()
    assert SU.surrogate_binned(df.limit(0), COLS, score, CATS, n=50, train=train).collect() == []
    with pytest.raises(ValueError):
        SU.fit_binned(train.limit(0), COLS, CATS)


def test_truncated_table_is_the_cut_normal():
    t = SU.truncated_table(0.0, 1.0, -1.0, 2.0)
    z = SU.NormalDist()
    want = [z.inv_cdf(z.cdf(-1) + (z.cdf(2) - z.cdf(-1)) * i / SU.POINTS) for i in range(SU.POINTS + 1)]
    assert t == pytest.approx(want) and SU.truncated_table(3.0, 0.0, 3.0, 3.0) == [3.0] * (SU.POINTS + 1)
