"""Neighbours drawn in tasks are those of the column expressions; sums and likeness equal plain ones; no pair is exchanged."""

import numpy as np
from pyspark.sql import functions as F

from churnlab.operators import explain as X
from churnlab.operators import models as MD
from churnlab.operators import neighbours as NB

COLS = ["a", "a_long_name", "a_name_of_more_than_thirty_two_bytes_in_all"]


def _rows(spark):
    rows = [(i, float(i % 3), None if i == 4 else float(i), 1.0, "x" if i % 2 else "y") for i in range(7)] + [(3, 0.5, 0.5, 2.0, "y")]  # 3 repeats
    return spark.createDataFrame(rows, f"customer_id long, {', '.join(f'{c} double' for c in COLS)}, kind string")


def _score(df):
    z = sum(F.col(c) for c in COLS) - 5.0 + F.when(F.col("kind") == "x", 1.0).otherwise(0.0)
    return df.withColumn("p", 1 / (1 + F.exp(-z)))


def _expressions(df, n, seed):
    """(key, moved columns, draws, p) by column expressions."""
    mean, sd = X._scales(df, COLS)
    x = df.select("customer_id", "kind", *[F.coalesce(F.col(c), F.lit(mean[c])).alias(c) for c in COLS]).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    z = {c: X.hash_normal(seed, F.col("customer_id").cast("string"), F.col("_i").cast("string"), c) for c in COLS}
    return _score(x.select("customer_id", "kind", *[(F.col(c) + z[c] * sd[c]).alias(c) for c in COLS], *[z[c].alias(f"_z_{c}") for c in COLS])).collect()


def test_surrogates_equal_column_expressions(spark):
    df, n = _rows(spark), 1203  # numbers of one to four digits
    sur = X.surrogate_local(df, COLS, _score, n=n)
    got = {r.customer_id: r for r in sur.collect()}
    drawn = _expressions(df, n, 42)
    assert sorted(got) == list(range(7))
    for k in got:
        own = [r for r in drawn if r.customer_id == k]
        z = np.array([[1.0, *(r[f"_z_{c}"] for c in COLS)] for r in own])
        w, p = np.exp(-(z[:, 1:] ** 2).sum(axis=1) / (np.sqrt(3) * 0.75) ** 2), np.array([r.p for r in own])
        want = np.linalg.solve((z * w[:, None]).T @ z + np.diag([0.0, 1, 1, 1]), (z * w[:, None]).T @ p)
        assert np.allclose([got[k].intercept, *got[k].weights], want, rtol=1e-9)
    fid = X.surrogate_fidelity(df, sur, COLS, _score, n=300).collect()
    drawn = _expressions(df, 300, 7)
    assert sorted(r.customer_id for r in fid) == list(range(7))
    for r in fid:
        own = [d for d in drawn if d.customer_id == r.customer_id]
        p, s = np.array([d.p for d in own]), np.array([got[r.customer_id].intercept + sum(w * d[f"_z_{c}"] for w, c in zip(got[r.customer_id].weights, COLS)) for d in own])
        y = p > 0.5
        if y.all() or not y.any():
            assert r.measure == "r2" and np.isclose(r.fidelity, max(0.0, 1 - ((p - s) ** 2).sum() / (p.var() * len(p) + 1e-9)))
        else:
            assert r.measure == "auc" and np.isclose(r.fidelity, np.mean((s[y][:, None] > s[~y]) + 0.5 * (s[y][:, None] == s[~y])))
    plan = sur._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan  # no neighbour is made by thousands of column operations


def test_area_counts_ties_half():
    assert NB.area(np.array([1.0, 0, 1, 0]), np.array([2.0, 2, 3, 1])) == 3.5 / 4 and NB.area(np.ones(3), np.arange(3)) is None


def _customers(spark):
    """Inputs of a scorecard, with missing ones and a key that comes twice."""
    names = [c for c, _ in MD.LOGIT_WEIGHTS] + ["usage_30d", "usage_90d"]
    rng = np.random.default_rng(3)
    rows = [(i, [None, "Month-to-Month", "One Year", "Two Year"][i % 4], *(None if (i + j) % 11 == 0 else float(v) for j, v in enumerate(rng.normal(5, 3, len(names))))) for i in range(12)]
    df = spark.createDataFrame([*rows, (5, "Two Year", *([2.0] * len(names)))], f"customer_id long, contract_type string, {', '.join(f'{c} double' for c in names)}")
    return df, names, MD.Scorecard.fit(df)


def test_scorecard_scores_where_neighbours_are_drawn(spark):
    """Same weights as by rows handed to the score function, and no neighbour leaves the task that draws it."""
    df, names, sc = _customers(spark)
    by_rows, drawn = (X.surrogate_local(df, names, f, n=1203) for f in (lambda d: sc(d), sc))
    got, want = ({r.customer_id: [r.intercept, *r.weights, r.local_pred] for r in d.collect()} for d in (drawn, by_rows))
    assert sorted(got) == list(range(12)) and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in got)
    steps = [p.queryExecution().optimizedPlan().toString().count("MapInArrow") for p in (by_rows._jdf, drawn._jdf)]
    assert steps == [2, 1]


def test_scorecard_fidelity_equals_that_by_rows(spark):
    """Both measures, keys that come twice, and no neighbour handed on as a row."""
    df, names, sc = _customers(spark)
    sc.intercept -= 2.0
    sur = X.surrogate_local(df, names, sc, n=300)
    by_rows, drawn = (X.surrogate_fidelity(df, sur, names, f, n=120) for f in (lambda d: sc(d), sc))
    got, want = ({r.customer_id: (r.measure, r.fidelity) for r in d.collect()} for d in (drawn, by_rows))
    assert sorted(got) == list(range(12)) and {m for m, _ in got.values()} == {"auc", "r2"}
    assert all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1], rtol=1e-9, atol=1e-9) for k in got)
    steps = [d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for d in (by_rows, drawn)]
    assert steps[0] - steps[1] == 1
