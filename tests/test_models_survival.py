"""Scoring guard, STL, Cox PH and concordance against independent numpy computations, LSH recall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlab.operators import models as MD
from churnlab.operators import search as SE
from churnlab.operators import survival as SV
from churnlab.sources.tables import customer360, table


def test_score_guard_fails_closed(spark, sf):
    d = customer360(spark, sf)
    with pytest.raises(ValueError):
        MD.score_guard(d.drop("nps_score"), ["nps_score"])
    with pytest.raises(ValueError):
        MD.score_guard(d.withColumn("nps_score", F.col("nps_score").cast("string")), ["nps_score"], {"nps_score": "double"})


def test_stl_reconstructs_and_finds_season(spark):
    months = [f"{2000 + i // 12}-{i % 12 + 1:02d}" for i in range(60)]
    vals = [0.01 * i + math.sin(2 * math.pi * i / 12) for i in range(60)]
    df = spark.createDataFrame([("s", m, v) for m, v in zip(months, vals)], "series_key string, month string, value double")
    r = SV.stl_decompose(df, "series_key").toPandas()
    assert np.allclose(r.trend + r.seasonal + r.residual, r.value)
    assert r.seasonal_strength.iloc[0] > 0.9


def _efron_ll(T, E, X, b, pen):
    xb = X @ b
    r = np.exp(xb)
    ll = 0.0
    for t in np.unique(T[E == 1]):
        risk, dead = T >= t, (T == t) & (E == 1)
        d = dead.sum()
        ll += xb[dead].sum() - sum(np.log(r[risk].sum() - k / d * r[dead].sum()) for k in range(d))
    return ll - 0.5 * pen * b @ b


def test_cox_optimum_matches_numpy_likelihood(spark):
    d = customer360(spark, "/root/testdata/sf0.01")
    cov = ["monthly_charges", "nps_score", "age"]
    res = SV.cox_ph(d, "tenure_months", "churned", cov).collect()
    pdf = d.select("tenure_months", "churned", *cov).toPandas().dropna()
    X = pdf[cov].to_numpy()
    Xs = (X - X.mean(0)) / X.std(0, ddof=1)
    b = np.array([r.coef for r in res]) * X.std(0, ddof=1)
    T, E = pdf.tenure_months.to_numpy(), pdf.churned.to_numpy()
    grad = [(_efron_ll(T, E, Xs, b + 1e-5 * np.eye(3)[j], 0.1) - _efron_ll(T, E, Xs, b - 1e-5 * np.eye(3)[j], 0.1)) / 2e-5 for j in range(3)]
    assert np.max(np.abs(grad)) < 1e-3
    assert res[0].log_likelihood == pytest.approx(_efron_ll(T, E, Xs, b, 0.1), rel=1e-6)


def test_concordance_matches_brute_force(spark, sf):
    d = customer360(spark, sf).withColumn("risk", F.col("monthly_charges") - F.col("nps_score"))
    c = SV.cox_concordance(d, "tenure_months", "churned", "risk").first()["concordance"]
    pdf = d.select("tenure_months", "churned", "risk").toPandas().dropna()
    T, E, R = pdf.tenure_months.to_numpy(), pdf.churned.to_numpy(), pdf.risk.to_numpy()
    num = den = 0.0
    for i in np.where(E == 1)[0]:
        m = T > T[i]
        den += m.sum()
        num += (R[i] > R[m]).sum() + 0.5 * (R[i] == R[m]).sum()
    assert c == pytest.approx(num / den, abs=1e-9)


def test_lsh_recall_against_exact(spark, sf):
    """The registered parameters, ordinary vectors as queries: k rows each, recall, a small share of candidates."""
    e = table(spark, sf, "embeddings")
    q = e.filter(F.col("vec_id") % 5 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in SE.knn_cosine(q, e, 10).collect()}
    rows = SE.knn_lsh(q, e, 10).collect()
    approx = {(r.query_id, r.vec_id) for r in rows}
    assert len(rows) == 10 * q.count() and len(exact & approx) / len(exact) >= 0.95


def test_knn_any_number_of_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, SE.knn_cosine(q, e, 3).collect()))
    assert whole == sorted(map(tuple, SE.knn_cosine(q, e, 3, block=60).collect()))


def test_concordance_exact_with_many_times_and_risks(spark):
    rng = np.random.default_rng(4)
    t, r, e = rng.permutation(3000) / 7.0, rng.integers(0, 1500, 3000) / 3.0, rng.random(3000) < 0.6
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r, strict=True)], "t double, e int, r double")
    got = SV.cox_concordance(df, "t", "e", "r").first()
    later = t[None, :] > t[e][:, None]
    con, tie = (later & (r[None, :] < r[e][:, None])).sum(), (later & (r[None, :] == r[e][:, None])).sum()
    assert (got.concordant, got.tied_risk, got.comparable) == (con, tie, later.sum())


def test_fitted_model_saved_loaded_scored_and_explained(spark, sf):
    from churnlab.operators import models as MD
    from churnlab.plans import q_models as Q

    prep, model = Q.fitted(spark, sf)
    d = Q.c360(spark, sf)
    p = {r.customer_id: r.p for r in MD.ml_score_fn(prep, model)(d).select("customer_id", "p").collect()}
    rows = MD.explain_fitted(prep, model)(d).select("customer_id", F.aggregate("attrib", F.lit(0.0), lambda s, x: s + x["value"]).alias("s")).collect()
    logit = {k: math.log(v / (1 - v)) for k, v in p.items() if 1e-9 < v < 1 - 1e-9}
    shift = {round(logit[r.customer_id] - r.s, 5) for r in rows if r.customer_id in logit}
    assert len(p) == d.count() and len(shift) == 1  # contributions add up to the score minus the mean score


def test_counterfactuals(spark, sf):
    from churnlab.operators import explain as X
    from churnlab.plans import q_models as Q

    d, sc, found = Q._cf_found(spark, sf)
    rows = found.collect()
    p0 = {r.customer_id: r.p for r in sc(d).select("customer_id", "p").collect()}
    per = {}
    for r in rows:
        assert r.new_churn_prob < 0.5 <= p0[r.customer_id] and r.changed
        per[r.customer_id] = per.get(r.customer_id, 0) + 1
    assert max(per.values()) <= 10
    base = {r.customer_id: r.monthly_charges for r in d.select("customer_id", "monthly_charges").collect()}
    cost = X.cf_cost(found, sc(d.drop("churn_probability")).withColumnRenamed("p", "churn_probability")).collect()
    new = {(r.customer_id, r.cand): r for r in rows}
    assert any(c.price_cut > 0 for c in cost)
    for c in cost:
        r = new[c.customer_id, c.cand]
        cut = (base[c.customer_id] - r.monthly_charges) / max(base[c.customer_id], 1.0) if "monthly_charges" in r.changed else 0.0
        assert c.churn_prob_reduction >= 0 and c.new_churn_prob >= 0.05
        assert ("Reduce monthly price by" in c.actions) == (0 < cut <= 0.30)


def test_rank_correlation_positional(spark):
    from churnlab.operators.explain import rank_correlation

    cases = [(["a", "b", "c"], ["a", "b", "c"], 1.0), (["a", "b"], ["c", "d"], 0.0), (["a", "b", "c"], ["c", "b", "a"], -1.0), (["a", "x"], ["a", "y"], 1.0)]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>, want double")
    assert all(abs(r.got - r.want) < 1e-6 for r in df.select("want", rank_correlation(F.col("a"), F.col("b")).alias("got")).collect())


def test_registered_boosting_is_not_cut(spark, sf, monkeypatch):
    """Rounds, trials and folds that the registered queries ask for (models of three rounds stand in for the full ones)."""
    from dataclasses import replace

    from churnlab.plans import q_models as Q

    asked, fit_many = [], MD.fit_many

    def short(m, jobs, *args, **given):
        asked.extend(jobs)
        return fit_many(m, [(replace(p, rounds=3), f) for p, f in jobs], *args, **given)

    monkeypatch.setattr(MD, "fit_many", short)
    Q.q_boosted(spark, sf)
    assert [(p.rounds, p.leaves) for p, _ in asked] == [(300, None), (300, 63)]
    asked.clear()
    assert all(p.rounds == 200 for n, p in Q._learners().items() if n != "random_forest")
    Q.q_train_all(spark, sf)
    assert [p.rounds for p, _ in asked] == [300, 300]
    asked.clear()
    rows = Q.q_tune(spark, sf).collect()
    assert len(rows) == 30 and len(asked) == 150 and {f for _, f in asked} == set(range(5))
    assert len({p.rounds for p, _ in asked}) > 20 and min(p.rounds for p, _ in asked) >= 100


def test_tie_sums_against_addition(spark):
    from churnlab.operators.survival import tie_sums

    cases = [(c, d) for d in (1.0, 2.0, 31.0, 32.0, 33.0, 500.0, 20_000.0) for c in (d, d + 0.25, 3 * d + 0.7, 1e6 + d, 1e12)]
    df = spark.createDataFrame(cases, "c double, d double")
    for r in df.select("c", "d", *tie_sums(F.col("c"), F.col("d"))).collect():
        x = r["c"] - np.arange(int(r["d"]), dtype="float64")
        for got, want in ((r["h0"], math.fsum(np.log(x))), (r["h1"], math.fsum(1 / x)), (r["h2"], math.fsum(1 / x**2))):
            assert abs(got - want) <= 1e-12 * abs(want) + 1e-300, (r, want)


def test_cox_with_a_million_tied_deaths(spark):
    """1.2 million deaths at two times: likelihood, gradient and second derivative as by addition over the ties."""
    from churnlab.operators.survival import _cox_pass

    d = spark.range(1_500_000).select((F.col("id") % 2 + 1).cast("double").alias("t"), (F.col("id") % 5 != 0).cast("double").alias("e"),
                                      (F.col("id") % 3).cast("double").alias("x0"))
    ll, g, h = _cox_pass(d, 1, np.array([0.3]))
    i = np.arange(1_500_000)
    t, e, x = i % 2 + 1, i % 5 != 0, (i % 3).astype("float64")
    r = np.exp(0.3 * x)
    want = [0.3 * x[e].sum(), x[e].sum(), 0.0]
    for time in (1, 2):
        risk, dead = t >= time, e & (t == time)
        fr = np.arange(dead.sum()) / dead.sum()
        s = [(r[risk] * x[risk] ** k).sum() - fr * (r[dead] * x[dead] ** k).sum() for k in range(3)]
        want[0] -= np.log(s[0]).sum()
        want[1] -= (s[1] / s[0]).sum()
        want[2] -= (s[2] / s[0] - (s[1] / s[0]) ** 2).sum()
    np.testing.assert_allclose([ll, g[0], h[0, 0]], want, rtol=1e-9, atol=1e-3)
