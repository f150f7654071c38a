"""Attribution efficiency and counterfactual invariants on the scorecard."""

import inspect

import pytest
from pyspark.sql import functions as F

from churnlab.operators import explain as X
from churnlab.operators import frames as FR
from churnlab.operators import models as MD
from churnlab.plans.q_ml import sc_terms
from churnlab.sources.tables import customer360

COLS = [c for c, _ in MD.LOGIT_WEIGHTS] + ["usage_30d", "usage_90d"]


def test_linear_attribution_sums_to_logit_gap(spark, sf):
    d = customer360(spark, sf)
    sc = MD.Scorecard.fit(d)
    att = X.attrib_linear(d, sc_terms(sc)).groupBy("customer_id").agg(F.sum("value").alias("s"))
    lg = d.select("customer_id", sc.logit().alias("z"))
    mean = lg.agg(F.avg("z")).first()[0]
    for r in att.join(lg, "customer_id").collect():
        assert r.s == pytest.approx(r.z - mean, abs=1e-9)


def test_sampled_attribution_efficiency(spark, sf):
    d = customer360(spark, sf).select("customer_id", "contract_type", *COLS)
    sc = MD.Scorecard.fit(customer360(spark, sf))
    bg = FR.sample_n(d, "customer_id", 1, seed=3)  # one background row: permutation values sum exactly
    att = X.attrib_sampled(d, bg.select(*COLS), COLS, sc, perms=4).groupBy("customer_id").agg(F.sum("value").alias("s"))
    p = sc(d).select("customer_id", "p")
    pb = sc(bg.select("contract_type", *COLS).limit(1).crossJoin(d.select("customer_id", F.col("contract_type").alias("ct")))
            .drop("contract_type").withColumnRenamed("ct", "contract_type")).select("customer_id", F.col("p").alias("pb"))
    for r in att.join(p, "customer_id").join(pb, "customer_id").collect():
        assert r.s == pytest.approx(r.p - r.pb, abs=1e-9)


def test_cf_rules_only_meaningful_drops(spark, sf):
    d = customer360(spark, sf)
    sc = MD.Scorecard.fit(d)
    cf = X.cf_rules(d, sc)
    assert cf.filter(F.col("prob_reduction") <= 0.02 - 1e-4).count() == 0
    ranked = X.cf_rank_feasibility(cf, k=5)
    assert ranked.groupBy("customer_id").count().agg(F.max("count")).first()[0] <= 5


def test_registered_explanations_use_the_whole_data(spark, sf, monkeypatch):
    """Donors, neighbours and permutations that the registered queries ask for."""
    from churnlab.operators import explain as X
    from churnlab.plans import q_models as Q

    class Asked(Exception):
        pass

    def asked(name, query):
        seen = {}

        def spy(*a, **given):
            seen.update(inspect.signature(real).bind(*a, **given).arguments)
            raise Asked

        real = getattr(X, name)
        with monkeypatch.context() as m, pytest.raises(Asked):
            m.setattr(X, name, spy)
            query(spark, sf)
        return seen

    customers = Q.c360(spark, sf)
    for query in (Q.q_cf_search, Q.q_cf_cost):
        assert asked("cf_search", query)["donors"].count() == customers.count()
    for query in (Q.q_surrogate, Q.q_fidelity, Q.q_bench, Q.q_bench_rows):
        assert asked("surrogate_local", query)["n"] == 5000
    for query in (Q.q_attr_sampled, Q.q_agreement):
        assert asked("attrib_sampled", query).get("perms", 16) == 16


def test_searched_counterfactuals_send_no_customers_through_the_driver(spark, monkeypatch):
    """Small files of many rows are no broadcast: donors and customers are joined by sorting."""
    rows = [(i, float(i % 7), "a" if i % 2 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "customer_id long, v double, c string")
    plans, cut = [], X.cut_lineage
    monkeypatch.setattr(X, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().toString()) or cut(d))
    found = X.cf_search(df, df, ["v", "c"], lambda d: d.withColumn("p", F.when(F.col("v") > 2, 0.9).otherwise(0.1)), n=2)
    assert found.count() > 0 and any("SortMergeJoin [_did" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin [_did" in p or "BroadcastHashJoin [customer_id" in p]
