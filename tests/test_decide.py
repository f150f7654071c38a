"""Budget greedy, knapsack and allocation: hand-worked cases and invariants."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from churnlab.operators import decide as D
from churnlab.operators.prefix import ordered_buckets


def test_greedy_skip_and_continue(spark):
    items = spark.createDataFrame([(1, "a", 60.0, 120.0), (2, "b", 50.0, 75.0), (3, "c", 40.0, 56.0)],
                                  "customer_id int, action string, cost double, value double")
    got = sorted(r.action for r in D.budget_greedy(items, 100.0).collect())
    assert got == ["a", "c"]


def _greedy_python(rows, budget):
    ranked = sorted(rows, key=lambda r: (-(r[3] / r[2]), r[2], r[0], r[1]))
    left, out = budget, []
    for r in ranked:
        if r[2] <= left:
            out.append((r[0], r[1]))
            left -= r[2]
    return sorted(out)


def test_greedy_matches_sequential_rule(spark):
    rnd = random.Random(5)
    rows = [(i, f"x{j}", float(rnd.choice([20, 40, 60, 80, 150])), float(rnd.randint(1, 300))) for i in range(300) for j in range(3)]
    items = spark.createDataFrame(rows, "customer_id int, action string, cost double, value double")
    for budget in (500.0, 5000.0, 20000.0):
        got = sorted((r.customer_id, r.action) for r in D.budget_greedy(items, budget).collect())
        assert got == _greedy_python(rows, budget)


def test_greedy_many_alternating_misfits(spark):
    """Every other item is too dear: 200 skips, none of which may end the walk."""
    rows = [(i, "x", 1.0 if i % 2 else 1000.0, (1000.0 - i) * (1.0 if i % 2 else 1000.0)) for i in range(400)]
    items = spark.createDataFrame(rows, "customer_id int, action string, cost double, value double")
    got = sorted((r.customer_id, r.action) for r in D.budget_greedy(items, 250.0, bucket_rows=50).collect())
    assert got == _greedy_python(rows, 250.0) and len(got) == 200


def test_greedy_and_frontier_one_density_holds_a_third(spark):
    rnd = random.Random(8)
    rows = [(i, "x", float(c := rnd.choice([10, 20, 40])), c * 3.0 if i % 3 == 0 else float(rnd.randint(1, 200))) for i in range(1500)]
    items = spark.createDataFrame(rows, "customer_id int, action string, cost double, value double")
    got = sorted((r.customer_id, r.action) for r in D.budget_greedy(items, 9000.0).collect())
    assert got == _greedy_python(rows, 9000.0)
    ranked, total, spend = sorted(rows, key=lambda r: (-(r[3] / r[2]), r[2], r[0], r[1])), 0.0, 0.0
    for r in ranked:
        total += r[2]
        spend = total if total <= 5000.0 else spend
    assert D.budget_frontier(items, [5000.0]).first()["spend"] == spend
    buckets = ordered_buckets(items.withColumn("density", F.col("value") / F.col("cost")), [F.col("density").desc(), F.col("cost"), F.col("customer_id")], 16)
    assert buckets.groupBy("_b").count().agg(F.max("count")).first()[0] < len(rows) / 6


def test_knapsack_is_optimal_both_ways(spark):
    cat = D.catalogue_df(spark)
    cust = spark.createDataFrame([(1, 100.0, 0.9), (2, 3.0, 0.5), (3, 400.0, 0.7)], "customer_id int, clv double, churn_probability double")
    items = D.build_items(D.cross_catalogue(cust, cat), "clv", "prob_reduction")
    grouped = {r.customer_id: (r.total_value, r.subset, r.actions) for r in D.knapsack_per_customer(items, 300.0).collect()}
    in_row = D.with_knapsack(cust, D.CATALOGUE_A, F.col("clv"), 300.0)
    assert "Exchange" not in in_row._jdf.queryExecution().executedPlan().toString()
    rows = items.collect()
    for r in in_row.select("customer_id", "plan.*").collect():
        its = [(x.cost, x.value) for x in rows if x.customer_id == r.customer_id]
        brute = max(sum(v for _, v in s) for k in range(1, len(its) + 1) for s in itertools.combinations(its, k) if sum(c for c, _ in s) <= 300)
        assert r.total_value == pytest.approx(brute)
        assert grouped[r.customer_id] == (pytest.approx(brute), r.subset, r.actions)


def test_knapsack_long_catalogue(spark):
    """Sixteen actions: more than subset enumeration would list."""
    rnd = random.Random(3)
    rows = [(c, i, f"a{i}", float(rnd.randint(5, 90)), float(rnd.randint(1, 100)), 0.01) for c in range(3) for i in range(16)]
    items = spark.createDataFrame(rows, "customer_id int, action_idx int, action string, cost double, value double, prob_reduction double")
    got = {r.customer_id: r.total_value for r in D.knapsack_per_customer(items, 150.0, carry=()).collect()}
    for c in range(3):
        best = {0: 0.0}
        for _, _, _, cost, value, _ in (r for r in rows if r[0] == c):
            for k, v in list(best.items()):
                if k + cost <= 150 and best.get(k + cost, -1) < v + value:
                    best[k + cost] = v + value
        assert got[c] == max(best.values())


def test_allocate_caps_per_customer(spark):
    rows = [(i, f"x{j}", 20.0 + j, 100.0 - j) for i in range(20) for j in range(4)]
    items = spark.createDataFrame(rows, "customer_id int, action string, cost double, value double")
    got = D.budget_allocate(items, 10000.0, per_customer=2)
    assert got.groupBy("customer_id").count().agg(F.max("count")).first()[0] == 2
