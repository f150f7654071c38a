"""Retention decisions: action catalogue, per-customer knapsack, portfolio budget greedy.

* ``with_knapsack`` finds the exact best subset of a small catalogue inside the
  row (no shuffle); ``knapsack_per_customer`` solves items that differ by
  customer, any catalogue length, one customer's items at a time.
* ``budget_greedy`` reproduces the sequential "take it if it still fits" rule
  over all (customer, action) items.  Items lie in range buckets of the whole
  order (density, cost, keys).  A bucket whose costs all fit is taken whole, one
  whose cheapest item does not fit is skipped whole (both from the bucket sums
  alone); only a bucket in between is walked item by item, each at most once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlab.functions.features import ab_assign, action_type, risk_tier
from churnlab.operators.prefix import default_buckets, ordered_buckets, prefix_sum
from churnlab.session import cut_lineage

# Portfolio action catalogue (name, cost in USD, churn-probability reduction).
CATALOGUE_A = [
    ("discount_10pct", 20.0, 0.08),
    ("discount_20pct", 40.0, 0.15),
    ("csm_outreach", 80.0, 0.12),
    ("loyalty_upgrade", 60.0, 0.10),
    ("dedicated_csm", 150.0, 0.20),
]


def catalogue_df(spark: SparkSession, rows=CATALOGUE_A) -> DataFrame:
    return spark.createDataFrame([(i, n, c, r) for i, (n, c, r) in enumerate(rows)],
                                 "action_idx int, action string, cost double, prob_reduction double")


def cross_catalogue(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every customer x every action; the catalogue is a fixed small table, broadcast."""
    return df.crossJoin(F.broadcast(catalogue))


def build_items(df: DataFrame, clv: str = "clv", dp: str = "prob_reduction") -> DataFrame:
    """value = round(clv * reduction, 2), at least 1."""
    return df.withColumn("value", F.greatest(F.round(F.col(clv) * F.col(dp), 2), F.lit(1.0)))


def plan_roi(value, cost, floor: float = 1e-9):
    return (F.col(value) - F.col(cost)) / F.greatest(F.col(cost), F.lit(floor)) if isinstance(value, str) else \
        (value - cost) / F.greatest(cost, F.lit(floor))


def plan_confidence(p, total_reduction, n_actions):
    """min(1 - max(p - sum of reductions, 0.05), 0.99), 4 dp; 0 without actions."""
    remaining = F.greatest(p - total_reduction, F.lit(0.05))
    return F.when(n_actions > 0, F.bround(F.least(1.0 - remaining, F.lit(0.99)), 4)).otherwise(F.lit(0.0))


def subsets_df(spark: SparkSession, catalogue: DataFrame) -> DataFrame:
    """(subset, action_idx) membership rows for all non-empty subsets of a catalogue: 2^n rows for n actions."""
    n = catalogue.count()
    s = spark.range(1, 2 ** n).select(F.col("id").alias("subset"))
    idx = spark.range(n).select(F.col("id").cast("int").alias("action_idx"))
    return s.crossJoin(idx).filter(F.expr("(subset >> action_idx) & 1 = 1"))


def with_knapsack(df: DataFrame, actions: list[tuple[str, float, float]], clv, budget: float = 300.0, out: str = "plan") -> DataFrame:
    """Add ``out``: the best subset of a small catalogue for each row, found in the row (no shuffle, no join).

    struct(subset, total_cost, total_value, total_reduction, n_actions, actions); null where nothing fits the budget.
    Subsets over the budget depend on the catalogue only and are left out of the list beforehand.
    Best: value desc, cost asc, subset asc.  ``clv``: column of the customer value an action's reduction acts on."""
    n, plans = len(actions), []
    for subset in range(1, 2 ** n):
        own = [i for i in range(n) if subset >> i & 1]
        cost = sum(actions[i][1] for i in own)
        if cost <= budget:
            plans.append((subset, float(cost), float(sum(actions[i][2] for i in own)), own))
    if not plans:
        return df.withColumn(out, F.lit(None).cast("struct<subset:bigint,total_cost:double,total_value:double,total_reduction:double,n_actions:bigint,actions:array<string>>"))
    vals = [f"_v{i}" for i in range(n)]
    d = df
    for v, (_, _, cut) in zip(vals, actions, strict=True):
        d = d.withColumn(v, F.greatest(F.round(clv * F.lit(float(cut)), 2), F.lit(1.0)))
    values = F.array(*vals)
    table = F.array(*[F.struct(F.lit(c).alias("cost"), F.lit(s).cast("long").alias("subset"), F.lit(r).alias("cut"),
                               F.array(*[F.lit(i) for i in own]).alias("own")) for s, c, r, own in plans])
    scored = F.transform(table, lambda t: F.struct(
        F.aggregate(t["own"], F.lit(0.0), lambda a, i: a + F.get(values, i)).alias("v"), (-t["cost"]).alias("c"), (-t["subset"]).alias("s"),
        t["cut"].alias("r"), t["own"].alias("own")))
    names = F.array(*[F.lit(a) for a, _, _ in actions])
    best = F.array_max(scored)
    d = d.withColumn("_best", best)
    b = F.col("_best")
    return d.withColumn(out, F.struct((-b["s"]).alias("subset"), (-b["c"]).alias("total_cost"), b["v"].alias("total_value"), b["r"].alias("total_reduction"),
                                      F.size(b["own"]).cast("long").alias("n_actions"),
                                      F.array_sort(F.transform(b["own"], lambda i: F.get(names, i))).alias("actions"))).drop("_best", *vals)


def knapsack_per_customer(items: DataFrame, budget: float = 300.0, key: str = "customer_id", carry=("churn_probability",), grain: int = 100) -> DataFrame:
    """Best subset of each customer's own action rows with total cost <= budget (value desc, cost asc, subset asc).

    For catalogues of any size and items that differ by customer: a customer's items are one group (as long as the
    catalogue), solved exactly by dynamic programming over cost in units of 1 / ``grain``."""
    keep = [c for c in carry if c in items.columns]
    agg = items.groupBy(key).agg(*[F.max(c).alias(c) for c in keep], F.array_sort(F.collect_list(
        F.struct("action_idx", "action", "cost", "value", "prob_reduction"))).alias("items"))
    out = ", ".join([f"{key} {items.schema[key].dataType.simpleString()}", *[f"{c} {items.schema[c].dataType.simpleString()}" for c in keep]])
    out += ", subset long, total_cost double, total_value double, total_reduction double, n_actions long, actions array<string>"

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                best = _best_subset([(int(x["action_idx"]), float(x["cost"]), float(x["value"])) for x in r.items], budget, grain)
                if best:
                    own = [x for x in r.items if x["action_idx"] in best]
                    rows.append((*[getattr(r, c) for c in [key, *keep]], sum(1 << i for i in best), sum(x["cost"] for x in own), sum(x["value"] for x in own),
                                 sum(x["prob_reduction"] for x in own), len(own), sorted(x["action"] for x in own)))
            yield pd.DataFrame(rows, columns=[key, *keep, "subset", "total_cost", "total_value", "total_reduction", "n_actions", "actions"])

    return agg.mapInPandas(solve, out)


def _best_subset(items: list[tuple[int, float, float]], budget: float, grain: int) -> list[int]:
    """Action indices of the best non-empty subset; states with equal cost keep the best (value, then subset)."""
    states = {0: (0.0, 0)}
    for i, cost, value in items:
        step = round(cost * grain)
        for c, (v, mask) in list(states.items()):
            if c + step <= round(budget * grain):
                new, old = (v + value, mask | 1 << i), states.get(c + step)
                if old is None or (new[0], -new[1]) > (old[0], -old[1]):
                    states[c + step] = new
    won = max(((v, -c, -m) for c, (v, m) in states.items() if m), default=None)
    return [i for i, _, _ in items if won and -won[2] >> i & 1]


def _order_cols(key_cols):
    return [F.col("cost").asc()] + [F.col(k).asc() for k in key_cols]


def _walk(start: float, key_cols: list[str]):
    """Takes a bucket's items one after another while they fit what is left of the budget."""
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["density", "cost", *key_cols], ascending=[False, True, *[True] * len(key_cols)], kind="stable")
        have, keep = start, []
        for c in pdf["cost"]:
            keep.append(c <= have)
            have -= c if keep[-1] else 0.0
        return pdf[keep]
    return walk


def budget_greedy(items: DataFrame, budget: float, key_cols=("customer_id", "action"), bucket_rows: int = 500_000) -> DataFrame:
    """Items taken by the greedy value-density rule (density desc, then cost asc, then keys).

    No limit on the number of items taken or skipped.  The driver holds one (sum, least, count) per bucket; a walked
    bucket is one task of about ``bucket_rows`` rows, and its choice is written before the next is looked at."""
    key_cols = list(key_cols)
    it = items.select(*key_cols, "cost", "value").withColumn("density", F.col("value") / F.greatest(F.col("cost"), F.lit(1e-9)))
    order = [F.col("density").desc(), *_order_cols(key_cols)]
    spark = it.sparkSession
    n = max(default_buckets(spark), -(-it.count() // bucket_rows))
    it = ordered_buckets(it, order, n)
    stats = it.groupBy("_b").agg(F.sum("cost").alias("total"), F.min("cost").alias("least")).orderBy("_b").collect()  # n rows
    walk_schema = it.schema
    left, whole, parts = float(budget), [], []
    for s in stats:
        if s["least"] >= 0 and s["total"] <= left:
            whole.append(s["_b"])
            left -= s["total"]
        elif s["least"] <= left:
            part = cut_lineage(it.filter(F.col("_b") == s["_b"]).groupBy("_b").applyInPandas(_walk(left, key_cols), walk_schema))
            parts.append(part)
            left -= float(part.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0])
    out = it.filter(F.col("_b").isin(whole)) if whole else it.limit(0)
    for p in parts:
        out = out.unionByName(p)
    return out.drop("_b")


def budget_allocate(items: DataFrame, budget: float, per_customer: int = 2, cap_first: bool = False,
                    key: str = "customer_id", action: str = "action") -> DataFrame:
    """Greedy pick then at most ``per_customer`` actions per customer in density order; freed money
    is not spent again.  ``cap_first`` applies the per-customer cap before the budget instead."""
    def cap(df):
        d = df.withColumn("density", F.col("value") / F.greatest(F.col("cost"), F.lit(1e-9)))
        w = Window.partitionBy(key).orderBy(F.col("density").desc(), F.col("cost").asc(), F.col(action).asc())
        return d.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= per_customer).drop("_rk", "density")
    if cap_first:
        return budget_greedy(cap(items), budget, (key, action))
    return cap(budget_greedy(items, budget, (key, action)))


def budget_frontier(items: DataFrame, budgets: list[float], key_cols=("customer_id", "action")) -> DataFrame:
    """Spend and value of the longest density-ordered prefix that fits each budget (no refill)."""
    key_cols = list(key_cols)
    spark = items.sparkSession
    it = items.select(*key_cols, "cost", "value").withColumn("density", F.col("value") / F.greatest(F.col("cost"), F.lit(1e-9)))
    cum = prefix_sum(it, "density", ["cost", "value"], descending=True, tiebreak=_order_cols(key_cols))
    b = spark.createDataFrame([(float(x),) for x in budgets], "budget double")
    j = cum.join(F.broadcast(b), F.col("cum_cost") <= F.col("budget"))  # budgets: a short parameter list
    g = j.groupBy("budget").agg(F.sum("cost").alias("spend"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_items"))
    return b.join(g, "budget", "left").select("budget", F.coalesce("spend", F.lit(0.0)).alias("spend"),
                                              F.coalesce("value", F.lit(0.0)).alias("value"),
                                              F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"))


def action_log(plans: DataFrame, experiment: str = "retention_v1", key: str = "customer_id") -> DataFrame:
    """One record per customer: best single action, CRM type, cost, arm and status (CRITICAL waits for approval)."""
    w = Window.partitionBy(key).orderBy(F.col("value").desc(), F.col("cost").asc(), F.col("action").asc())
    best = plans.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")
    arm = ab_assign(F.col(key), experiment)
    tier = risk_tier(F.col("churn_probability"))
    return best.select(
        key, "action", action_type(F.replace(F.col("action"), F.lit("_"), F.lit(" "))).alias("action_type"),
        F.round("cost", 2).alias("estimated_cost_usd"), arm.alias("ab_group"), tier.alias("risk_tier"),
        F.when(tier == "CRITICAL", "pending_approval").when(arm == "treatment", "scheduled").otherwise("control_holdout").alias("status"))


def action_history(log: DataFrame, key: str = "customer_id") -> DataFrame:
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("n_actions"), F.sum("cost").alias("total_cost"),
                                F.array_join(F.array_sort(F.collect_list("action")), ",").alias("actions"))
