"""Section 2.11 / 2.4 catalogue joins: items, knapsack, budget greedy, allocation, frontier, plan fields."""

from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators import decide as D
from churnlab.plans.oracle import rnd, with_c360
from churnlab.plans.registry import out, register
from churnlab.sources.tables import customer360_table as customer360

BUDGET = 50000.0
FRONTIER = [10000.0, 25000.0, 50000.0, 100000.0, 200000.0]


def c360(spark, sf):
    return customer360(spark, sf)


def items(spark, sf):
    d = c360(spark, sf).select("customer_id", "churn_probability", "monthly_charges",
                               fx.clv_24m(None, "monthly_charges").alias("clv"))
    return D.build_items(D.cross_catalogue(d, D.catalogue_df(spark)), "clv", "prob_reduction")


CAT_SQL = """cat AS (SELECT * FROM (VALUES (0, 'discount_10pct', 20e0, 0.08e0), (1, 'discount_20pct', 40e0, 0.15e0),
  (2, 'csm_outreach', 80e0, 0.12e0), (3, 'loyalty_upgrade', 60e0, 0.10e0), (4, 'dedicated_csm', 150e0, 0.20e0))
  AS v(action_idx, action, cost, prob_reduction))"""
ITEMS_SQL = """it AS (SELECT c.customer_id, c.churn_probability, c.monthly_charges, COALESCE(c.monthly_charges, 80e0) * 24e0 AS clv,
  cat.action_idx, cat.action, cat.cost, cat.prob_reduction,
  GREATEST(ROUND(COALESCE(c.monthly_charges, 80e0) * 24e0 * cat.prob_reduction, 2), 1e0) AS value FROM c360 AS c CROSS JOIN cat)"""


@register("cross_catalogue", rnd(with_c360(
    "SELECT customer_id, action, cost, prob_reduction, clv FROM it", CAT_SQL, ITEMS_SQL), "cost,prob_reduction,clv"))
def q_cross(spark, sf):
    return out(items(spark, sf).select("customer_id", "action", "cost", "prob_reduction", "clv"))


@register("build_items", rnd(with_c360("SELECT customer_id, action, cost, value FROM it", CAT_SQL, ITEMS_SQL), "cost,value"))
def q_items(spark, sf):
    return out(items(spark, sf).select("customer_id", "action", "cost", "value"))


KS_SQL = """mem AS (SELECT s.subset, i.action_idx FROM (SELECT CAST(UNNEST(range(1, 32)) AS INTEGER) AS subset) AS s
  CROSS JOIN (SELECT CAST(UNNEST(range(0, 5)) AS INTEGER) AS action_idx) AS i WHERE (s.subset >> i.action_idx) & 1 = 1)""", \
    """ks AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY total_value DESC, total_cost ASC, subset ASC) AS rk
  FROM (SELECT it.customer_id, MAX(it.churn_probability) AS churn_probability, mem.subset, SUM(it.cost) AS total_cost, SUM(it.value) AS total_value,
    SUM(it.prob_reduction) AS total_reduction, COUNT(*) AS n_actions, array_to_string(list_sort(list(it.action)), ',') AS actions
    FROM it JOIN mem ON it.action_idx = mem.action_idx GROUP BY it.customer_id, mem.subset) AS a WHERE total_cost <= 300) AS b WHERE rk = 1)"""


def knap(spark, sf):
    d = c360(spark, sf).select("customer_id", "churn_probability", fx.clv_24m(None, "monthly_charges").alias("clv"))
    return D.with_knapsack(d, D.CATALOGUE_A, F.col("clv"), 300.0).filter("plan IS NOT NULL").select("customer_id", "churn_probability", "plan.*")


@register("knapsack_per_customer", rnd(with_c360(
    "SELECT customer_id, subset, total_cost, total_value, total_reduction, n_actions, actions FROM ks", CAT_SQL, ITEMS_SQL, *KS_SQL),
    "total_cost,total_value,total_reduction"), headline=True)
def q_knap(spark, sf):
    k = knap(spark, sf)
    return out(k.select("customer_id", "subset", "total_cost", "total_value", "total_reduction", "n_actions",
                        F.array_join("actions", ",").alias("actions")))


@register("plan_roi", rnd(with_c360(
    "SELECT customer_id, (total_value - total_cost) / GREATEST(total_cost, 1e0) AS roi FROM ks", CAT_SQL, ITEMS_SQL, *KS_SQL), "roi"))
def q_roi(spark, sf):
    k = knap(spark, sf)
    return out(k.select("customer_id", D.plan_roi(F.col("total_value"), F.col("total_cost"), 1.0).alias("roi")))


@register("plan_confidence", rnd(with_c360("""
SELECT customer_id, CASE WHEN n_actions > 0 THEN round_even(LEAST(1e0 - GREATEST(churn_probability - total_reduction, 0.05e0), 0.99e0), 4) ELSE 0e0 END
  AS confidence FROM ks""", CAT_SQL, ITEMS_SQL, *KS_SQL), "confidence"))
def q_conf(spark, sf):
    k = knap(spark, sf)
    return out(k.select("customer_id", D.plan_confidence(F.col("churn_probability"), F.col("total_reduction"), F.col("n_actions"))
                        .alias("confidence")))


GREEDY_SQL = """ord AS (SELECT customer_id, action, cost, value, value / GREATEST(cost, 1e-9) AS density,
  ROW_NUMBER() OVER (ORDER BY value / GREATEST(cost, 1e-9) DESC, cost ASC, customer_id ASC, action ASC) AS rn FROM it)""", \
    f"""g AS (SELECT rn, remaining, taken FROM grd)""", \
    f"""grd AS (WITH RECURSIVE r(rn, remaining, taken) AS (
  SELECT 0 AS rn, {BUDGET}e0 AS remaining, FALSE AS taken
  UNION ALL SELECT ord.rn, CASE WHEN ord.cost <= r.remaining THEN r.remaining - ord.cost ELSE r.remaining END, ord.cost <= r.remaining
  FROM r JOIN ord ON ord.rn = r.rn + 1) SELECT * FROM r)""", \
    """sel AS (SELECT ord.* FROM ord JOIN grd ON ord.rn = grd.rn WHERE grd.taken)"""


@register("budget_greedy", rnd(with_c360("SELECT customer_id, action, cost, value FROM sel", CAT_SQL, ITEMS_SQL, GREEDY_SQL[0],
                                         GREEDY_SQL[2], GREEDY_SQL[3]), "cost,value"), headline=True)
def q_greedy(spark, sf):
    return out(D.budget_greedy(items(spark, sf), BUDGET).select("customer_id", "action", "cost", "value"))


@register("budget_allocate", rnd(with_c360("""
SELECT customer_id, action, cost, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY density DESC, cost ASC, action ASC) AS k
  FROM sel) AS a WHERE k <= 2""", CAT_SQL, ITEMS_SQL, GREEDY_SQL[0], GREEDY_SQL[2], GREEDY_SQL[3]), "cost,value"))
def q_alloc(spark, sf):
    return out(D.budget_allocate(items(spark, sf), BUDGET, per_customer=2).select("customer_id", "action", "cost", "value"))


@register("budget_frontier", rnd(with_c360("""
SELECT b.budget, COALESCE(SUM(o.cost), 0e0) AS spend, COALESCE(SUM(o.value), 0e0) AS value, COUNT(o.cost) AS n_items
FROM (SELECT UNNEST([""" + ", ".join(f"{b}e0" for b in FRONTIER) + """]) AS budget) AS b
LEFT JOIN (SELECT *, SUM(cost) OVER (ORDER BY rn) AS cum_cost FROM ord) AS o ON o.cum_cost <= b.budget GROUP BY b.budget""",
    CAT_SQL, ITEMS_SQL, GREEDY_SQL[0]), "budget,spend,value"))
def q_frontier(spark, sf):
    return out(D.budget_frontier(items(spark, sf), FRONTIER))


@register("action_log", rnd(with_c360("""
SELECT customer_id, action,
  CASE WHEN contains(a, 'price') OR contains(a, 'discount') THEN 'price_reduction'
       WHEN contains(a, 'csm') OR contains(a, 'onboarding') OR contains(a, 'support') THEN 'csm_assignment'
       WHEN contains(a, 'loyalty') OR contains(a, 'upgrade') OR contains(a, 'annual') THEN 'loyalty_upgrade'
       WHEN contains(a, 'outreach') OR contains(a, 'ticket') THEN 'support_outreach' ELSE 'engagement_campaign' END AS action_type,
  ROUND(cost, 2) AS estimated_cost_usd, arm AS ab_group, tier AS risk_tier,
  CASE WHEN tier = 'CRITICAL' THEN 'pending_approval' WHEN arm = 'treatment' THEN 'scheduled' ELSE 'control_holdout' END AS status
FROM (SELECT *, lower(replace(action, '_', ' ')) AS a,
  CASE WHEN churn_probability >= 0.85 THEN 'CRITICAL' WHEN churn_probability >= 0.70 THEN 'HIGH' WHEN churn_probability >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
  CASE WHEN (((((((CAST(('0x' || substr(md5(h), 1, 8)) AS BIGINT) % 100) * 96 + CAST(('0x' || substr(md5(h), 9, 8)) AS BIGINT)) % 100) * 96
   + CAST(('0x' || substr(md5(h), 17, 8)) AS BIGINT)) % 100) * 96 + CAST(('0x' || substr(md5(h), 25, 8)) AS BIGINT)) % 100) / 100e0 < 0.5
   THEN 'treatment' ELSE 'control' END AS arm
  FROM (SELECT *, 'retention_v1:' || CAST(customer_id AS VARCHAR) AS h,
    ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY value DESC, cost ASC, action ASC) AS rk FROM it) AS x WHERE rk = 1) AS y""",
    CAT_SQL, ITEMS_SQL), "estimated_cost_usd"))
def q_action_log(spark, sf):
    return out(D.action_log(items(spark, sf)))


@register("action_history", rnd(with_c360("""
SELECT it.customer_id, COUNT(*) AS n_actions, SUM(it.cost) AS total_cost, array_to_string(list_sort(list(it.action)), ',') AS actions
FROM ks JOIN mem ON ks.subset = mem.subset JOIN it ON it.customer_id = ks.customer_id AND it.action_idx = mem.action_idx
GROUP BY it.customer_id""", CAT_SQL, ITEMS_SQL, *KS_SQL), "total_cost"))
def q_action_history(spark, sf):
    k = knap(spark, sf).select("customer_id", F.explode("actions").alias("action"))
    chosen = k.join(F.broadcast(D.catalogue_df(spark).select("action", "cost")), "action")  # the fixed catalogue
    return out(D.action_history(chosen))
