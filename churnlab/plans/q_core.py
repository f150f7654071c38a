"""Slice 1: the customer360 view, risk tiers and headline KPIs."""

from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators import metrics as M
from churnlab.plans.oracle import rnd, with_c360
from churnlab.plans.registry import out, register
from churnlab.sources.tables import customer360, customer360_table


def c360(spark, sf):
    return customer360_table(spark, sf)


C360_DOUBLES = ("age,tenure_months,monthly_charges,total_charges,num_support_tickets_30d,login_frequency_30d,"
                "feature_adoption_rate,nps_score,usage_30d,usage_60d,usage_90d,days_since_last_login,"
                "churn_probability,challenger_probability")


@register("customer360", rnd(with_c360(
    "SELECT * REPLACE (strftime(signup_date, '%Y-%m-%d %H:%M:%S') AS signup_date) FROM c360"), C360_DOUBLES),
    headline=True)
def q_customer360(spark, sf):
    return out(customer360(spark, sf))  # always from the raw tables


@register("risk_tier", rnd(with_c360("""
SELECT customer_id, churn_probability,
  CASE WHEN churn_probability >= 0.85 THEN 'CRITICAL' WHEN churn_probability >= 0.70 THEN 'HIGH'
       WHEN churn_probability >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
FROM c360"""), "churn_probability"))
def q_risk_tier(spark, sf):
    return out(c360(spark, sf).select("customer_id", "churn_probability", fx.risk_tier().alias("risk_tier")))


@register("label_rate", rnd(with_c360("""
SELECT segment, COUNT(*) AS n, AVG(churned) AS label_rate FROM c360 GROUP BY segment
UNION ALL SELECT '__all__' AS segment, COUNT(*) AS n, AVG(churned) AS label_rate FROM c360"""), "label_rate"))
def q_label_rate(spark, sf):
    return out(M.label_rate(c360(spark, sf), "churned", by=["segment"], with_total=True))


@register("dataset_kpis", rnd(with_c360("""
SELECT t.segment, t.total, t.churned, t.churn_rate_pct, k.revenue_at_risk, k.watch_critical, k.watch_high
FROM t LEFT JOIN k ON t.segment = k.segment""", """t AS (
SELECT segment, COUNT(*) AS total, CAST(SUM(churned) AS BIGINT) AS churned, 100e0 * SUM(churned) / COUNT(*) AS churn_rate_pct
FROM c360 GROUP BY segment)""", """w AS (
SELECT segment, monthly_charges,
  ROW_NUMBER() OVER (PARTITION BY segment ORDER BY monthly_charges DESC, customer_id) AS rk
FROM c360 WHERE churned = 1)""", """k AS (
SELECT segment, SUM(CASE WHEN rk <= 10 THEN monthly_charges ELSE 0e0 END) AS revenue_at_risk,
  CAST(SUM(CASE WHEN monthly_charges >= 90 THEN 1 ELSE 0 END) AS BIGINT) AS watch_critical,
  CAST(SUM(CASE WHEN monthly_charges >= 70 AND monthly_charges < 90 THEN 1 ELSE 0 END) AS BIGINT) AS watch_high
FROM w WHERE rk <= 20 GROUP BY segment)"""), "churn_rate_pct,revenue_at_risk"), headline=True)
def q_dataset_kpis(spark, sf):
    return out(M.dataset_kpis(c360(spark, sf), "churned", "monthly_charges", by=["segment"], top=10, watch=20))
