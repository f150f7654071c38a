"""Section 2.10: survival, projection, cohorts, monthly series and decomposition."""

from pyspark.sql import functions as F

from churnlab.operators import temporal as TM
from churnlab.plans.oracle import rnd, with_c360
from churnlab.plans.registry import out, register
from churnlab.sources.tables import customer360_table as customer360, table


def c360(spark, sf):
    return customer360(spark, sf)


KM = ["""kt AS (SELECT segment, GREATEST(tenure_months, 0e0) AS t, churned AS e FROM c360)""",
      """kc AS (SELECT segment, t, COUNT(*) AS removed, SUM(e) AS d FROM kt GROUP BY 1, 2)""",
      """kr AS (SELECT *, SUM(removed) OVER (PARTITION BY segment ORDER BY t DESC) AS at_risk FROM kc)""",
      """kr2 AS (SELECT *, CASE WHEN d >= at_risk OR d = 0 THEN 0e0 ELSE LN(1e0 - d / at_risk) END AS lg,
  CASE WHEN d >= at_risk AND d > 0 THEN 1 ELSE 0 END AS zr, CASE WHEN d >= at_risk THEN 0e0 ELSE d / (at_risk * (at_risk - d)) END AS gw FROM kr)""",
      """km AS (SELECT segment, t, CASE WHEN SUM(zr) OVER w > 0 THEN 0e0 ELSE EXP(SUM(lg) OVER w) END AS survival,
  SUM(gw) OVER w AS greenwood FROM kr2 WINDOW w AS (PARTITION BY segment ORDER BY t))"""]
CI = "1.959963984540054e0"


@register("km_curve", rnd(with_c360(f"""
SELECT segment, CAST(t AS INTEGER) AS t, s AS survival,
  CASE WHEN s >= 1 THEN 1e0 WHEN s <= 0 THEN 0e0 ELSE POW(s, EXP({CI} * SQRT(gw / (LN(s) * LN(s))))) END AS ci_lower,
  CASE WHEN s >= 1 THEN 1e0 WHEN s <= 0 THEN 0e0 ELSE POW(s, EXP(-{CI} * SQRT(gw / (LN(s) * LN(s))))) END AS ci_upper
FROM (SELECT tl.segment, tl.t, COALESCE(km.survival, 1e0) AS s, COALESCE(km.greenwood, 0e0) AS gw
      FROM tl ASOF LEFT JOIN km ON tl.segment = km.segment AND tl.t >= km.t) AS j""", *KM,
    """tl AS (SELECT g.segment, CAST(x.t AS DOUBLE) AS t FROM (SELECT DISTINCT segment FROM km) AS g
  CROSS JOIN (SELECT UNNEST(range(0, (SELECT CAST(FLOOR(MAX(tenure_months)) AS INTEGER) FROM c360) + 1)) AS t) AS x)"""),
    "survival,ci_lower,ci_upper"), headline=True)
def q_km(spark, sf):
    return out(TM.km_curve(c360(spark, sf), "tenure_months", "churned", by="segment"))


@register("km_ci", rnd(with_c360(f"""
SELECT segment, t, survival, greenwood,
  CASE WHEN survival >= 1 THEN 1e0 WHEN survival <= 0 THEN 0e0 ELSE POW(survival, EXP({CI} * SQRT(greenwood / (LN(survival) * LN(survival))))) END AS ci_lower,
  CASE WHEN survival >= 1 THEN 1e0 WHEN survival <= 0 THEN 0e0 ELSE POW(survival, EXP(-{CI} * SQRT(greenwood / (LN(survival) * LN(survival))))) END AS ci_upper
FROM km""", *KM), "t,survival,greenwood,ci_lower,ci_upper"))
def q_km_ci(spark, sf):
    tab = TM.km_table(c360(spark, sf), "tenure_months", "churned", by="segment")
    lo, hi = TM._ci(F.col("survival"), F.col("greenwood"))
    return out(tab.select("segment", "t", "survival", "greenwood", lo.alias("ci_lower"), hi.alias("ci_upper")))


@register("km_median", rnd(with_c360("SELECT segment, MIN(t) FILTER (WHERE survival <= 0.5) AS median_survival FROM km GROUP BY segment",
                                     *KM), "median_survival"))
def q_km_median(spark, sf):
    return out(TM.km_median(c360(spark, sf), "tenure_months", "churned", by="segment"))


@register("churn_projection", rnd(with_c360("""
SELECT CAST(m AS INTEGER) AS month, round_even(SUM(h * POW(1e0 - h, m - 1)), 1) AS expected_churns,
  round_even(SUM(POW(1e0 - h, m)), 1) AS expected_active
FROM (SELECT 1e0 - POW(1e0 - LEAST(GREATEST(churn_probability, 0e0), 1e0), 1e0 / 12) AS h FROM c360) AS a
CROSS JOIN (SELECT UNNEST(range(1, 13)) AS m) AS b GROUP BY m"""), "expected_churns,expected_active"))
def q_projection(spark, sf):
    return out(TM.churn_projection(c360(spark, sf), "churn_probability", 12))


COH = ["""cells AS (SELECT strftime(signup_date, '%Y-%m') AS cohort, tenure_months AS tenure, COUNT(*) AS n,
  SUM(CASE WHEN churned = 1 THEN 1 ELSE 0 END) AS churned_n FROM c360 WHERE signup_date IS NOT NULL GROUP BY 1, 2)""",
       """cm AS (SELECT cohort, CAST(month AS INTEGER) AS month, CASE WHEN observed > 0 THEN round_even(1e0 - cbm / size, 4) END AS retention
FROM (SELECT cohort, month, SUM(CASE WHEN tenure >= month THEN n ELSE 0 END) AS observed,
  SUM(CASE WHEN tenure <= month THEN churned_n ELSE 0 END) AS cbm FROM cells CROSS JOIN (SELECT UNNEST(range(0, 24)) AS month) AS ms
  GROUP BY 1, 2) AS g JOIN (SELECT cohort, SUM(n) AS size FROM cells GROUP BY 1) AS sz USING (cohort))"""]


@register("cohort_matrix", rnd(with_c360("SELECT * FROM cm", *COH), "retention"))
def q_cohort(spark, sf):
    return out(TM.cohort_matrix(c360(spark, sf), "signup_date", "tenure_months", "churned", 24))


@register("cohort_matrix_tenure", rnd(with_c360("""
SELECT 'Cohort T+' || CAST(bucket AS VARCHAR) AS cohort, CAST(month AS INTEGER) AS month,
  CASE WHEN observed > 0 THEN round_even(1e0 - cbm / size, 4) END AS retention
FROM (SELECT bucket, month, SUM(CASE WHEN tenure >= bucket + month THEN n ELSE 0 END) AS observed,
  SUM(CASE WHEN tenure <= bucket + month THEN churned_n ELSE 0 END) AS cbm
  FROM tc CROSS JOIN (SELECT UNNEST(range(0, 24)) AS month) AS ms GROUP BY 1, 2) AS g
JOIN (SELECT bucket, SUM(n) AS size FROM tc GROUP BY 1) AS sz USING (bucket)""",
    """tc AS (SELECT CAST(FLOOR(tenure_months / 6) * 6 AS INTEGER) AS bucket, tenure_months AS tenure, COUNT(*) AS n,
  SUM(CASE WHEN churned = 1 THEN 1 ELSE 0 END) AS churned_n FROM c360 WHERE tenure_months IS NOT NULL GROUP BY 1, 2)"""), "retention"))
def q_cohort_tenure(spark, sf):
    return out(TM.cohort_matrix_tenure(c360(spark, sf), "tenure_months", "churned", 24, 6))


@register("cohort_churn_by_month", rnd(with_c360("""
SELECT month, round_even(AVG(pc), 4) AS avg_churn FROM (
  SELECT month, LAG(retention, 1) OVER (PARTITION BY cohort ORDER BY month) - retention AS pc FROM cm) AS a
WHERE month >= 1 GROUP BY month""", *COH), "avg_churn"))
def q_cohort_churn(spark, sf):
    m = TM.cohort_matrix(c360(spark, sf), "signup_date", "tenure_months", "churned", 24)
    return out(TM.cohort_churn_by_month(m))


def orders_series(spark, sf, by=()):
    o = table(spark, sf, "orders")
    return TM.monthly_rate_series(o, "o_orderdate", (F.col("o_orderstatus") == "F").cast("int"), by=by)


SERIES = """se AS (SELECT tl.p, strftime(tl.m, '%Y-%m') AS month, COALESCE(a.rate, 0e0) AS value FROM (
  SELECT p, UNNEST(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM (
    SELECT {p} AS p, MIN(date_trunc('month', o_orderdate)) AS lo, MAX(date_trunc('month', o_orderdate)) AS hi FROM orders GROUP BY 1) AS r) AS tl
  LEFT JOIN (SELECT {p} AS p, date_trunc('month', o_orderdate) AS m, AVG(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) AS rate
             FROM orders GROUP BY 1, 2) AS a ON tl.p = a.p AND tl.m = a.m)"""


@register("monthly_rate_series", rnd("WITH " + SERIES.format(p="'all'") + " SELECT month, value FROM se", "value"))
def q_series(spark, sf):
    return out(orders_series(spark, sf))


DECOMP = """dc AS (SELECT p AS o_orderpriority, month, value, trend, sm - AVG(fst) OVER (PARTITION BY p) AS seasonal FROM (
  SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY p, pos ORDER BY i) = 1 THEN sm END AS fst FROM (
    SELECT *, AVG(value - trend) OVER (PARTITION BY p, pos) AS sm FROM (
      SELECT *, (i % 12) AS pos, CASE WHEN LAG(value, 6) OVER w IS NOT NULL AND LEAD(value, 6) OVER w IS NOT NULL
        THEN (SUM(value) OVER (PARTITION BY p ORDER BY i ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - 0.5e0 * (LAG(value, 6) OVER w + LEAD(value, 6) OVER w)) / 12e0 END AS trend
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p ORDER BY month) - 1 AS i FROM se) AS a WINDOW w AS (PARTITION BY p ORDER BY i)) AS b) AS c) AS d)"""


@register("classical_decompose", rnd("WITH " + SERIES.format(p="o_orderpriority") + ", " + DECOMP
                                     + " SELECT *, value - trend - seasonal AS residual FROM dc", "value,trend,seasonal,residual"))
def q_classical(spark, sf):
    s = orders_series(spark, sf, by=["o_orderpriority"])
    return out(TM.classical_decompose(s, by=["o_orderpriority"]))


@register("seasonality_summary", rnd("WITH " + SERIES.format(p="o_orderpriority") + ", " + DECOMP + """
SELECT o_orderpriority, arg_max(month, (seasonal, -epoch(strptime(month, '%Y-%m')))) AS peak_month, MAX(seasonal) AS peak_value,
  arg_min(month, (seasonal, epoch(strptime(month, '%Y-%m')))) AS trough_month, MIN(seasonal) AS trough_value
FROM dc GROUP BY o_orderpriority""", "peak_value,trough_value"))
def q_season(spark, sf):
    s = orders_series(spark, sf, by=["o_orderpriority"])
    return out(TM.seasonality_summary(TM.classical_decompose(s, by=["o_orderpriority"]), by=["o_orderpriority"]))


# ---- Cox PH, concordance, STL (rows-only checks) ----------------------------------------------
from churnlab.operators import survival as SV  # noqa: E402

COX_COVARIATES = ["monthly_charges", "nps_score", "age"]


@register("cox_ph")
def q_cox(spark, sf):
    return out(SV.cox_ph(c360(spark, sf), "tenure_months", "churned", COX_COVARIATES, penalizer=0.1))


@register("cox_concordance")
def q_concordance(spark, sf):
    d = c360(spark, sf)
    # risk = the fitted Cox linear predictor
    cx = SV.cox_ph(d, "tenure_months", "churned", COX_COVARIATES).select("covariate", "coef").collect()  # one row per covariate
    lp = sum(F.col(r["covariate"]) * F.lit(r["coef"]) for r in cx)
    return out(SV.cox_concordance(d.withColumn("risk", lp), "tenure_months", "churned", "risk"))


@register("concordance_index", rnd(with_c360("""
SELECT SUM(CASE WHEN i.churn_probability > j.churn_probability THEN 1 ELSE 0 END) AS concordant,
  SUM(CASE WHEN i.churn_probability = j.churn_probability THEN 1 ELSE 0 END) AS tied_risk, COUNT(*) AS comparable,
  (SUM(CASE WHEN i.churn_probability > j.churn_probability THEN 1e0 WHEN i.churn_probability = j.churn_probability THEN 0.5e0 ELSE 0e0 END)) / COUNT(*) AS concordance
FROM c360 AS i JOIN c360 AS j ON i.tenure_months < j.tenure_months WHERE i.churned = 1"""), "concordance"))
def q_concordance_index(spark, sf):
    return out(SV.cox_concordance(c360(spark, sf), "tenure_months", "churned", "churn_probability"))


@register("stl_decompose")
def q_stl(spark, sf):
    s = orders_series(spark, sf, by=["o_orderpriority"])
    return out(SV.stl_decompose(s, "o_orderpriority"))
