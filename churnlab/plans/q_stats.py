"""Section 2.6: drift, PSI, z-score flags, experiments, rank correlation, conformal prediction."""

from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators import stats as ST
from churnlab.plans.oracle import rnd, with_c360
from churnlab.plans.registry import out, register
from churnlab.plans.q_features import AB_BUCKET_SQL
from churnlab.sources.tables import customer360_table as customer360

NUM = fx.RAW_NUMERIC
CAT = ["contract_type", "plan_tier", "payment_method", "segment", "region"]
SPLIT = "1995-07-01"


def c360(spark, sf):
    return customer360(spark, sf)


def ref_cur(spark, sf):
    d = c360(spark, sf)
    early = F.col("signup_date") < F.lit(SPLIT).cast("timestamp")
    return d.filter(early), d.filter(~early)


SIDES = f"b AS (SELECT CASE WHEN signup_date < TIMESTAMP '{SPLIT}' THEN 'ref' ELSE 'cur' END AS side, * FROM c360)"
LNUM = ("l AS (SELECT side, feature, value FROM (SELECT side, " + ", ".join(NUM) + " FROM b) UNPIVOT (value FOR feature IN ("
        + ", ".join(NUM) + ")) AS u)")
LCAT = ("lc AS (SELECT side, feature, value FROM (SELECT side, " + ", ".join(CAT) + " FROM b) UNPIVOT (value FOR feature IN ("
        + ", ".join(CAT) + ")) AS u)")
MOM = """mom AS (SELECT feature, COUNT(*) FILTER (WHERE side = 'ref') AS n_ref, COUNT(*) FILTER (WHERE side = 'cur') AS n_cur,
  AVG(value) FILTER (WHERE side = 'ref') AS ref_mean, AVG(value) FILTER (WHERE side = 'cur') AS cur_mean,
  STDDEV_POP(value) FILTER (WHERE side = 'ref') AS ref_std, STDDEV_POP(value) FILTER (WHERE side = 'cur') AS cur_std FROM l GROUP BY feature)"""
KS = """ks AS (SELECT feature, MAX(ABS(cr / nr - cc / nc)) AS statistic FROM (
  SELECT *, SUM(r) OVER (PARTITION BY feature ORDER BY value) AS cr, SUM(c) OVER (PARTITION BY feature ORDER BY value) AS cc,
    SUM(r) OVER (PARTITION BY feature) AS nr, SUM(c) OVER (PARTITION BY feature) AS nc
  FROM (SELECT feature, value, COUNT(*) FILTER (WHERE side = 'ref') AS r, COUNT(*) FILTER (WHERE side = 'cur') AS c FROM l GROUP BY 1, 2) AS a) AS x
  GROUP BY feature)"""


@register("drift_ks", rnd(with_c360("""
SELECT mom.*, ks.statistic FROM mom JOIN ks USING (feature) WHERE n_ref >= 2 AND n_cur >= 2""", SIDES, LNUM, MOM, KS),
    "ref_mean,cur_mean,ref_std,cur_std,statistic"), headline=True)
def q_drift_ks(spark, sf):
    ref, cur = ref_cur(spark, sf)
    r = ST.drift_ks(ref, cur, NUM)
    return out(r.select("feature", "n_ref", "n_cur", "ref_mean", "cur_mean", "ref_std", "cur_std", "statistic"))


@register("drift_chi2", rnd(with_c360("""
SELECT feature, SUM((c - e) * (c - e) / e) AS statistic, COUNT(*) AS cells, MAX(n_ref) AS n_ref, MAX(n_cur) AS n_cur,
  MAX(unseen) / MAX(n_cur) AS unseen_share
FROM (SELECT *, r / n_ref * (n_cur - unseen) AS e FROM (
  SELECT *, SUM(r) OVER (PARTITION BY feature) AS n_ref, SUM(c) OVER (PARTITION BY feature) AS n_cur,
    SUM(CASE WHEN r = 0 THEN c ELSE 0 END) OVER (PARTITION BY feature) AS unseen
  FROM (SELECT feature, value, COUNT(*) FILTER (WHERE side = 'ref') AS r, COUNT(*) FILTER (WHERE side = 'cur') AS c FROM lc GROUP BY 1, 2) AS a) AS x
  WHERE r > 0) AS y GROUP BY feature HAVING COUNT(*) >= 2""", SIDES, LCAT).replace(
    "MAX(n_ref) AS n_ref, MAX(n_cur) AS n_cur", "CAST(MAX(n_ref) AS BIGINT) AS n_ref, CAST(MAX(n_cur) AS BIGINT) AS n_cur"),
    "statistic,unseen_share"))
def q_drift_chi2(spark, sf):
    ref, cur = ref_cur(spark, sf)
    return out(ST.drift_chi2_stat(ref, cur, CAT))


@register("drift_summary")
def q_drift_summary(spark, sf):
    ref, cur = ref_cur(spark, sf)
    cols = ["feature", "statistic", "p_value", "drifted", "test"]
    res = ST.drift_ks(ref, cur, NUM).select(*cols).unionByName(ST.drift_chi2(ref, cur, CAT).select(*cols))
    return ST.drift_summary(res)


@register("drift_split")
def q_drift_split(spark, sf):
    return out(ST.drift_split(c360(spark, sf), "customer_id", NUM, CAT))


@register("psi", rnd(with_c360("""
SELECT feature, SUM((GREATEST(c / nc, 1e-4) - GREATEST(r / nr, 1e-4)) * LN(GREATEST(c / nc, 1e-4) / GREATEST(r / nr, 1e-4))) AS psi
FROM (SELECT *, SUM(r) OVER (PARTITION BY feature) AS nr, SUM(c) OVER (PARTITION BY feature) AS nc FROM (
  SELECT feature, bin, COUNT(*) FILTER (WHERE side = 'ref') AS r, COUNT(*) FILTER (WHERE side = 'cur') AS c FROM (
    SELECT l.feature, l.side, len(list_filter(e.edges, lambda x: l.value > x)) AS bin FROM l JOIN e ON l.feature = e.feature) AS bn
  GROUP BY 1, 2) AS a) AS j GROUP BY feature""", SIDES, LNUM,
    "e AS (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM l WHERE side = 'ref' GROUP BY feature)"),
    "psi"), headline=True)
def q_psi(spark, sf):
    ref, cur = ref_cur(spark, sf)
    return out(ST.psi(ref, cur, NUM))


LALL = ("la AS (SELECT feature, value FROM (SELECT " + ", ".join(NUM) + " FROM c360) UNPIVOT (value FOR feature IN ("
        + ", ".join(NUM) + ")) AS u)")


@register("baseline_stats", rnd(with_c360(
    "SELECT feature, AVG(value) AS mean, STDDEV_SAMP(value) AS std, COUNT(*) AS n FROM la GROUP BY feature", LALL), "mean,std"))
def q_baseline(spark, sf):
    return out(ST.baseline_stats(c360(spark, sf), NUM))


@register("zscore_flags", rnd(with_c360("""
SELECT customer_id, COUNT(*) FILTER (WHERE flag) AS n_flagged,
  COALESCE(string_agg(CASE WHEN flag THEN feature END, ',' ORDER BY feature), '') AS flagged,
  COUNT(*) FILTER (WHERE flag) / 12e0 AS anomaly_score, COUNT(*) FILTER (WHERE flag) / 12e0 < 0.3 AS passed
FROM (SELECT cl.customer_id, cl.feature, COALESCE(cl.value IS NOT NULL AND bs.std >= 1e-9 AND ABS((cl.value - bs.mean) / bs.std) > 3, FALSE) AS flag
      FROM cl JOIN bs ON cl.feature = bs.feature) AS f GROUP BY customer_id""", SIDES, LNUM,
    "bs AS (SELECT feature, AVG(value) AS mean, STDDEV_SAMP(value) AS std FROM l WHERE side = 'ref' GROUP BY feature)",
    "cl AS (SELECT customer_id, feature, value FROM (SELECT customer_id, " + ", ".join(NUM)
    + " FROM c360) UNPIVOT INCLUDE NULLS (value FOR feature IN (" + ", ".join(NUM) + ")) AS u)"), "anomaly_score"))
def q_zscore(spark, sf):
    ref, _ = ref_cur(spark, sf)
    base = ST.baseline_stats(ref, NUM)
    return out(ST.zscore_flags(c360(spark, sf), base, NUM))


# ---- experiments ---------------------------------------------------------------------------------
EXPS = {"retention_v1": "1e0 - churned", "pricing_v2": "monthly_charges / 100e0"}


def outcomes(spark, sf):
    d = c360(spark, sf).select("customer_id", "churned", "monthly_charges")
    o1 = d.select(F.lit("retention_v1").alias("experiment_id"), "customer_id",
                  fx.ab_assign(F.col("customer_id"), "retention_v1").alias("group"),
                  (F.lit(1.0) - F.col("churned")).alias("outcome_value"))
    o2 = d.select(F.lit("pricing_v2").alias("experiment_id"), "customer_id",
                  fx.ab_assign(F.col("customer_id"), "pricing_v2").alias("group"),
                  (F.col("monthly_charges") / 100.0).alias("outcome_value"))
    return o1.unionByName(o2)


OUT_SQL = "oc AS (" + " UNION ALL ".join(
    f"SELECT '{e}' AS experiment_id, customer_id, CASE WHEN {AB_BUCKET_SQL} / 100e0 < 0.5 THEN 'treatment' ELSE 'control' END AS \"group\", "
    f"{v} AS outcome_value FROM (SELECT *, '{e}:' || CAST(customer_id AS VARCHAR) AS h FROM c360) AS a" for e, v in EXPS.items()) + ")"


@register("ab_summary", with_c360("""
SELECT experiment_id, COUNT(*) AS total_outcomes, COUNT(*) FILTER (WHERE "group" = 'treatment') AS treatment_n,
  COUNT(*) FILTER (WHERE "group" = 'control') AS control_n FROM oc GROUP BY experiment_id""", OUT_SQL))
def q_ab_summary(spark, sf):
    return ST.ab_summary(outcomes(spark, sf))


def _cell(o, r, c):
    e = f"(({r}) * ({c}) / (a + b + c + d))"
    return f"((ABS({o} - {e}) - LEAST(0.5e0, ABS({e} - {o}))) * (ABS({o} - {e}) - LEAST(0.5e0, ABS({e} - {o}))) / {e})"


@register("ab_chi2", rnd(with_c360(f"""
SELECT experiment_id, a, b, c, d,
  {_cell('a', 'a + b', 'a + c')} + {_cell('b', 'a + b', 'b + d')} + {_cell('c', 'c + d', 'a + c')} + {_cell('d', 'c + d', 'b + d')} AS chi2_statistic
FROM (SELECT experiment_id, COUNT(*) FILTER (WHERE "group" = 'treatment' AND outcome_value >= 0.5) AS a,
  COUNT(*) FILTER (WHERE "group" = 'treatment' AND outcome_value < 0.5) AS b,
  COUNT(*) FILTER (WHERE "group" = 'control' AND outcome_value >= 0.5) AS c,
  COUNT(*) FILTER (WHERE "group" = 'control' AND outcome_value < 0.5) AS d FROM oc GROUP BY experiment_id) AS g""", OUT_SQL),
    "chi2_statistic"))
def q_ab_chi2(spark, sf):
    return out(ST.ab_chi2(outcomes(spark, sf)))


MW_SQL = """mw AS (SELECT experiment_id, CAST(SUM(nt) AS BIGINT) AS n1, CAST(SUM(nc) AS BIGINT) AS n2,
  SUM(nt * ((cum_t - t) + (t + 1) / 2e0)) - SUM(nt) * (SUM(nt) + 1) / 2e0 AS u_statistic,
  SUM(CAST(t AS DOUBLE) * t * t - t) AS ties
FROM (SELECT *, SUM(t) OVER (PARTITION BY experiment_id ORDER BY v) AS cum_t FROM (
  SELECT experiment_id, outcome_value AS v, COUNT(*) FILTER (WHERE "group" = 'treatment') AS nt, COUNT(*) FILTER (WHERE "group" = 'control') AS nc,
    COUNT(*) AS t FROM oc GROUP BY 1, 2) AS a) AS x GROUP BY experiment_id)"""


@register("ab_mannwhitney", rnd(with_c360("""
SELECT experiment_id, n1, n2, u_statistic,
  (GREATEST(u_statistic, CAST(n1 AS DOUBLE) * n2 - u_statistic) - CAST(n1 AS DOUBLE) * n2 / 2e0 - 0.5e0)
  / SQRT(CAST(n1 AS DOUBLE) * n2 / 12e0 * ((n1 + n2 + 1) - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS z
FROM mw""", OUT_SQL, MW_SQL), "u_statistic,z"))
def q_ab_mw(spark, sf):
    return out(ST.ab_mannwhitney(outcomes(spark, sf)))


@register("ab_report")
def q_ab_report(spark, sf):
    return out(ST.ab_report(outcomes(spark, sf)))


@register("spearman", rnd(with_c360("""
SELECT segment, CORR(ra, rb) AS spearman FROM (
  SELECT segment, RANK() OVER (PARTITION BY segment ORDER BY churn_probability) + (COUNT(*) OVER (PARTITION BY segment, churn_probability) - 1) / 2e0 AS ra,
    RANK() OVER (PARTITION BY segment ORDER BY challenger_probability) + (COUNT(*) OVER (PARTITION BY segment, challenger_probability) - 1) / 2e0 AS rb
  FROM c360) AS r GROUP BY segment"""), "spearman"))
def q_spearman(spark, sf):
    return out(ST.spearman(c360(spark, sf), "churn_probability", "challenger_probability", by=["segment"]))


# calibration / test halves: a seeded md5 split of the customer key (same rule as stats.hash_half)
HALF_SQL = "(CAST(('0x' || substr(md5('42:' || CAST(customer_id AS VARCHAR)), 1, 8)) AS BIGINT) % 2)"

CONF_Q = """q AS (SELECT COALESCE(MIN(CASE WHEN cum_n >= CEIL((n_cal + 1) * (1e0 - 0.1e0)) THEN score END), 1e0) AS q, MAX(n_cal) AS n_cal
FROM (SELECT *, SUM(n) OVER (ORDER BY score) AS cum_n, SUM(n) OVER () AS n_cal FROM (
  SELECT CASE WHEN churned = 1 THEN 1e0 - churn_probability ELSE churn_probability END AS score, COUNT(*) AS n
  FROM c360 WHERE {half} = 0 GROUP BY 1) AS a) AS b)""".format(half=HALF_SQL)


def _cal_test(spark, sf):
    d = c360(spark, sf)
    half = ST.hash_half("customer_id", seed=42)
    return d.filter(half == 0), d.filter(half == 1)


@register("conformal_quantile", rnd(with_c360("SELECT q, CAST(n_cal AS BIGINT) AS n_cal FROM q", CONF_Q), "q"))
def q_conf_q(spark, sf):
    cal, _ = _cal_test(spark, sf)
    return out(ST.conformal_quantile(cal, "churned", "churn_probability", 0.10))


@register("conformal_sets", with_c360("""
SELECT customer_id, (1e0 - churn_probability) <= q AS in_set_1, churn_probability <= q AS in_set_0,
  CAST((1e0 - churn_probability) <= q AS INTEGER) + CAST(churn_probability <= q AS INTEGER) AS set_size,
  (1e0 - churn_probability) <= q AND churn_probability <= q AS uncertain
FROM c360 CROSS JOIN q WHERE """ + HALF_SQL + " = 1", CONF_Q))
def q_conf_sets(spark, sf):
    cal, test = _cal_test(spark, sf)
    q = ST.conformal_quantile(cal, "churned", "churn_probability", 0.10).select("q")
    s = ST.conformal_sets(test.crossJoin(F.broadcast(q)), "churn_probability", F.col("q"))  # q: one row
    return s.select("customer_id", "in_set_1", "in_set_0", "set_size", "uncertain")


@register("conformal_coverage", rnd(with_c360("""
SELECT AVG(CASE WHEN CASE WHEN churned = 1 THEN (1e0 - churn_probability) <= q ELSE churn_probability <= q END THEN 1e0 ELSE 0e0 END) AS coverage,
  COUNT(*) AS n, AVG(CAST(CAST((1e0 - churn_probability) <= q AS INTEGER) + CAST(churn_probability <= q AS INTEGER) AS DOUBLE)) AS avg_set_size
FROM c360 CROSS JOIN q WHERE """ + HALF_SQL + " = 1", CONF_Q), "coverage,avg_set_size"))
def q_conf_cov(spark, sf):
    cal, test = _cal_test(spark, sf)
    q = ST.conformal_quantile(cal, "churned", "churn_probability", 0.10).select("q")
    return out(ST.conformal_coverage(test.crossJoin(F.broadcast(q)), "churned", "churn_probability", F.col("q")))
