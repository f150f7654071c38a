"""Section 2.2: per-row derivations over customer360 (no shuffle beyond the view itself)."""

from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.plans.oracle import rnd, with_c360
from churnlab.plans.registry import out, register
from churnlab.sources.tables import customer360_table as customer360, table


def c360(spark, sf):
    return customer360(spark, sf)


def _one(name, expr_fn, sql_expr, doubles=""):
    """Register ``customer_id`` + one derived column over the whole view."""
    register(name, rnd(with_c360(f"SELECT customer_id, {sql_expr} AS {name} FROM c360"), doubles))(
        lambda spark, sf: out(c360(spark, sf).select("customer_id", expr_fn().alias(name))))


_one("fe_usage_decline", fx.usage_decline,
     "CASE WHEN usage_90d IS NULL OR usage_30d IS NULL THEN NULL ELSE "
     "LEAST(GREATEST((usage_90d - usage_30d) / GREATEST(usage_90d, 1e-6), -2e0), 2e0) END", "fe_usage_decline")
_one("fe_usage_slope", fx.usage_slope, "(usage_30d - usage_90d) / 60e0", "fe_usage_slope")
_one("fe_support_flag", fx.support_flag, "CASE WHEN num_support_tickets_30d >= 5 THEN 1 ELSE 0 END")
_one("fe_charge_per_month", fx.charge_per_month, "monthly_charges / (tenure_months + 1e0)", "fe_charge_per_month")
_one("fe_charge_anomaly", fx.charge_anomaly,
     "CASE WHEN total_charges IS NULL OR monthly_charges * tenure_months IS NULL THEN NULL ELSE "
     "LEAST(GREATEST((total_charges - monthly_charges * tenure_months) / GREATEST(monthly_charges * tenure_months, 1e-6), -3e0), 3e0) END",
     "fe_charge_anomaly")
TENURE_BIN_SQL = ("CASE WHEN tenure_months >= 0 AND tenure_months <= 6 THEN 0e0 WHEN tenure_months > 6 AND tenure_months <= 12 THEN 1e0 "
                  "WHEN tenure_months > 12 AND tenure_months <= 24 THEN 2e0 WHEN tenure_months > 24 AND tenure_months <= 48 THEN 3e0 "
                  "WHEN tenure_months > 48 AND tenure_months <= 85 THEN 4e0 END")
_one("fe_tenure_bin", fx.tenure_bin, TENURE_BIN_SQL, "fe_tenure_bin")
_one("fe_login_trend", fx.login_trend,
     "CASE WHEN days_since_last_login IS NULL THEN NULL ELSE login_frequency_30d / (GREATEST(days_since_last_login, 1e0) + 1e0) END",
     "fe_login_trend")
NPS_SQL = ("CASE WHEN nps_score > -101 AND nps_score <= 0 THEN 0e0 WHEN nps_score > 0 AND nps_score <= 50 THEN 1e0 "
           "WHEN nps_score > 50 AND nps_score <= 101 THEN 2e0 END")
_one("fe_nps_segment", fx.nps_segment, NPS_SQL, "fe_nps_segment")
_one("fe_tenure_bucket", fx.tenure_bucket,
     "CASE WHEN tenure_months >= 0 AND tenure_months <= 12 THEN '0-12m' WHEN tenure_months > 12 AND tenure_months <= 36 THEN '13-36m' "
     "WHEN tenure_months > 36 AND tenure_months <= 72 THEN '37-72m' WHEN tenure_months > 72 AND tenure_months <= 9999 THEN '73m+' END")
_one("risk_label3", fx.risk_label3,
     "CASE WHEN churn_probability >= 0.70 THEN 'HIGH' WHEN churn_probability >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END")
_one("risk_tier_by_charge", fx.risk_tier_by_charge,
     "CASE WHEN monthly_charges >= 90 THEN 'CRITICAL' WHEN monthly_charges >= 70 THEN 'HIGH' WHEN monthly_charges >= 40 THEN 'MEDIUM' ELSE 'LOW' END")
_one("risk_score_heuristic", fx.risk_score_heuristic,
     "LEAST(ROUND(LEAST(COALESCE(monthly_charges, 0e0) / 120e0, 1e0) * 30e0 + GREATEST(0e0, 1e0 - COALESCE(tenure_months, 0e0) / 60e0) * 20e0 "
     "+ CASE WHEN num_support_tickets_30d IS NOT NULL AND num_support_tickets_30d <> 0 THEN LEAST(num_support_tickets_30d / 10e0, 1e0) * 25e0 ELSE 0e0 END "
     "+ CASE WHEN feature_adoption_rate IS NOT NULL THEN (1e0 - feature_adoption_rate) * 15e0 ELSE 0e0 END "
     "+ CASE WHEN nps_score IS NOT NULL THEN GREATEST(0e0, (5e0 - nps_score) / 10e0) * 10e0 ELSE 0e0 END, 0), 99e0)",
     "risk_score_heuristic")
_one("clv_annual", fx.clv_annual, "ROUND(COALESCE(NULLIF(monthly_charges, 0e0), 50e0) * 12e0, 2)", "clv_annual")
_one("clv_24m", fx.clv_24m, "COALESCE(monthly_charges, 80e0) * 24e0", "clv_24m")
_one("missing_pct", lambda: fx.missing_pct(*fx.RAW_NUMERIC, *fx.CATEGORICAL),
     "ROUND((" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in fx.RAW_NUMERIC + fx.CATEGORICAL)
     + f") / {float(len(fx.RAW_NUMERIC + fx.CATEGORICAL))}e0, 4)", "missing_pct")
_one("anonymised_id", lambda: fx.anonymised_id(F.col("customer_id")),
     "substr(sha256(CAST(customer_id AS VARCHAR)), 1, 16)")
_one("churn_hints", lambda: F.array_join(fx.churn_hints(), " | "),
     "concat_ws(' | ', CASE WHEN COALESCE(monthly_charges, 0e0) > 80 THEN 'a price reduction could meaningfully lower churn risk' END, "
     "CASE WHEN COALESCE(feature_adoption_rate, 1e0) < 0.4 THEN 'improving feature adoption through onboarding support may help' END, "
     "CASE WHEN contract_type = 'Month-to-Month' THEN 'upgrading to an annual contract would reduce churn risk' END)")


def _fmt0_sql(x):
    return f"COALESCE(printf('%.0f', round_even({x}, 0)), 'nan')"


def _num_sql(x):
    return f"COALESCE(CAST(CAST({x} AS DOUBLE) AS VARCHAR), 'nan')"


_one("profile_text", fx.profile_text,
     "concat_ws(' | ', 'Contract: ' || COALESCE(contract_type, 'unknown'), 'Plan: ' || COALESCE(plan_tier, 'unknown'), "
     f"'Tenure: ' || {_num_sql('tenure_months')} || ' months', 'Charges: $' || {_fmt0_sql('monthly_charges')} || '/month', "
     f"'Tickets: ' || {_num_sql('num_support_tickets_30d')} || ' in 30d', 'Login freq: ' || {_fmt0_sql('login_frequency_30d')} || '/30d', "
     f"'Feature adoption: ' || {_fmt0_sql('feature_adoption_rate * 100e0')} || '%', 'NPS: ' || {_fmt0_sql('nps_score')}, "
     f"'Days since login: ' || {_num_sql('days_since_last_login')})")


@register("wilson_interval", rnd(with_c360("""
SELECT customer_id,
  ROUND(GREATEST(0e0, (churn_probability + 1.645e0*1.645e0/(2e0*500)) / (1e0 + 1.645e0*1.645e0/500)
        - 1.645e0 * SQRT(churn_probability * (1e0 - churn_probability) / 500 + 1.645e0*1.645e0/(4e0*500*500)) / (1e0 + 1.645e0*1.645e0/500)), 4) AS ci_lower,
  ROUND(LEAST(1e0, (churn_probability + 1.645e0*1.645e0/(2e0*500)) / (1e0 + 1.645e0*1.645e0/500)
        + 1.645e0 * SQRT(churn_probability * (1e0 - churn_probability) / 500 + 1.645e0*1.645e0/(4e0*500*500)) / (1e0 + 1.645e0*1.645e0/500)), 4) AS ci_upper
FROM c360"""), "ci_lower,ci_upper"))
def q_wilson(spark, sf):
    ci = fx.wilson_interval(F.col("churn_probability"), n=500, z=1.645)
    return out(c360(spark, sf).select("customer_id", ci["lower"].alias("ci_lower"), ci["upper"].alias("ci_upper")))


@register("wilson_interval_n1000", rnd(with_c360("""
SELECT customer_id,
  ROUND(GREATEST(0e0, (churn_probability + 1.96e0*1.96e0/(2e0*1000)) / (1e0 + 1.96e0*1.96e0/1000)
        - 1.96e0 * SQRT(churn_probability * (1e0 - churn_probability) / 1000 + 1.96e0*1.96e0/(4e0*1000*1000)) / (1e0 + 1.96e0*1.96e0/1000)), 4) AS ci_lower,
  ROUND(LEAST(1e0, (churn_probability + 1.96e0*1.96e0/(2e0*1000)) / (1e0 + 1.96e0*1.96e0/1000)
        + 1.96e0 * SQRT(churn_probability * (1e0 - churn_probability) / 1000 + 1.96e0*1.96e0/(4e0*1000*1000)) / (1e0 + 1.96e0*1.96e0/1000)), 4) AS ci_upper
FROM c360"""), "ci_lower,ci_upper"))
def q_wilson1000(spark, sf):
    alpha = 0.2  # > 0.1 selects z = 1.96
    z = 1.645 if alpha <= 0.1 else 1.96
    ci = fx.wilson_interval(F.col("churn_probability"), n=1000, z=z)
    return out(c360(spark, sf).select("customer_id", ci["lower"].alias("ci_lower"), ci["upper"].alias("ci_upper")))


@register("is_uncertain_width", with_c360("""
SELECT customer_id,
  (LEAST(1e0, c + m) - GREATEST(0e0, c - m)) > 0.25 AS is_uncertain,
  (LEAST(1e0, c + m) - GREATEST(0e0, c - m)) > 0.05 AS is_uncertain_005
FROM (SELECT customer_id,
  (churn_probability + 1.645e0*1.645e0/(2e0*500)) / (1e0 + 1.645e0*1.645e0/500) AS c,
  1.645e0 * SQRT(churn_probability * (1e0 - churn_probability) / 500 + 1.645e0*1.645e0/(4e0*500*500)) / (1e0 + 1.645e0*1.645e0/500) AS m
  FROM c360) AS t"""))
def q_uncertain(spark, sf):
    ci = fx.wilson_interval(F.col("churn_probability"), n=500, z=1.645, digits=None)
    return out(c360(spark, sf).select(
        "customer_id", fx.is_uncertain_width(ci).alias("is_uncertain"),
        fx.is_uncertain_width(ci, 0.05).alias("is_uncertain_005")))


FEAT_SQL = f"""
SELECT *,
  CASE WHEN usage_90d IS NULL OR usage_30d IS NULL THEN NULL ELSE LEAST(GREATEST((usage_90d - usage_30d) / GREATEST(usage_90d, 1e-6), -2e0), 2e0) END AS usage_decline_rate,
  (usage_30d - usage_90d) / 60e0 AS usage_trend_slope,
  CASE WHEN num_support_tickets_30d >= 5 THEN 1 ELSE 0 END AS support_escalation_flag,
  monthly_charges / (tenure_months + 1e0) AS charge_per_month_normalised,
  CASE WHEN total_charges IS NULL OR monthly_charges * tenure_months IS NULL THEN NULL ELSE
    LEAST(GREATEST((total_charges - monthly_charges * tenure_months) / GREATEST(monthly_charges * tenure_months, 1e-6), -3e0), 3e0) END AS charge_anomaly,
  {TENURE_BIN_SQL} AS tenure_bin,
  CASE WHEN days_since_last_login IS NULL THEN NULL ELSE login_frequency_30d / (GREATEST(days_since_last_login, 1e0) + 1e0) END AS login_trend,
  {NPS_SQL} AS nps_segment
FROM c360"""

FEAT_DOUBLES = ("age,tenure_months,monthly_charges,total_charges,num_support_tickets_30d,login_frequency_30d,feature_adoption_rate,"
                "nps_score,usage_30d,usage_60d,usage_90d,days_since_last_login,churn_probability,challenger_probability,"
                "usage_decline_rate,usage_trend_slope,charge_per_month_normalised,charge_anomaly,tenure_bin,login_trend,nps_segment")


@register("fe_all", rnd(with_c360(f"SELECT * EXCLUDE (signup_date) FROM ({FEAT_SQL}) AS f"), FEAT_DOUBLES))
def q_fe_all(spark, sf):
    return out(fx.add_features(c360(spark, sf)).drop("signup_date"))


# ---- text helpers over data-derived strings -----------------------------------------------------

LONG_SQL = ("SELECT customer_id, feature, value FROM (SELECT customer_id, " + ", ".join(fx.RAW_NUMERIC)
            + " FROM c360) UNPIVOT INCLUDE NULLS (value FOR feature IN (" + ", ".join(fx.RAW_NUMERIC) + ")) AS u")


def _long(spark, sf):
    return c360(spark, sf).select("customer_id", *fx.RAW_NUMERIC).unpivot(
        "customer_id", fx.RAW_NUMERIC, "feature", "value")


@register("humanise", rnd(with_c360(f"""
SELECT customer_id, feature, value,
  array_to_string(list_transform(regexp_extract_all(replace(feature, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'),
     lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS label
FROM ({LONG_SQL}) AS l"""), "value"))
def q_humanise(spark, sf):
    return out(_long(spark, sf).withColumn("label", fx.humanise(F.col("feature"))))


@register("clean_condition", rnd(with_c360(f"""
SELECT customer_id, feature, cond,
  CASE WHEN tok IS NOT NULL THEN array_to_string(list_transform(regexp_extract_all(replace(tok, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'),
     lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') ELSE cond END AS cleaned
FROM (SELECT *, list_filter(string_split_regex(trim(cond), '\\s+'), lambda t: contains(t, '_') AND NOT regexp_matches(t, '[0-9]'))[1] AS tok
      FROM (SELECT customer_id, feature, CAST(CAST(FLOOR(value) AS BIGINT) AS VARCHAR) || ' < ' || feature || ' <= ' || CAST(CAST(FLOOR(value) AS BIGINT) + 1 AS VARCHAR) AS cond
            FROM ({LONG_SQL}) AS l WHERE value IS NOT NULL) AS c) AS t"""), ""))
def q_clean_condition(spark, sf):
    lf = _long(spark, sf).filter(F.col("value").isNotNull()).select(
        "customer_id", "feature",
        F.concat(F.floor("value").cast("bigint").cast("string"), F.lit(" < "), F.col("feature"), F.lit(" <= "),
                 (F.floor("value").cast("bigint") + 1).cast("string")).alias("cond"))
    return out(lf.withColumn("cleaned", fx.clean_condition(F.col("cond"))))


@register("action_type", """
SELECT conv_id, turn,
  CASE WHEN contains(lower(text), 'price') OR contains(lower(text), 'discount') THEN 'price_reduction'
       WHEN contains(lower(text), 'csm') OR contains(lower(text), 'onboarding') OR contains(lower(text), 'support') THEN 'csm_assignment'
       WHEN contains(lower(text), 'loyalty') OR contains(lower(text), 'upgrade') OR contains(lower(text), 'annual') THEN 'loyalty_upgrade'
       WHEN contains(lower(text), 'outreach') OR contains(lower(text), 'ticket') THEN 'support_outreach'
       ELSE 'engagement_campaign' END AS action_type
FROM conversations WHERE role = 'user'""")
def q_action_type(spark, sf):
    cv = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return cv.select("conv_id", "turn", fx.action_type(F.col("text")).alias("action_type"))


@register("normalise_action_type", """
SELECT conv_id, turn, CASE WHEN n IN ('price_reduction', 'csm_assignment', 'loyalty_upgrade', 'support_outreach', 'engagement_campaign')
  THEN n ELSE 'engagement_campaign' END AS action_type
FROM (SELECT conv_id, turn, replace(replace(lower(t), ' ', '_'), '-', '_') AS n
      FROM (SELECT conv_id, turn, CASE WHEN contains(lower(text), 'price') THEN 'Price Reduction'
                                       WHEN contains(lower(text), 'support') THEN 'support-outreach' ELSE text END AS t
            FROM conversations) AS a) AS b""")
def q_normalise_action_type(spark, sf):
    cv = table(spark, sf, "conversations")
    t = (F.when(F.lower("text").contains("price"), "Price Reduction")
         .when(F.lower("text").contains("support"), "support-outreach").otherwise(F.col("text")))
    return cv.select("conv_id", "turn", fx.normalise_action_type(t).alias("action_type"))


AB_BUCKET_SQL = """(((((((CAST(('0x' || substr(md5(h), 1, 8)) AS BIGINT) % 100) * 96 + CAST(('0x' || substr(md5(h), 9, 8)) AS BIGINT)) % 100) * 96
   + CAST(('0x' || substr(md5(h), 17, 8)) AS BIGINT)) % 100) * 96 + CAST(('0x' || substr(md5(h), 25, 8)) AS BIGINT)) % 100)"""


@register("ab_assign", with_c360(f"""
SELECT customer_id, bucket, CASE WHEN bucket / 100e0 < 0.5 THEN 'treatment' ELSE 'control' END AS arm
FROM (SELECT customer_id, {AB_BUCKET_SQL} AS bucket FROM (SELECT customer_id, 'retention_v1:' || CAST(customer_id AS VARCHAR) AS h FROM c360) AS a) AS b"""))
def q_ab_assign(spark, sf):
    return c360(spark, sf).select("customer_id", fx.ab_bucket(F.col("customer_id"), "retention_v1").alias("bucket"),
                                  fx.ab_assign(F.col("customer_id"), "retention_v1").alias("arm"))


@register("dispatch_status", with_c360(f"""
SELECT customer_id, arm, CASE WHEN arm = 'treatment' THEN 'scheduled' ELSE 'control_holdout' END AS status, arm = 'treatment' AS dispatched
FROM (SELECT customer_id, CASE WHEN {AB_BUCKET_SQL} / 100e0 < 0.5 THEN 'treatment' ELSE 'control' END AS arm
      FROM (SELECT customer_id, 'retention_v1:' || CAST(customer_id AS VARCHAR) AS h FROM c360) AS a) AS b"""))
def q_dispatch(spark, sf):
    d = c360(spark, sf).select("customer_id", fx.ab_assign(F.col("customer_id"), "retention_v1").alias("arm"))
    st = fx.dispatch_status(F.col("arm"))
    return d.select("customer_id", "arm", st["status"].alias("status"), st["dispatched"].alias("dispatched"))


@register("interaction_text", with_c360("""
SELECT customer_id, 'Customer ' || CAST(customer_id AS VARCHAR) || '. churn probability ' || CAST(CAST(round_even(churn_probability * 100e0, 0) AS INTEGER) AS VARCHAR)
  || '%. risk tier ' || CASE WHEN churn_probability >= 0.85 THEN 'CRITICAL' WHEN churn_probability >= 0.70 THEN 'HIGH' WHEN churn_probability >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END
  || '. action: ' || CASE WHEN monthly_charges > 80 THEN 'discount_10pct' ELSE 'none' END
  || '. outcome: ' || CASE WHEN churned = 1 THEN 'churned' ELSE 'retained' END
  || CASE WHEN nps_score > 0 OR tenure_months < 12 THEN '. top drivers: ' || concat_ws(', ', CASE WHEN nps_score > 0 THEN 'nps_score' END, CASE WHEN tenure_months < 12 THEN 'tenure_months' END) ELSE '' END
  AS text FROM c360"""))
def q_interaction_text(spark, sf):
    d = c360(spark, sf)
    drivers = F.array_compact(F.array(F.when(F.col("nps_score") > 0, F.lit("nps_score")), F.when(F.col("tenure_months") < 12, F.lit("tenure_months"))))
    return d.select("customer_id", fx.interaction_text(p="churn_probability", tier=fx.risk_tier(), drivers=drivers,
                                                       action=F.when(F.col("monthly_charges") > 80, F.lit("discount_10pct")),
                                                       outcome=F.when(F.col("churned") == 1, "churned").otherwise("retained")).alias("text"))


@register("narrative_template")
def q_narrative(spark, sf):
    d = fx.add_features(c360(spark, sf))
    up = F.array_compact(F.array(
        F.when(F.col("monthly_charges") > 80, F.lit("monthly_charges")),
        F.when(F.col("support_escalation_flag") == 1, F.lit("support_escalation_flag")),
        F.when(F.col("tenure_bin") <= 1, F.lit("tenure_months"))))
    dn = F.array_compact(F.array(F.when(F.col("nps_score") > 50, F.lit("nps_score"))))
    acts = F.array(F.struct(F.lit("Offer a 10% discount").alias("label"), F.lit(0.08).alias("reduction"), F.lit(20.0).alias("cost")))
    return d.select("customer_id", fx.narrative_template("churn_probability", up, dn, acts).alias("narrative"))
