"""Sections 2.5 / fairness / calibration: metrics over the scored customer360 view."""

from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators import fairness as FA
from churnlab.operators import metrics as M
from churnlab.plans.oracle import rnd, with_c360
from churnlab.plans.registry import out, register
from churnlab.sources.tables import customer360_table as customer360

Y, P = "churned", "churn_probability"
ATTRS = ["segment", "region", "contract_type"]


def c360(spark, sf):
    return customer360(spark, sf)


S_SEG = "s AS (SELECT segment, churn_probability AS score, SUM(churned) AS pos, SUM(1 - churned) AS neg FROM c360 GROUP BY 1, 2)"
S_ALL = "s AS (SELECT churn_probability AS score, SUM(churned) AS pos, SUM(1 - churned) AS neg FROM c360 GROUP BY 1)"
TOT = "t AS (SELECT SUM(churned) AS P, SUM(1 - churned) AS N FROM c360)"
CURVE = "c AS (SELECT *, SUM(pos) OVER (ORDER BY score DESC) AS tp, SUM(neg) OVER (ORDER BY score DESC) AS fp FROM s CROSS JOIN t)"


@register("auc_roc", rnd(with_c360("""
SELECT segment, SUM(pos * ((cum_neg - neg) + neg * 0.5e0)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) AS auc_roc FROM c GROUP BY segment""",
    S_SEG, "c AS (SELECT *, SUM(neg) OVER (PARTITION BY segment ORDER BY score) AS cum_neg FROM s)"), "auc_roc"), headline=True)
def q_auc(spark, sf):
    return out(M.auc_roc(c360(spark, sf), Y, P, by=["segment"]))


@register("roc_pr_curve", rnd(with_c360("""
SELECT score AS threshold, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  CAST(P AS BIGINT) AS P, CAST(N AS BIGINT) AS N, tp / (tp + fp) AS precision, tp / P AS recall, fp / N AS fpr, tp / P AS tpr FROM c""",
    S_ALL, TOT, CURVE), "threshold,precision,recall,fpr,tpr"))
def q_curve(spark, sf):
    return out(M.roc_pr_curve(c360(spark, sf), Y, P))


@register("avg_precision", rnd(with_c360("SELECT SUM(pos * tp / (tp + fp)) / MAX(P) AS avg_precision FROM c", S_ALL, TOT, CURVE),
                               "avg_precision"))
def q_ap(spark, sf):
    return out(M.avg_precision(c360(spark, sf), Y, P))


@register("optimal_threshold", rnd(with_c360("""
SELECT * FROM (SELECT 'f1' AS metric, score AS threshold, 2 * (tp / (tp + fp)) * (tp / P) / ((tp / (tp + fp)) + (tp / P) + 1e-9) AS value
  FROM c WHERE tp - pos < P ORDER BY value DESC, threshold ASC LIMIT 1) AS a
UNION ALL SELECT * FROM (SELECT 'gmean' AS metric, score AS threshold, SQRT((tp / P) * (1e0 - fp / N)) AS value
  FROM c ORDER BY value DESC, threshold DESC LIMIT 1) AS b""", S_ALL, TOT, CURVE), "threshold,value"))
def q_opt(spark, sf):
    cur = M.roc_pr_curve(c360(spark, sf), Y, P)
    f1 = M.optimal_threshold(cur, "f1").select(F.lit("f1").alias("metric"), "threshold", "value")
    gm = M.optimal_threshold(cur, "gmean").select(F.lit("gmean").alias("metric"), "threshold", "value")
    return out(f1.unionByName(gm))


@register("lift_curve", rnd(with_c360("""
SELECT score AS threshold, cum_rows / rows_total AS population_pct, cum_pos / pos_total AS cumulative_churn,
  (cum_pos / pos_total) / (cum_rows / rows_total) AS lift
FROM (SELECT *, SUM(pos) OVER (ORDER BY score DESC) AS cum_pos, SUM(rows) OVER (ORDER BY score DESC) AS cum_rows FROM s CROSS JOIN t) AS c""",
    "s AS (SELECT churn_probability AS score, SUM(churned) AS pos, COUNT(*) AS rows FROM c360 GROUP BY 1)",
    "t AS (SELECT SUM(churned) AS pos_total, COUNT(*) AS rows_total FROM c360)"), "threshold,population_pct,cumulative_churn,lift"))
def q_lift(spark, sf):
    return out(M.lift_curve(c360(spark, sf), Y, P))


@register("confusion", with_c360("""
SELECT segment, COUNT(*) FILTER (WHERE churn_probability >= 0.5 AND churned = 1) AS tp,
  COUNT(*) FILTER (WHERE churn_probability >= 0.5 AND churned <> 1) AS fp,
  COUNT(*) FILTER (WHERE churn_probability < 0.5 AND churned <> 1) AS tn,
  COUNT(*) FILTER (WHERE churn_probability < 0.5 AND churned = 1) AS fn FROM c360 GROUP BY segment"""))
def q_confusion(spark, sf):
    return M.confusion(c360(spark, sf), Y, P, 0.5, by=["segment"])


@register("clf_metrics", rnd(with_c360("""
SELECT tp, fp, tn, fn, brier_score, log_loss, tp / (tp + fp + 1e-9) AS precision, tp / (tp + fn + 1e-9) AS recall,
  tn / (tn + fp + 1e-9) AS specificity, COALESCE(2e0 * tp / NULLIF(2 * tp + fp + fn, 0), 0e0) AS f1_positive,
  (COALESCE(2e0 * tp / NULLIF(2 * tp + fp + fn, 0), 0e0) + COALESCE(2e0 * tn / NULLIF(2 * tn + fn + fp, 0), 0e0)) / 2e0 AS f1_macro
FROM (SELECT COUNT(*) FILTER (WHERE churn_probability >= 0.5 AND churned = 1) AS tp,
  COUNT(*) FILTER (WHERE churn_probability >= 0.5 AND churned <> 1) AS fp,
  COUNT(*) FILTER (WHERE churn_probability < 0.5 AND churned <> 1) AS tn,
  COUNT(*) FILTER (WHERE churn_probability < 0.5 AND churned = 1) AS fn,
  AVG((churn_probability - churned) * (churn_probability - churned)) AS brier_score,
  AVG(-(churned * LN(LEAST(GREATEST(churn_probability, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
      + (1 - churned) * LN(1 - LEAST(GREATEST(churn_probability, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))) AS log_loss
  FROM c360) AS a"""), "brier_score,log_loss,precision,recall,specificity,f1_positive,f1_macro"))
def q_clf(spark, sf):
    return out(M.clf_metrics(c360(spark, sf), Y, P))


@register("calibration_bins", rnd(with_c360("""
SELECT CAST(LEAST(FLOOR(churn_probability * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n,
  AVG(churn_probability) AS confidence, AVG(CAST(churned AS DOUBLE)) AS accuracy FROM c360 GROUP BY 1"""), "confidence,accuracy"))
def q_cal_bins(spark, sf):
    return out(M.calibration_bins(c360(spark, sf), Y, P))


@register("calibration_ece", rnd(with_c360("""
SELECT SUM(n * ABS(confidence - accuracy)) / SUM(n) AS ece FROM (
SELECT COUNT(*) AS n, AVG(churn_probability) AS confidence, AVG(CAST(churned AS DOUBLE)) AS accuracy
FROM c360 GROUP BY CAST(LEAST(FLOOR(churn_probability * 10), 9) AS INTEGER)) AS b"""), "ece"))
def q_ece(spark, sf):
    return out(M.calibration_ece(c360(spark, sf), Y, P))


EDGES = " + ".join(f"CASE WHEN churn_probability > {i * (1.0 / 10)!r} THEN 1 ELSE 0 END" for i in range(1, 10))


@register("calibration_curve", rnd(with_c360(f"""
SELECT CAST({EDGES} AS INTEGER) AS bin, COUNT(*) AS n, AVG(CAST(churned AS DOUBLE)) AS prob_true, AVG(churn_probability) AS prob_pred
FROM c360 GROUP BY 1"""), "prob_true,prob_pred"))
def q_cal_curve(spark, sf):
    return out(M.calibration_curve(c360(spark, sf), Y, P))


LB_SQL = """l AS (SELECT 'champion' AS model, churned, churn_probability AS score FROM c360
  UNION ALL SELECT 'challenger' AS model, churned, challenger_probability AS score FROM c360)""", \
    "s AS (SELECT model, score, SUM(churned) AS pos, SUM(1 - churned) AS neg FROM l GROUP BY 1, 2)", \
    "c AS (SELECT *, SUM(neg) OVER (PARTITION BY model ORDER BY score) AS cum_neg FROM s)", \
    "a AS (SELECT model, SUM(pos * ((cum_neg - neg) + neg * 0.5e0)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) AS auc_roc FROM c GROUP BY model)"


@register("leaderboard", rnd(with_c360("SELECT model, auc_roc, CAST(RANK() OVER (ORDER BY auc_roc DESC, model) AS INTEGER) AS rank FROM a",
                                       *LB_SQL), "auc_roc"))
def q_leaderboard(spark, sf):
    return out(M.leaderboard(c360(spark, sf), Y, {"champion": P, "challenger": "challenger_probability"}))


@register("champion_challenger", rnd(with_c360("""
SELECT MAX(CASE WHEN model = 'champion' THEN auc_roc END) AS champion_auc, MAX(CASE WHEN model = 'challenger' THEN auc_roc END) AS challenger_auc,
  MAX(CASE WHEN model = 'challenger' THEN auc_roc END) > MAX(CASE WHEN model = 'champion' THEN auc_roc END) + 0.005 AS promote FROM a""",
    *LB_SQL), "champion_auc,challenger_auc"))
def q_champ(spark, sf):
    return out(M.champion_challenger(c360(spark, sf), Y, P, "challenger_probability"))


@register("rate_by_tier", with_c360("""
SELECT CASE WHEN churn_probability >= 0.85 THEN 'CRITICAL' WHEN churn_probability >= 0.70 THEN 'HIGH'
  WHEN churn_probability >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier, COUNT(*) AS predictions FROM c360 GROUP BY 1"""))
def q_rate_by_tier(spark, sf):
    return M.rate_by_tier(c360(spark, sf).withColumn("risk_tier", fx.risk_tier()))


PAIRS = """pr AS (SELECT attribute, value, churned AS y, churn_probability AS p, CASE WHEN churn_probability >= 0.5 THEN 1 ELSE 0 END AS pred FROM (
  SELECT 'segment' AS attribute, segment AS value, churned, churn_probability FROM c360
  UNION ALL SELECT 'region', region, churned, churn_probability FROM c360
  UNION ALL SELECT 'contract_type', contract_type, churned, churn_probability FROM c360) AS u WHERE value IS NOT NULL)""", \
    """st AS (SELECT attribute, value, COUNT(*) AS n, AVG(pred) AS predicted_rate, AVG(p) AS avg_probability, AVG(y) AS actual_rate,
  COUNT(*) FILTER (WHERE pred = 1 AND y = 1) AS tp, COUNT(*) FILTER (WHERE y = 1) AS positives,
  COUNT(*) FILTER (WHERE pred = 1 AND y = 0) AS fp, COUNT(*) FILTER (WHERE y = 0) AS negatives,
  CAST(COUNT(*) FILTER (WHERE pred = 1 AND y = 1) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE y = 1), 0) AS tpr,
  CAST(COUNT(*) FILTER (WHERE pred = 1 AND y = 0) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE y = 0), 0) AS fpr
  FROM pr GROUP BY attribute, value)""", \
    """bc AS (SELECT attribute, CAST(SUM(n) AS BIGINT) AS n, MAX(predicted_rate) - MIN(predicted_rate) AS demographic_parity_diff,
  GREATEST(MAX(tpr) - MIN(tpr), MAX(fpr) - MIN(fpr)) AS equalized_odds_diff,
  MIN(predicted_rate) / NULLIF(MAX(predicted_rate), 0) AS disparate_impact_ratio FROM st GROUP BY attribute HAVING SUM(n) >= 50)""", \
    """bf AS (SELECT *, concat_ws(',', CASE WHEN ABS(demographic_parity_diff) > 0.10 THEN 'demographic_parity' END,
  CASE WHEN ABS(equalized_odds_diff) > 0.10 THEN 'equalized_odds' END,
  CASE WHEN disparate_impact_ratio < 0.80 THEN 'disparate_impact' END) AS failures FROM bc)"""


@register("segment_stats", rnd(with_c360("SELECT * FROM st", *PAIRS[:2]),
                               "predicted_rate,avg_probability,actual_rate,tpr,fpr"))
def q_segment_stats(spark, sf):
    return out(FA.segment_stats(c360(spark, sf), ATTRS, Y, P))


@register("demographic_parity", rnd(with_c360("SELECT attribute, MAX(predicted_rate) - MIN(predicted_rate) AS demographic_parity_diff FROM st GROUP BY attribute",
                                              *PAIRS[:2]), "demographic_parity_diff"))
def q_dp(spark, sf):
    return out(FA.demographic_parity(FA.segment_stats(c360(spark, sf), ATTRS, Y, P)))


@register("equalized_odds", rnd(with_c360("SELECT attribute, GREATEST(MAX(tpr) - MIN(tpr), MAX(fpr) - MIN(fpr)) AS equalized_odds_diff FROM st GROUP BY attribute",
                                          *PAIRS[:2]), "equalized_odds_diff"))
def q_eo(spark, sf):
    return out(FA.equalized_odds(FA.segment_stats(c360(spark, sf), ATTRS, Y, P)))


@register("disparate_impact", rnd(with_c360("SELECT attribute, MIN(predicted_rate) / NULLIF(MAX(predicted_rate), 0) AS disparate_impact_ratio FROM st GROUP BY attribute",
                                            *PAIRS[:2]), "disparate_impact_ratio"))
def q_di(spark, sf):
    return out(FA.disparate_impact(FA.segment_stats(c360(spark, sf), ATTRS, Y, P)))


@register("bias_check", rnd(with_c360("SELECT *, failures = '' AS passed FROM bf", *PAIRS),
                            "demographic_parity_diff,equalized_odds_diff,disparate_impact_ratio"), headline=True)
def q_bias(spark, sf):
    b = FA.bias_check(c360(spark, sf), ATTRS, Y, P)
    return out(b.withColumn("failures", F.array_join("failures", ",")))


@register("bias_summary", with_c360("""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE failures = '') AS passed, COUNT(*) FILTER (WHERE failures <> '') AS failed,
  COALESCE(string_agg(CASE WHEN failures <> '' THEN attribute END, ',' ORDER BY attribute), '') AS failed_attributes FROM bf""", *PAIRS))
def q_bias_summary(spark, sf):
    return FA.bias_summary(FA.bias_check(c360(spark, sf), ATTRS, Y, P))
