"""Sections 2.7-2.9 and 2.13 (perturbation): preparation, scoring, explanations, counterfactuals, robustness.

Operators that take a ``score_fn`` are checked against DuckDB with the deterministic scorecard
(its SQL twin is below); Spark ML fits are rows-only checks.
"""

from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators import explain as X
from churnlab.operators import frames as FR
from churnlab.operators import models as MD
from churnlab.operators import prep as PR
from churnlab.operators import robustness as RB
from churnlab.operators.models import CONTRACT_WEIGHT, DECLINE_AT, DECLINE_WEIGHT, LOGIT_WEIGHTS
from churnlab.plans.oracle import rnd, with_c360
from churnlab.plans.registry import out, register
from churnlab.sources.tables import customer360_table as customer360

NUM = fx.RAW_NUMERIC
SC_COLS = [c for c, _ in LOGIT_WEIGHTS]


def c360(spark, sf):
    return customer360(spark, sf)


def scorecard(spark, sf):
    d = c360(spark, sf)
    return d, MD.Scorecard.fit(d)


# ---- DuckDB twin of the scorecard -------------------------------------------------------------
def _decline(sub):
    u30, u90 = sub.get("usage_30d", "usage_30d"), sub.get("usage_90d", "usage_90d")
    return (f"CASE WHEN ({u90}) IS NULL OR ({u30}) IS NULL THEN NULL ELSE "
            f"LEAST(GREATEST((({u90}) - ({u30})) / GREATEST(({u90}), 1e-6), -2e0), 2e0) END")


def raw_sql(sub=None):
    """Scorecard logit without intercept; ``sub`` replaces column names by expressions."""
    sub = sub or {}
    g = lambda c: f"({sub.get(c, c)})"
    z = [f"{CONTRACT_WEIGHT!r} * COALESCE(CASE {g('contract_type')} WHEN 'Month-to-Month' THEN 1e0 WHEN 'One Year' THEN 0.4e0 "
         f"WHEN 'Two Year' THEN 0.1e0 END, 0e0)"]
    for c, w in LOGIT_WEIGHTS:
        z.append(f"{w!r} * COALESCE(({g(c)} - mm.mn_{c}) / ((mm.mx_{c} - mm.mn_{c}) + 1e-9), 0e0)")
    z.append(f"{DECLINE_WEIGHT!r} * COALESCE(CAST(({_decline(sub)}) >= {DECLINE_AT!r} AS DOUBLE), 0e0)")
    return " + ".join(z)


SC_MM = "mm AS (SELECT " + ", ".join(f"MIN({c}) AS mn_{c}, MAX({c}) AS mx_{c}" for c in SC_COLS) + " FROM c360)"
SC_IC = f"ic AS (SELECT LN(0.27e0 / (1e0 - 0.27e0)) - AVG({raw_sql()}) AS icpt FROM c360 CROSS JOIN mm)"


def p_sql(sub=None):
    return f"(1e0 / (1e0 + EXP(-(({raw_sql(sub)}) + ic.icpt))))"


SC_CTES = [SC_MM, SC_IC, f"sc AS (SELECT c360.*, {p_sql()} AS p FROM c360 CROSS JOIN mm CROSS JOIN ic)"]


@register("score", rnd(with_c360("""
SELECT customer_id, p AS churn_probability, CAST(p >= 0.5 AS INTEGER) AS predicted_churn,
  CASE WHEN p >= 0.85 THEN 'CRITICAL' WHEN p >= 0.70 THEN 'HIGH' WHEN p >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
  ROUND(GREATEST(0e0, (p + 1.645e0*1.645e0/(2e0*500)) / (1e0 + 1.645e0*1.645e0/500)
        - 1.645e0 * SQRT(p * (1e0 - p) / 500 + 1.645e0*1.645e0/(4e0*500*500)) / (1e0 + 1.645e0*1.645e0/500)), 4) AS ci_lower,
  ROUND(LEAST(1e0, (p + 1.645e0*1.645e0/(2e0*500)) / (1e0 + 1.645e0*1.645e0/500)
        + 1.645e0 * SQRT(p * (1e0 - p) / 500 + 1.645e0*1.645e0/(4e0*500*500)) / (1e0 + 1.645e0*1.645e0/500)), 4) AS ci_upper
FROM sc""", *SC_CTES), "churn_probability,ci_lower,ci_upper"), headline=True)
def q_score(spark, sf):
    d, sc = scorecard(spark, sf)
    s = MD.score(d, sc)
    return out(s.select("customer_id", "churn_probability", "predicted_churn", "risk_tier",
                        F.col("interval.lower").alias("ci_lower"), F.col("interval.upper").alias("ci_upper")))


@register("batch_score_tiers", rnd(with_c360("SELECT customer_id, p AS churn_probability FROM sc WHERE p >= 0.70", *SC_CTES),
                                   "churn_probability"))
def q_batch_tiers(spark, sf):
    d, sc = scorecard(spark, sf)
    return out(MD.batch_score_tiers(d, sc).select("customer_id", "churn_probability"))


@register("score_guard", rnd(with_c360("SELECT customer_id, p AS churn_probability FROM sc", *SC_CTES), "churn_probability"))
def q_score_guard(spark, sf):
    d, sc = scorecard(spark, sf)
    g = MD.score_guard(d, SC_COLS + ["contract_type", "usage_30d", "usage_90d"], {c: "double" for c in SC_COLS})
    return out(sc(g).select("customer_id", F.col("p").alias("churn_probability")))


# ---- attributions on the scorecard (exact, log-odds space) -----------------------------------------
def sc_terms(sc: MD.Scorecard) -> dict:
    t = {"contract_type": F.lit(CONTRACT_WEIGHT) * F.coalesce(
        F.when(F.col("contract_type") == "Month-to-Month", 1.0).when(F.col("contract_type") == "One Year", 0.4)
        .when(F.col("contract_type") == "Two Year", 0.1), F.lit(0.0))}
    for c, w in LOGIT_WEIGHTS:
        t[c] = F.lit(w) * F.coalesce((F.col(c) - F.lit(sc.mins[c])) / (F.lit(sc.maxs[c] - sc.mins[c]) + F.lit(1e-9)), F.lit(0.0))
    t["usage_decline"] = F.lit(DECLINE_WEIGHT) * F.coalesce((fx.usage_decline() >= DECLINE_AT).cast("double"), F.lit(0.0))
    return t


def _terms_sql():
    t = {"contract_type": f"{CONTRACT_WEIGHT!r} * COALESCE(CASE contract_type WHEN 'Month-to-Month' THEN 1e0 WHEN 'One Year' THEN 0.4e0 "
                          "WHEN 'Two Year' THEN 0.1e0 END, 0e0)"}
    for c, w in LOGIT_WEIGHTS:
        t[c] = f"{w!r} * COALESCE(({c} - mm.mn_{c}) / ((mm.mx_{c} - mm.mn_{c}) + 1e-9), 0e0)"
    t["usage_decline"] = f"{DECLINE_WEIGHT!r} * COALESCE(CAST(({_decline({})}) >= {DECLINE_AT!r} AS DOUBLE), 0e0)"
    return t


TERMS = _terms_sql()
ATTR_SQL = ["tw AS (SELECT customer_id, " + ", ".join(f"{e} AS t_{n}" for n, e in TERMS.items()) + " FROM c360 CROSS JOIN mm)",
            "tm AS (SELECT " + ", ".join(f"AVG(t_{n}) AS m_{n}" for n in TERMS) + " FROM tw)",
            "att AS (SELECT customer_id, feature, value FROM (SELECT customer_id, " + ", ".join(f"t_{n} - m_{n} AS {n}" for n in TERMS)
            + " FROM tw CROSS JOIN tm) UNPIVOT INCLUDE NULLS (value FOR feature IN (" + ", ".join(TERMS) + ")) AS u)"]


def linear_attr(spark, sf):
    d, sc = scorecard(spark, sf)
    return X.attrib_linear(d, sc_terms(sc))


@register("attrib_linear", rnd(with_c360("SELECT * FROM att", SC_MM, *ATTR_SQL), "value"))
def q_attr_lin(spark, sf):
    return out(linear_attr(spark, sf))


@register("global_importance", rnd(with_c360("""
SELECT feature, AVG(ABS(value)) AS mean_abs, CAST(RANK() OVER (ORDER BY AVG(ABS(value)) DESC, feature) AS INTEGER) AS rank
FROM att GROUP BY feature""", SC_MM, *ATTR_SQL), "mean_abs"))
def q_global_imp(spark, sf):
    return out(X.global_importance(linear_attr(spark, sf)))


@register("top_drivers", with_c360("""
SELECT customer_id,
  COALESCE(string_agg(CASE WHEN value > 0 AND rs <= 5 THEN feature END, ',' ORDER BY rs), '') AS top_positive,
  COALESCE(string_agg(CASE WHEN value < 0 AND rs <= 5 THEN feature END, ',' ORDER BY rs), '') AS top_negative,
  COALESCE(string_agg(CASE WHEN ra <= 5 THEN feature || CASE WHEN value >= 0 THEN '+' ELSE '-' END END, ',' ORDER BY ra), '') AS top_abs
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ABS(value) DESC, feature) AS ra,
  ROW_NUMBER() OVER (PARTITION BY customer_id, value > 0 ORDER BY ABS(value) DESC, feature) AS rs FROM att) AS r GROUP BY customer_id""",
    SC_MM, *ATTR_SQL))
def q_top_drivers(spark, sf):
    d, sc = scorecard(spark, sf)
    return X.top_drivers(X.attrib_rows(d, sc_terms(sc)))


_FEATS = list(TERMS)
_PAIRS = [(a, b) for i, a in enumerate(_FEATS) for b in _FEATS[i + 1:]]


@register("attrib_interactions", rnd(with_c360(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CORR(t_{a}, t_{b}) AS corr FROM tw" for a, b in _PAIRS), SC_MM, *ATTR_SQL[:1]),
    "corr"))
def q_interactions(spark, sf):
    r = X.attrib_interactions(linear_attr(spark, sf), top=10)
    # canonical pair order (the SQL lists pairs in feature-definition order)
    a_first = F.array_position(F.array(*[F.lit(f) for f in _FEATS]), F.col("feature_a")) < \
        F.array_position(F.array(*[F.lit(f) for f in _FEATS]), F.col("feature_b"))
    return out(r.select(F.when(a_first, F.col("feature_a")).otherwise(F.col("feature_b")).alias("feature_a"),
                        F.when(a_first, F.col("feature_b")).otherwise(F.col("feature_a")).alias("feature_b"), "corr"))


# ---- counterfactual rules on the scorecard ---------------------------------------------------------
def _cf_sql():
    parts = []
    for i, (f, dp, da, act, cost, effort, days) in enumerate(X.CATALOGUE_B):
        old = f"COALESCE(CAST({f} AS DOUBLE), 0e0)"
        new = f"({old} * (1e0 + {dp!r}))" if dp is not None else f"({old} + {da!r})"
        parts.append(f"SELECT customer_id, {i} AS move, '{f}' AS feature, '{act}' AS action, {cost!r}e0 AS cost_usd, {effort} AS effort, "
                     f"{days} AS days_to_effect, p AS p0, {p_sql({f: new})} AS p1, "
                     f"{('CAST(' + repr(-dp) + ' AS DOUBLE)') if f == 'monthly_charges' else 'CAST(NULL AS DOUBLE)'} AS discount_pct "
                     f"FROM sc CROSS JOIN mm CROSS JOIN ic")
    return ("cfr AS (SELECT customer_id, move, feature, action, cost_usd, effort, days_to_effect, p0 AS churn_probability, "
            "ROUND(p1, 4) AS new_churn_prob, ROUND(p0 - p1, 4) AS prob_reduction, discount_pct FROM ("
            + " UNION ALL ".join(parts) + ") AS x WHERE p0 - p1 > 0.02)")


CF_CTES = SC_CTES + [_cf_sql()]


def cf(spark, sf):
    d, sc = scorecard(spark, sf)
    return X.cf_rules(d, sc)


@register("cf_rules", rnd(with_c360("SELECT * FROM cfr", *CF_CTES), "churn_probability,new_churn_prob,prob_reduction,discount_pct"))
def q_cf_rules(spark, sf):
    return out(cf(spark, sf))


@register("cf_constraints", rnd(with_c360("SELECT * FROM cfr WHERE cost_usd <= 300 AND COALESCE(discount_pct, 0e0) <= 0.30", *CF_CTES),
                                "churn_probability,new_churn_prob,prob_reduction,discount_pct"))
def q_cf_constraints(spark, sf):
    return out(X.cf_constraints(cf(spark, sf)))


@register("cf_rank_feasibility", rnd(with_c360("""
SELECT customer_id, move, action, prob_reduction, feasibility_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY feasibility_score DESC, move) AS rank FROM (
    SELECT *, ROUND(prob_reduction / GREATEST(cost_usd, 1e0) / GREATEST(days_to_effect, 1) * 1000e0, 6) AS feasibility_score FROM cfr) AS a) AS b
WHERE rank <= 5""", *CF_CTES), "prob_reduction,feasibility_score"))
def q_cf_feas(spark, sf):
    r = X.cf_rank_feasibility(cf(spark, sf))
    return out(r.select("customer_id", "move", "action", "prob_reduction", "feasibility_score", "rank"))


@register("cf_rank_prob", rnd(with_c360("""
SELECT customer_id, move, new_churn_prob, cost_usd, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY new_churn_prob, cost_usd, move) AS rank FROM cfr) AS a WHERE rank <= 3""",
    *CF_CTES), "new_churn_prob,cost_usd"))
def q_cf_prob(spark, sf):
    r = X.cf_rank_prob(cf(spark, sf))
    return out(r.select("customer_id", "move", "new_churn_prob", "cost_usd", "rank"))


# ---- perturbation on the scorecard ---------------------------------------------------------------
PERT_COLS = NUM
PCTE = "sd AS (SELECT " + ", ".join(f"COALESCE(NULLIF(STDDEV_SAMP({c}), 0), 1e0) AS sd_{c}" for c in PERT_COLS) + " FROM {src})"


def _pert_sql(src, deltas):
    parts = [f"SELECT '{name}' AS variant, '{c}' AS feature, ABS({p_sql({c: f'{c} + ({mult!r}) * sd.sd_{c}'})} - {p_sql()}) AS shift "
             f"FROM {src} CROSS JOIN mm CROSS JOIN ic CROSS JOIN sd" for name, (c, mult) in deltas.items()]
    return " UNION ALL ".join(parts)


@register("perturb_sensitivity", rnd(with_c360(
    "SELECT feature, AVG(shift) AS sensitivity FROM (" + _pert_sql("c360", {c: (c, 0.10) for c in PERT_COLS}) + ") AS s GROUP BY feature",
    SC_MM, SC_IC, PCTE.format(src="c360")), "sensitivity"))
def q_sensitivity(spark, sf):
    d, sc = scorecard(spark, sf)
    return out(RB.perturb_sensitivity(d, PERT_COLS, sc))


_ADV = {f"{c}{s}": (c, m) for c in PERT_COLS for s, m in (("+", 2.0), ("-", -2.0))}


@register("perturb_adversarial", rnd(with_c360(
    "SELECT MAX(ms) AS adversarial_max_shift, arg_max(variant, ms) AS worst_move FROM (SELECT variant, AVG(shift) AS ms FROM ("
    + _pert_sql("pool", _ADV) + ") AS s GROUP BY variant) AS v",
    SC_MM, SC_IC, "pool AS (SELECT * FROM c360 WHERE churn_probability >= 0.3 AND churn_probability <= 0.7)", PCTE.format(src="pool")),
    "adversarial_max_shift"))
def q_adversarial(spark, sf):
    d, sc = scorecard(spark, sf)
    return out(RB.adversarial(d, PERT_COLS, sc))


@register("perturb_noise_stability")
def q_noise(spark, sf):
    d, sc = scorecard(spark, sf)
    return out(RB.noise_stability(d, PERT_COLS, sc))


@register("robustness_report")
def q_robust(spark, sf):
    d, sc = scorecard(spark, sf)
    return RB.robustness_report(d, PERT_COLS, sc)


# ---- preparation ----------------------------------------------------------------------------------
def _q(c, p):
    return f"quantile_cont({c}, {p})"


@register("iqr_cap", rnd(with_c360(
    "SELECT customer_id, " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE LEAST(GREATEST({c}, q.lo_{c}), q.hi_{c}) END AS {c}" for c in NUM)
    + " FROM c360 CROSS JOIN q", "q AS (SELECT " + ", ".join(
        f"{_q(c, 0.25)} - 1.5e0 * ({_q(c, 0.75)} - {_q(c, 0.25)}) AS lo_{c}, {_q(c, 0.75)} + 1.5e0 * ({_q(c, 0.75)} - {_q(c, 0.25)}) AS hi_{c}"
        for c in NUM) + " FROM c360)"), NUM))
def q_iqr(spark, sf):
    d = c360(spark, sf).select("customer_id", *NUM)
    return out(PR.IQRCapper(inputCols=NUM).fit(d).transform(d))


@register("impute_median", rnd(with_c360(
    "SELECT customer_id, " + ", ".join(f"COALESCE({c}, q.m_{c}) AS {c}" for c in NUM) + " FROM c360 CROSS JOIN q",
    "q AS (SELECT " + ", ".join(f"{_q(c, 0.5)} AS m_{c}" for c in NUM) + " FROM c360)"), NUM))
def q_impute(spark, sf):
    d = c360(spark, sf).select("customer_id", *NUM)
    return out(PR.MedianImputer(inputCols=NUM).fit(d).transform(d))


@register("robust_scale", rnd(with_c360(
    "SELECT customer_id, " + ", ".join(f"({c} - q.m_{c}) / CASE WHEN q.i_{c} = 0 THEN 1e0 ELSE q.i_{c} END AS {c}" for c in NUM)
    + " FROM c360 CROSS JOIN q",
    "q AS (SELECT " + ", ".join(f"{_q(c, 0.5)} AS m_{c}, {_q(c, 0.75)} - {_q(c, 0.25)} AS i_{c}" for c in NUM) + " FROM c360)"), NUM))
def q_scale(spark, sf):
    d = c360(spark, sf).select("customer_id", *NUM)
    return out(PR.IQRScaler(inputCols=NUM).fit(d).transform(d))


_OH = {"contract_type": ["One Year", "Two Year"], "plan_tier": ["Premium", "Standard"],
       "payment_method": ["Credit Card", "Electronic Check", "Mailed Check"]}


@register("one_hot", with_c360("SELECT customer_id, " + ", ".join(
    f"CASE WHEN {c} = '{v}' THEN 1e0 ELSE 0e0 END AS {c}_{v.replace(' ', '_').replace('-', '_')}" for c, vs in _OH.items() for v in vs)
    + " FROM c360"))
def q_onehot(spark, sf):
    d = c360(spark, sf).select("customer_id", *fx.CATEGORICAL)
    m = PR.OneHotDropFirst(inputCols=fx.CATEGORICAL).fit(d)
    return m.transform(d).select("customer_id", *m.outputCols())


@register("class_weights", rnd(with_c360("""
SELECT customer_id, churned, n / (2e0 * nc) AS weight FROM c360 JOIN (SELECT churned AS y, COUNT(*) AS nc FROM c360 GROUP BY 1) AS k ON c360.churned = k.y
CROSS JOIN (SELECT COUNT(*) AS n FROM c360) AS t"""), "weight"))
def q_weights(spark, sf):
    return out(PR.class_weights(c360(spark, sf).select("customer_id", "churned"), "churned"))
