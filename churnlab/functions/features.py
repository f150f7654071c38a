"""Per-row column expressions (no shuffle, stay inside whole-stage codegen).

Every function takes ``Column``s (or names) and returns a ``Column``.  Null
inputs give null outputs unless a rule says otherwise; note that Spark's
``greatest``/``least`` skip nulls, so clipping goes through :func:`clip`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "col_", "clip", "usage_decline", "usage_slope", "support_flag", "charge_per_month", "charge_anomaly",
    "tenure_bin", "tenure_bucket", "login_trend", "nps_segment", "risk_tier", "risk_label3",
    "risk_tier_by_charge", "risk_score_heuristic", "clv_annual", "clv_24m", "wilson_interval",
    "is_uncertain_width", "missing_pct", "profile_text", "interaction_text", "narrative_template",
    "humanise", "clean_condition", "action_type", "normalise_action_type", "dispatch_status",
    "churn_hints", "anonymised_id", "add_features", "RAW_NUMERIC", "DERIVED", "CATEGORICAL",
    "FEATURES", "title_case", "ab_bucket", "ab_assign", "VALID_ACTION_TYPES",
]

# Fixed values that must equal the reference's for the same results:
# feature list = 12 raw numeric + 8 derived + 3 categorical columns.
RAW_NUMERIC = [
    "age", "tenure_months", "monthly_charges", "total_charges", "num_support_tickets_30d",
    "login_frequency_30d", "feature_adoption_rate", "nps_score", "usage_30d", "usage_60d",
    "usage_90d", "days_since_last_login",
]
DERIVED = [
    "usage_decline_rate", "usage_trend_slope", "support_escalation_flag", "charge_per_month_normalised",
    "charge_anomaly", "tenure_bin", "login_trend", "nps_segment",
]
CATEGORICAL = ["contract_type", "plan_tier", "payment_method"]
FEATURES = RAW_NUMERIC + DERIVED


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x, lo=None, hi=None) -> Column:
    """pandas-style clip: null stays null (Spark greatest/least would skip it)."""
    x = col_(x)
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(y)


def usage_decline(u30="usage_30d", u90="usage_90d") -> Column:
    u30, u90 = col_(u30), col_(u90)
    return clip((u90 - u30) / clip(u90, lo=1e-6), -2.0, 2.0)


def usage_slope(u30="usage_30d", u90="usage_90d") -> Column:
    return (col_(u30) - col_(u90)) / F.lit(60.0)


def support_flag(tickets="num_support_tickets_30d", at: float = 5) -> Column:
    # null >= 5 is false in the reference (NaN comparison), so null -> 0
    return F.when(col_(tickets) >= F.lit(at), 1).otherwise(0)


def charge_per_month(monthly="monthly_charges", tenure="tenure_months") -> Column:
    return col_(monthly) / (col_(tenure) + F.lit(1.0))


def charge_anomaly(total="total_charges", monthly="monthly_charges", tenure="tenure_months") -> Column:
    expected = col_(monthly) * col_(tenure)
    return clip((col_(total) - expected) / clip(expected, lo=1e-6), -3.0, 3.0)


def tenure_bin(tenure="tenure_months") -> Column:
    # right-closed bins [0,6], (6,12], (12,24], (24,48], (48,85]; outside -> null
    t = col_(tenure)
    return (
        F.when((t >= 0) & (t <= 6), 0.0).when((t > 6) & (t <= 12), 1.0).when((t > 12) & (t <= 24), 2.0)
        .when((t > 24) & (t <= 48), 3.0).when((t > 48) & (t <= 85), 4.0)
    )


def tenure_bucket(tenure="tenure_months") -> Column:
    # deviation: tenure 0 is labelled "0-12m" instead of the string "nan"
    t = col_(tenure)
    return (
        F.when((t >= 0) & (t <= 12), "0-12m").when((t > 12) & (t <= 36), "13-36m")
        .when((t > 36) & (t <= 72), "37-72m").when((t > 72) & (t <= 9999), "73m+")
    )


def login_trend(logins="login_frequency_30d", days="days_since_last_login") -> Column:
    return col_(logins) / (clip(days, lo=1.0) + F.lit(1.0))


def nps_segment(nps="nps_score") -> Column:
    n = col_(nps)
    return F.when((n > -101) & (n <= 0), 0.0).when((n > 0) & (n <= 50), 1.0).when((n > 50) & (n <= 101), 2.0)


def risk_tier(p="churn_probability") -> Column:
    p = col_(p)
    return F.when(p >= 0.85, "CRITICAL").when(p >= 0.70, "HIGH").when(p >= 0.40, "MEDIUM").otherwise("LOW")


def risk_label3(p="churn_probability") -> Column:
    p = col_(p)
    return F.when(p >= 0.70, "HIGH").when(p >= 0.40, "MEDIUM").otherwise("LOW")


def risk_tier_by_charge(monthly="monthly_charges") -> Column:
    m = col_(monthly)
    return F.when(m >= 90, "CRITICAL").when(m >= 70, "HIGH").when(m >= 40, "MEDIUM").otherwise("LOW")


def risk_score_heuristic(monthly="monthly_charges", tenure="tenure_months", tickets="num_support_tickets_30d",
                         adoption="feature_adoption_rate", nps="nps_score") -> Column:
    m, t, tk, ad, n = map(col_, (monthly, tenure, tickets, adoption, nps))
    m, t = F.coalesce(m, F.lit(0.0)), F.coalesce(t, F.lit(0.0))  # JS: null / 120 == 0
    s = (
        F.least(m / 120.0, F.lit(1.0)) * 30.0
        + F.greatest(F.lit(0.0), 1.0 - t / 60.0) * 20.0
        + F.when(tk.isNotNull() & (tk != 0), F.least(tk / 10.0, F.lit(1.0)) * 25.0).otherwise(0.0)
        + F.when(ad.isNotNull(), (1.0 - ad) * 15.0).otherwise(0.0)
        + F.when(n.isNotNull(), F.greatest(F.lit(0.0), (5.0 - n) / 10.0) * 10.0).otherwise(0.0)
    )
    # Math.round is half-up; Spark round is half-up for positive values
    return F.least(F.round(s, 0), F.lit(99.0))


def clv_annual(monthly="monthly_charges") -> Column:
    m = col_(monthly)
    return F.round(F.coalesce(F.nullif(m, F.lit(0.0)), F.lit(50.0)) * 12.0, 2)


def clv_24m(clv=None, monthly="monthly_charges") -> Column:
    m = F.coalesce(col_(monthly), F.lit(80.0)) * 24.0
    return m if clv is None else F.coalesce(col_(clv), m)


def wilson_interval(p="churn_probability", n: int = 500, z: float = 1.645, digits: int | None = 4) -> Column:
    """Wilson score interval as struct<lower, upper>, clipped to [0, 1]."""
    p = col_(p)
    z2 = z * z
    denom = 1.0 + z2 / n
    centre = (p + z2 / (2.0 * n)) / denom
    margin = z * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / denom
    lo = F.greatest(F.lit(0.0), centre - margin)
    hi = F.least(F.lit(1.0), centre + margin)
    if digits is not None:
        lo, hi = F.round(lo, digits), F.round(hi, digits)
    return F.struct(lo.alias("lower"), hi.alias("upper"))


def is_uncertain_width(ci, max_width: float = 0.25) -> Column:
    ci = col_(ci)
    return (ci["upper"] - ci["lower"]) > F.lit(max_width)


def missing_pct(*cols) -> Column:
    """Share of null fields in the row, 4 dp (NaN is turned into null on read)."""
    n = len(cols)
    missing = sum(col_(c).isNull().cast("int") for c in cols)
    return F.round(missing / F.lit(float(max(n, 1))), 4)


def _fmt0(c: Column) -> Column:
    """Python "{:.0f}": half-to-even (``bround``), and NaN/null prints as "nan"."""
    tie = (c - F.floor(c)) == F.lit(0.5)
    return (F.when(c.isNull(), F.lit("nan"))
            .when(tie, F.format_string("%.0f", F.bround(c, 0)))
            .otherwise(F.format_string("%.0f", c)))


def _num_str(c: Column) -> Column:
    """Python f"{x}" of a float: "12.0"; NaN/null -> "nan"."""
    return F.coalesce(c.cast("double").cast("string"), F.lit("nan"))


def profile_text(df_cols: dict | None = None) -> Column:
    g = (lambda name: col_((df_cols or {}).get(name, name)))
    parts = [
        F.concat(F.lit("Contract: "), F.coalesce(g("contract_type"), F.lit("unknown"))),
        F.concat(F.lit("Plan: "), F.coalesce(g("plan_tier"), F.lit("unknown"))),
        F.concat(F.lit("Tenure: "), _num_str(g("tenure_months")), F.lit(" months")),
        F.concat(F.lit("Charges: $"), _fmt0(g("monthly_charges")), F.lit("/month")),
        F.concat(F.lit("Tickets: "), _num_str(g("num_support_tickets_30d")), F.lit(" in 30d")),
        F.concat(F.lit("Login freq: "), _fmt0(g("login_frequency_30d")), F.lit("/30d")),
        F.concat(F.lit("Feature adoption: "), _fmt0(g("feature_adoption_rate") * 100.0), F.lit("%")),
        F.concat(F.lit("NPS: "), _fmt0(g("nps_score"))),
        F.concat(F.lit("Days since login: "), _num_str(g("days_since_last_login"))),
    ]
    return F.concat_ws(" | ", *parts)


def interaction_text(customer_id="customer_id", p="churn_probability", tier="risk_tier",
                     action=None, outcome=None, drivers=None) -> Column:
    """"Customer X. churn probability 87%. risk tier HIGH. action: ... outcome: ... top drivers: a, b, c"."""
    parts = [
        F.concat(F.lit("Customer "), col_(customer_id).cast("string")),
        F.concat(F.lit("churn probability "), _fmt0(col_(p) * 100.0), F.lit("%")),
        F.concat(F.lit("risk tier "), F.coalesce(col_(tier), F.lit("unknown"))),
        F.concat(F.lit("action: "), F.lit("none") if action is None else F.coalesce(col_(action), F.lit("none"))),
        F.concat(F.lit("outcome: "), F.lit("pending") if outcome is None else F.coalesce(col_(outcome), F.lit("pending"))),
    ]
    if drivers is not None:
        top = F.slice(col_(drivers), 1, 3)
        parts.append(F.when(F.size(top) > 0, F.concat(F.lit("top drivers: "), F.array_join(top, ", "))))
    return F.concat_ws(". ", *parts)


def narrative_template(p="churn_probability", drivers_up=None, drivers_down=None, actions=None) -> Column:
    """Risk sentence + up to three drivers each way + numbered actions.

    ``drivers_*``: array<string> of feature names; ``actions``: array<struct<label, reduction, cost>>.
    """
    pc = col_(p)
    s = [F.format_string("This customer has a %s churn risk of %.0f%%.", F.lower(risk_label3(pc)), pc * 100.0)]
    if drivers_up is not None:
        up = F.slice(col_(drivers_up), 1, 3)
        s.append(F.when(F.size(up) > 0, F.concat(F.lit("Main factors increasing risk: "),
                                                  F.array_join(F.transform(up, humanise), ", "), F.lit("."))))
    if drivers_down is not None:
        dn = F.slice(col_(drivers_down), 1, 3)
        s.append(F.when(F.size(dn) > 0, F.concat(F.lit("Factors reducing risk: "),
                                                  F.array_join(F.transform(dn, humanise), ", "), F.lit("."))))
    if actions is not None:
        acts = F.transform(col_(actions), lambda a, i: F.format_string(
            "%d. %s (-%.0f%% churn risk, $%.0f)", i + 1, a["label"], a["reduction"] * 100.0, a["cost"]))
        s.append(F.when(F.size(acts) > 0, F.concat(F.lit("Recommended actions: "), F.array_join(acts, " "))))
    return F.concat_ws(" ", *s)


def title_case(s) -> Column:
    """Python ``str.title`` for ASCII: capitalise the first letter of every run of letters."""
    toks = F.regexp_extract_all(col_(s), F.lit("[A-Za-z]+|[^A-Za-z]+"), 0)
    return F.array_join(
        F.transform(toks, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def humanise(c) -> Column:
    return title_case(F.replace(col_(c), F.lit("_"), F.lit(" ")))


def clean_condition(c) -> Column:
    """First whitespace token that has "_" and no digit -> Title Case; else the input unchanged."""
    c = col_(c)
    toks = F.filter(F.split(F.trim(c), r"\s+"), lambda t: t.contains("_") & ~t.rlike("[0-9]"))
    first = F.get(toks, 0)
    return F.when(first.isNotNull(), humanise(first)).otherwise(c)


def action_type(label) -> Column:
    """Keyword map, first match wins."""
    s = F.lower(col_(label))

    def has(*words):
        cond = F.lit(False)
        for w in words:
            cond = cond | s.contains(w)
        return cond

    return (
        F.when(has("price", "discount"), "price_reduction")
        .when(has("csm", "onboarding", "support"), "csm_assignment")
        .when(has("loyalty", "upgrade", "annual"), "loyalty_upgrade")
        .when(has("outreach", "ticket"), "support_outreach")
        .otherwise("engagement_campaign")
    )


# The five CRM action types.
VALID_ACTION_TYPES = ["price_reduction", "csm_assignment", "loyalty_upgrade", "support_outreach", "engagement_campaign"]


def normalise_action_type(c) -> Column:
    n = F.translate(F.lower(col_(c)), " -", "__")
    return F.when(n.isin(*VALID_ACTION_TYPES), n).otherwise(F.lit("engagement_campaign"))


def dispatch_status(arm) -> Column:
    a = col_(arm)
    return F.struct(
        F.when(a == "treatment", "scheduled").otherwise("control_holdout").alias("status"),
        (F.coalesce(a, F.lit("")) == "treatment").alias("dispatched"),
    )


def churn_hints(monthly="monthly_charges", adoption="feature_adoption_rate", contract="contract_type") -> Column:
    # reference defaults: missing charge -> 0, missing adoption -> 1 (no hint)
    return F.array_compact(F.array(
        F.when(F.coalesce(col_(monthly), F.lit(0.0)) > 80, F.lit("a price reduction could meaningfully lower churn risk")),
        F.when(F.coalesce(col_(adoption), F.lit(1.0)) < 0.4,
               F.lit("improving feature adoption through onboarding support may help")),
        F.when(col_(contract) == "Month-to-Month", F.lit("upgrading to an annual contract would reduce churn risk")),
    ))


def anonymised_id(c) -> Column:
    return F.substring(F.sha2(col_(c).cast("string"), 256), 1, 16)


def add_features(df: DataFrame) -> DataFrame:
    """All derived features in one projection (single stage, no shuffle)."""
    return df.withColumns({
        "usage_decline_rate": usage_decline(),
        "usage_trend_slope": usage_slope(),
        "support_escalation_flag": support_flag(),
        "charge_per_month_normalised": charge_per_month(),
        "charge_anomaly": charge_anomaly(),
        "tenure_bin": tenure_bin(),
        "login_trend": login_trend(),
        "nps_segment": nps_segment(),
    })


def ab_bucket(key, experiment: str) -> Column:
    """int(md5("experiment:key"), 16) % 100, computed on four 32-bit hex chunks (2**32 % 100 == 96)."""
    h = F.md5(F.concat(F.lit(f"{experiment}:"), col_(key).cast("string")))
    b = F.lit(0).cast("bigint")
    for i in range(4):
        chunk = F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")
        b = (b * 96 + chunk) % 100
    return b


def ab_assign(key, experiment: str, share: float = 0.5) -> Column:
    """Deterministic arm: treatment iff bucket / 100 < share; stable across runs and partitionings."""
    return F.when(ab_bucket(key, experiment) / F.lit(100.0) < F.lit(share), "treatment").otherwise("control")
