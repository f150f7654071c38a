"""Literal edge frames (FIXTURES section 5) for the row expressions."""

from pyspark.sql import functions as F

from churnlab.functions import features as fx


def col_values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_tenure_bins(spark):
    vals = [0.0, 6.0, 7.0, 12.0, 13.0, 24.0, 48.0, 49.0, 85.0, 86.0, None]
    got = col_values(spark, [(v,) for v in vals], "tenure_months double", fx.tenure_bin())
    assert got == [0, 0, 1, 1, 2, 2, 3, 4, 4, None, None]


def test_nps_segment(spark):
    vals = [-101.0, -100.0, 0.0, 1.0, 50.0, 51.0, 100.0, 101.0, 102.0]
    got = col_values(spark, [(v,) for v in vals], "nps_score double", fx.nps_segment())
    assert got == [None, 0, 0, 1, 1, 2, 2, 2, None]


def test_risk_tier(spark):
    vals = [0.3999, 0.40, 0.6999, 0.70, 0.8499, 0.85]
    got = col_values(spark, [(v,) for v in vals], "churn_probability double", fx.risk_tier())
    assert got == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]


def test_ab_bucket_reference_value(spark):
    got = col_values(spark, [("C-4821",)], "id string", fx.ab_bucket(F.col("id"), "retention_v1"))
    assert got == [35]
    arm = col_values(spark, [("C-4821",)], "id string", fx.ab_assign(F.col("id"), "retention_v1", 0.5))
    assert arm == ["treatment"]


def test_clip_keeps_null(spark):
    got = col_values(spark, [(None, 5.0), (10.0, 1.0)], "usage_30d double, usage_90d double", fx.usage_decline())
    assert got[0] is None and got[1] == -2.0


def test_title_case_matches_python(spark):
    words = ["usage_30d", "feature_adoption_rate", "nps score", "a-b_c"]
    got = col_values(spark, [(w,) for w in words], "w string", fx.humanise(F.col("w")))
    assert got == [w.replace("_", " ").title() for w in words]


def test_clean_condition(spark):
    conds = ["0.50 < feature_adoption_rate <= 0.80", "usage_30d > 3", "tenure <= 12"]
    got = col_values(spark, [(c,) for c in conds], "c string", fx.clean_condition(F.col("c")))
    assert got == ["Feature Adoption Rate", "usage_30d > 3", "tenure <= 12"]


def test_action_type_first_match(spark):
    labels = ["Proactive support outreach", "Offer a discount", "Annual upgrade", "Open ticket review", "Say hi"]
    got = col_values(spark, [(x,) for x in labels], "l string", fx.action_type(F.col("l")))
    assert got == ["csm_assignment", "price_reduction", "loyalty_upgrade", "support_outreach", "engagement_campaign"]


def test_wilson_width_never_uncertain_at_n500(spark):
    ci = fx.wilson_interval(F.col("p"), digits=None)
    got = col_values(spark, [(x / 20.0,) for x in range(21)], "p double", fx.is_uncertain_width(ci))
    assert not any(got)


def test_profile_text_half_even_and_nan(spark):
    df = spark.createDataFrame([("Month-to-Month", "Basic", 12.0, 12.5, None, 13.5, 0.125, -0.3, None)],
                               "contract_type string, plan_tier string, tenure_months double, monthly_charges double, "
                               "num_support_tickets_30d double, login_frequency_30d double, feature_adoption_rate double, "
                               "nps_score double, days_since_last_login double")
    got = df.select(fx.profile_text()).first()[0]
    expect = (f"Contract: Month-to-Month | Plan: Basic | Tenure: 12.0 months | Charges: ${12.5:.0f}/month | Tickets: nan in 30d | "
              f"Login freq: {13.5:.0f}/30d | Feature adoption: {0.125:.0%} | NPS: {-0.3:.0f} | Days since login: nan")
    assert got == expect
