"""The whole retention flow for a customer table as one DAG of DataFrames.

quality -> score -> tier (LOW stops) -> drivers -> counterfactual moves -> per-customer plan
-> decision (CRITICAL waits for a human, HIGH is approved with an alert, MEDIUM passes).
Every step is a column expression on the scored row; only the best move (a top-1 over scored
variants) comes back by a join;
routing is a filter, and the branches are unioned at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators import decide as D
from churnlab.operators import explain as X
from churnlab.operators import quality as Q
from churnlab.session import cut_lineage


def retention_run(customers: DataFrame, score_fn, explain, catalogue: list[tuple[str, float, float]],
                  budget: float = 300.0, experiment: str = "retention_v1", key: str = "customer_id") -> DataFrame:
    """``score_fn``: df -> df with p (a scorecard or a fitted model); ``explain``: df -> df with the row's attributions."""
    v = Q.validate_rows(customers, Q.INFERENCE_RULES)
    bad = v.filter(~F.col("valid")).select(key, F.lit(None).cast("double").alias("churn_probability"), F.lit(None).cast("string").alias("risk_tier"),
                                           F.lit("quarantined").alias("decision"), F.array_join("broken", ",").alias("notes"))
    ok = v.filter(F.col("valid")).drop("broken", "valid")
    scored = cut_lineage(score_fn(ok).withColumn("risk_tier", fx.risk_tier(F.col("p"))))  # scored once; what follows reads it
    low = scored.filter(F.col("risk_tier") == "LOW").select(key, F.col("p").alias("churn_probability"), "risk_tier",
                                                            F.lit("no_action").alias("decision"), F.lit(None).cast("string").alias("notes"))
    act = scored.filter(F.col("risk_tier") != "LOW")
    cf = X.cf_rank_feasibility(X.cf_constraints(X.cf_rules(act, score_fn)), k=1).select(key, F.col("action").alias("best_move"))
    # drivers and plan are worked out inside the row
    rows = X.top_drivers(explain(act), k=3, key=key, carry=["p", "risk_tier", "monthly_charges"])
    rows = D.with_knapsack(rows, catalogue, fx.clv_24m(None, "monthly_charges"), budget)
    plan = F.col("plan")
    rows = rows.select(key, F.col("p").alias("churn_probability"), "risk_tier", F.col("top_abs").alias("drivers"),
                       F.array_join(plan["actions"], ",").alias("plan"), plan["total_cost"].alias("total_cost"), plan["total_value"].alias("total_value"),
                       F.when(plan.isNotNull(), D.plan_confidence(F.col("p"), plan["total_reduction"], plan["n_actions"])).alias("confidence"),
                       fx.ab_assign(F.col(key), experiment).alias("ab_group"))
    decided = (rows.join(cf, key, "left")
               .withColumn("decision", F.when(F.col("risk_tier") == "CRITICAL", "pending_approval")
                           .when(F.col("risk_tier") == "HIGH", "auto_approved_alert").otherwise("auto_approved"))
               .withColumn("status", F.when(F.col("decision") == "pending_approval", "waiting")
                           .when(F.col("ab_group") == "treatment", "scheduled").otherwise("control_holdout")))
    return decided.unionByName(low.unionByName(bad), allowMissingColumns=True)
