"""Model-quality and dataset metrics as grouped aggregates.

Global orderings (AUC, AP, curves, lift) never sort raw rows in one task:
rows are first reduced to distinct scores (partial aggregation on the map
side), then the bounded score table gets its prefix sums (see
:mod:`churnlab.operators.prefix`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.functions.features import risk_tier_by_charge


def label_rate(df: DataFrame, y: str, by=(), with_total: bool = False) -> DataFrame:
    by = list(by)
    agg = [F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("label_rate")]
    res = df.groupBy(*by).agg(*agg)
    if with_total and by:
        tot = df.agg(*agg).select(*[F.lit("__all__").alias(b) for b in by], "n", "label_rate")
        res = res.unionByName(tot)
    return res


def dataset_kpis(df: DataFrame, y: str, charge: str, by=(), top: int = 10, watch: int = 20) -> DataFrame:
    """total, churned, churn rate %, revenue at risk (sum of the top charges on the churned watch list)
    and charge tiers on the watch list, per group.

    The watch list is a top-k per group: ``row_number() <= k`` lets Spark apply
    its window group limit before the shuffle, so a hot group ships k rows per
    partition, never all of its rows.
    """
    by = list(by)
    t = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col(y)).cast("bigint").alias("churned"),
        (F.lit(100.0) * F.sum(F.col(y)) / F.count(F.lit(1))).alias("churn_rate_pct"),
    )
    w = Window.partitionBy(*by).orderBy(F.col(charge).desc(), F.col("customer_id"))
    wl = (df.filter(F.col(y) == 1).select(*by, "customer_id", charge)
          .withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= watch))
    tier = risk_tier_by_charge(F.col(charge))
    k = wl.groupBy(*by).agg(
        F.sum(F.when(F.col("rk") <= top, F.col(charge)).otherwise(0.0)).alias("revenue_at_risk"),
        F.count_if(tier == "CRITICAL").cast("bigint").alias("watch_critical"),
        F.count_if(tier == "HIGH").cast("bigint").alias("watch_high"),
    )
    return t.join(k, by, "left")


# ---------------------------------------------------------------------------------------------
# score-ordered metrics: reduce to distinct scores, then prefix sums (P1)
# ---------------------------------------------------------------------------------------------
from churnlab.operators.prefix import prefix_sum  # noqa: E402


def score_counts(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    """One row per (group, distinct score): positives and negatives.  Partial aggregation runs map-side."""
    yy = F.col(y).cast("long")
    return df.groupBy(*by, F.col(p).alias("score")).agg(
        F.sum(yy).alias("pos"), F.sum(F.lit(1) - yy).alias("neg"))


def auc_roc(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    """Mann-Whitney AUC with tie averaging; null if a group lacks positives or negatives."""
    by = list(by)
    c = prefix_sum(score_counts(df, y, p, by), "score", ["neg"], by=by)
    return c.groupBy(*by).agg(F.try_divide(
        F.sum(F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") * 0.5)),
        F.sum("pos").cast("double") * F.sum("neg")).alias("auc_roc"))


def roc_pr_curve(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    """(threshold, tp, fp, precision, recall, fpr, tpr) per distinct score, thresholds descending."""
    by = list(by)
    j = prefix_sum(score_counts(df, y, p, by), "score", ["pos", "neg"], by=by, descending=True, totals=True) \
        .withColumnRenamed("tot_pos", "P").withColumnRenamed("tot_neg", "N")
    return j.select(
        *by, F.col("score").alias("threshold"), F.col("pos"), F.col("neg"),
        F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), F.col("P"), F.col("N"),
        F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.try_divide(F.col("cum_pos"), F.col("P").cast("double")).alias("recall"),
        F.try_divide(F.col("cum_neg"), F.col("N").cast("double")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("P").cast("double")).alias("tpr"),
    )


def avg_precision(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    """AP = sum over distinct thresholds (descending) of (R_k - R_k-1) * P_k."""
    by = list(by)
    cur = roc_pr_curve(df, y, p, by)
    return cur.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("P").cast("double"))
                                .alias("avg_precision"))


def optimal_threshold(curve: DataFrame, metric: str = "f1", by=()) -> DataFrame:
    """Threshold maximising f1 / precision / recall (PR curve, lowest threshold wins ties)
    or gmean = sqrt(tpr (1 - fpr)) (ROC curve, highest threshold wins ties)."""
    by = list(by)
    if metric == "gmean":
        v = F.sqrt(F.col("tpr") * (F.lit(1.0) - F.col("fpr")))
        c = curve.withColumn("_v", v)
        return c.groupBy(*by).agg(F.max_by("threshold", F.struct(F.col("_v"), F.col("threshold"))).alias("threshold"),
                                  F.max("_v").alias("value"))
    # the PR curve stops at the first threshold that reaches full recall
    pr = curve.filter((F.col("tp") - F.col("pos")) < F.col("P"))
    if metric == "f1":
        v = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-9))
    elif metric in ("precision", "recall"):
        v = F.col(metric)
    else:
        raise ValueError(metric)
    c = pr.withColumn("_v", v)
    return c.groupBy(*by).agg(F.max_by("threshold", F.struct(F.col("_v"), -F.col("threshold"))).alias("threshold"),
                              F.max("_v").alias("value"))


def lift_curve(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    """Cumulative lift per distinct score (descending): share of positives / share of population."""
    by = list(by)
    cnt = df.groupBy(*by, F.col(p).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"),
                                                         F.count(F.lit(1)).alias("rows"))
    j = prefix_sum(cnt, "score", ["pos", "rows"], by=by, descending=True, totals=True) \
        .withColumnRenamed("tot_pos", "_pos_total").withColumnRenamed("tot_rows", "_rows_total")
    pop = F.col("cum_rows") / F.col("_rows_total")
    share = F.try_divide(F.col("cum_pos"), F.col("_pos_total").cast("double"))
    return j.select(*by, F.col("score").alias("threshold"), pop.alias("population_pct"),
                    share.alias("cumulative_churn"), F.try_divide(share, pop).alias("lift"))


# ---------------------------------------------------------------------------------------------
# threshold metrics: one pass of conditional counts
# ---------------------------------------------------------------------------------------------
def confusion(df: DataFrame, y: str, p: str, threshold: float = 0.5, by=()) -> DataFrame:
    yy, pred = F.col(y) == 1, F.col(p) >= F.lit(threshold)
    return df.groupBy(*by).agg(
        F.count_if(pred & yy).alias("tp"), F.count_if(pred & ~yy).alias("fp"),
        F.count_if(~pred & ~yy).alias("tn"), F.count_if(~pred & yy).alias("fn"))


def clf_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5, by=()) -> DataFrame:
    eps = 2.220446049250313e-16  # float64 machine epsilon (log-loss clip)
    yy, pc = F.col(y).cast("double"), F.col(p)
    pcl = F.least(F.greatest(pc, F.lit(eps)), F.lit(1 - eps))
    base = df.groupBy(*by).agg(
        F.count_if((pc >= threshold) & (F.col(y) == 1)).alias("tp"),
        F.count_if((pc >= threshold) & (F.col(y) != 1)).alias("fp"),
        F.count_if((pc < threshold) & (F.col(y) != 1)).alias("tn"),
        F.count_if((pc < threshold) & (F.col(y) == 1)).alias("fn"),
        F.avg((pc - yy) * (pc - yy)).alias("brier_score"),
        F.avg(-(yy * F.log(pcl) + (F.lit(1.0) - yy) * F.log(F.lit(1.0) - pcl))).alias("log_loss"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))

    def f1(a, b, c):  # 2a / (2a + b + c), 0 when undefined
        return F.coalesce(F.try_divide(2 * a, 2 * a + b + c), F.lit(0.0))

    return base.select(
        *by, "tp", "fp", "tn", "fn", "brier_score", "log_loss",
        (tp / (tp + fp + F.lit(1e-9))).alias("precision"),
        (tp / (tp + fn + F.lit(1e-9))).alias("recall"),
        (tn / (tn + fp + F.lit(1e-9))).alias("specificity"),
        f1(tp, fp, fn).alias("f1_positive"),
        ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2.0).alias("f1_macro"),
    )


# ---------------------------------------------------------------------------------------------
# calibration
# ---------------------------------------------------------------------------------------------
def calibration_bins(df: DataFrame, y: str, p: str, n_bins: int = 10, by=()) -> DataFrame:
    """Equal-width bins [lo, hi), the last one closed; empty bins are absent."""
    b = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(p)).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def calibration_ece(df: DataFrame, y: str, p: str, n_bins: int = 10, by=()) -> DataFrame:
    by = list(by)
    bins = calibration_bins(df, y, p, n_bins, by)
    return bins.groupBy(*by).agg(
        (F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def calibration_curve(df: DataFrame, y: str, p: str, n_bins: int = 10, by=()) -> DataFrame:
    """Uniform bins with right-closed edges (lo, hi]; bin = number of inner edges below p."""
    edges = [i * (1.0 / n_bins) for i in range(1, n_bins)]
    b = sum((F.col(p) > F.lit(e)).cast("int") for e in edges)
    return df.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("prob_true"), F.avg(F.col(p)).alias("prob_pred"))


# ---------------------------------------------------------------------------------------------
# model comparison
# ---------------------------------------------------------------------------------------------
def leaderboard(df: DataFrame, y: str, scores: dict[str, str]) -> DataFrame:
    """AUC per model score column, ordered by AUC desc (rank 1 = best)."""
    long = df.select(F.col(y), F.explode(F.map_from_arrays(
        F.array(*[F.lit(k) for k in scores]), F.array(*[F.col(v) for v in scores.values()]))).alias("model", "score"))
    a = auc_roc(long, y, "score", by=["model"])
    return a.withColumn("rank", F.rank().over(Window.orderBy(F.col("auc_roc").desc_nulls_last(), F.col("model"))))


def champion_challenger(df: DataFrame, y: str, p_old: str, p_new: str, margin: float = 0.005) -> DataFrame:
    lb = leaderboard(df, y, {"champion": p_old, "challenger": p_new})
    return lb.groupBy().agg(
        F.max(F.when(F.col("model") == "champion", F.col("auc_roc"))).alias("champion_auc"),
        F.max(F.when(F.col("model") == "challenger", F.col("auc_roc"))).alias("challenger_auc"),
    ).withColumn("promote", F.col("challenger_auc") > F.col("champion_auc") + F.lit(margin))


def rate_by_tier(df: DataFrame, tier: str = "risk_tier") -> DataFrame:
    return df.groupBy(tier).agg(F.count(F.lit(1)).alias("predictions"))


def batch_summary(df: DataFrame, status: str = "status") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == "ok").alias("processed"),
                  F.count_if(F.col(status) != "ok").alias("failed"))


def describe_profile(df: DataFrame, cols) -> DataFrame:
    """count / mean / sample std / min / exact quartiles / max per numeric column (one row per column)."""
    from churnlab.operators.select import exact_quantiles
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]))
                     .alias("kv")).select("kv.*")
    base = long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                       F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, *[q.get(c, {}).get(p) for p in (0.25, 0.5, 0.75)]) for c in cols]
    quartiles = df.sparkSession.createDataFrame(rows, "feature string, q25 double, q50 double, q75 double")
    return base.join(F.broadcast(quartiles), "feature")


def feedback_stats(feedback: DataFrame, outcome: str = "outcome", group: str = "ab_group", threshold: int = 50) -> DataFrame:
    """Per experiment arm: total, retained, churned, and feedback still needed before the next retrain."""
    g = feedback.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(outcome) == "retained").alias("retained"),
                                    F.count_if(F.col(outcome) == "churned").alias("churned"))
    return g.withColumn("remaining_to_retrain", (F.lit(threshold) - F.col("total") % threshold).cast("bigint"))
