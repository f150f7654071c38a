"""Group fairness over several protected attributes in one grouped pass.

Rows are exploded into (attribute, value) pairs (x number of attributes, a
small constant), aggregated once by (attribute, value), and the per-attribute
metrics are a second aggregate over that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Acceptance thresholds for demographic parity, equalized odds, disparate impact.
DEMOGRAPHIC_PARITY_THRESHOLD = 0.10
EQUALIZED_ODDS_THRESHOLD = 0.10
DISPARATE_IMPACT_THRESHOLD = 0.80


def _pairs(df: DataFrame, attrs, y: str, p: str, threshold: float) -> DataFrame:
    kv = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attrs]))
    return (df.select(kv.alias("_a"), F.col(y).cast("int").alias("_y"), F.col(p).alias("_p"))
            .select("_a.attribute", "_a.value", "_y", "_p", (F.col("_p") >= F.lit(threshold)).cast("int").alias("_pred"))
            .filter(F.col("value").isNotNull()))


def segment_stats(df: DataFrame, attrs, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Per (attribute, value): n, predicted rate, mean p, actual rate, TPR (null if no positives), FPR."""
    t = _pairs(df, attrs, y, p, threshold)
    g = t.groupBy("attribute", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_pred").alias("predicted_rate"),
        F.avg("_p").alias("avg_probability"),
        F.avg("_y").alias("actual_rate"),
        F.count_if((F.col("_pred") == 1) & (F.col("_y") == 1)).alias("tp"),
        F.count_if(F.col("_y") == 1).alias("positives"),
        F.count_if((F.col("_pred") == 1) & (F.col("_y") == 0)).alias("fp"),
        F.count_if(F.col("_y") == 0).alias("negatives"),
    )
    return g.withColumns({
        "tpr": F.try_divide(F.col("tp").cast("double"), F.col("positives")),
        "fpr": F.try_divide(F.col("fp").cast("double"), F.col("negatives")),
    })


def bias_check(df: DataFrame, attrs, y: str, p: str, threshold: float = 0.5, min_rows: int = 50) -> DataFrame:
    """One row per attribute with >= min_rows non-null rows: parity difference, equalized odds
    (max of TPR range and FPR range), disparate impact (min/max rate, null if max is 0), failures."""
    st = segment_stats(df, attrs, y, p, threshold)
    a = st.groupBy("attribute").agg(
        F.sum("n").alias("n"),
        (F.max("predicted_rate") - F.min("predicted_rate")).alias("demographic_parity_diff"),
        F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr")).alias("equalized_odds_diff"),
        F.try_divide(F.min("predicted_rate"), F.nullif(F.max("predicted_rate"), F.lit(0.0))).alias("disparate_impact_ratio"),
    ).filter(F.col("n") >= min_rows)
    fails = F.array_compact(F.array(
        F.when(F.abs(F.col("demographic_parity_diff")) > DEMOGRAPHIC_PARITY_THRESHOLD, F.lit("demographic_parity")),
        F.when(F.abs(F.col("equalized_odds_diff")) > EQUALIZED_ODDS_THRESHOLD, F.lit("equalized_odds")),
        F.when(F.col("disparate_impact_ratio") < DISPARATE_IMPACT_THRESHOLD, F.lit("disparate_impact")),
    ))
    return a.withColumn("failures", fails).withColumn("passed", F.size("failures") == 0)


def demographic_parity(stats: DataFrame) -> DataFrame:
    return stats.groupBy("attribute").agg((F.max("predicted_rate") - F.min("predicted_rate")).alias("demographic_parity_diff"))


def equalized_odds(stats: DataFrame) -> DataFrame:
    return stats.groupBy("attribute").agg(
        F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr")).alias("equalized_odds_diff"))


def disparate_impact(stats: DataFrame) -> DataFrame:
    return stats.groupBy("attribute").agg(
        F.try_divide(F.min("predicted_rate"), F.nullif(F.max("predicted_rate"), F.lit(0.0))).alias("disparate_impact_ratio"))


def bias_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("attribute")))), ",").alias("failed_attributes"),
    )
