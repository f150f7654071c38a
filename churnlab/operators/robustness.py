"""Robustness of a ``score_fn`` on the whole table: one exploded DataFrame per test, one scoring pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.operators.explain import hash_normal
from churnlab.operators.metrics import calibration_ece
from churnlab.operators.stats import spearman


def _stds(df: DataFrame, cols) -> dict:
    r = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()  # one row
    return {c: (float(r[c]) if r[c] else 1.0) or 1.0 for c in cols}


def _per_feature(df: DataFrame, cols, score_fn, deltas: dict, key: str) -> DataFrame:
    """Rows x variants: each variant shifts one feature by its delta; returns (variant, |p - p0|)."""
    base = score_fn(df).withColumnRenamed("p", "_p0")
    spark = df.sparkSession
    v = spark.createDataFrame([(name, feat, float(d)) for name, (feat, d) in deltas.items()], "variant string, _f string, _d double")
    j = base.crossJoin(F.broadcast(v))  # variants: 2 x features, a fixed small list
    moved = score_fn(j.withColumns({c: F.when(F.col("_f") == c, F.col(c) + F.col("_d")).otherwise(F.col(c)) for c in cols}))
    return moved.select(key, "variant", "_f", F.abs(F.col("p") - F.col("_p0")).alias("shift"))


def perturb_sensitivity(df: DataFrame, cols, score_fn, pct: float = 0.10, key: str = "customer_id") -> DataFrame:
    """Per feature: mean |delta p| when the feature moves up by pct x its std; sorted by effect."""
    sd = _stds(df, cols)
    r = _per_feature(df, cols, score_fn, {c: (c, pct * sd[c]) for c in cols}, key)
    return r.groupBy(F.col("_f").alias("feature")).agg(F.avg("shift").alias("sensitivity"))


def adversarial(df: DataFrame, cols, score_fn, sigma: float = 2.0, p: str = "churn_probability", key: str = "customer_id") -> DataFrame:
    """Max over (feature, +/-) of the mean |delta p| after a sigma x std move; rows with p in [0.3, 0.7]
    are the pool when there are at least 10 of them."""
    pool = df.filter((F.col(p) >= 0.3) & (F.col(p) <= 0.7))
    n_pool = pool.count()
    sub = pool if n_pool >= 10 else df
    sd = _stds(sub, cols)
    deltas = {f"{c}+": (c, sigma * sd[c]) for c in cols}
    deltas.update({f"{c}-": (c, -sigma * sd[c]) for c in cols})
    r = _per_feature(sub, cols, score_fn, deltas, key)
    per = r.groupBy("variant").agg(F.avg("shift").alias("mean_shift"))
    return per.agg(F.max("mean_shift").alias("adversarial_max_shift"), F.max_by("variant", "mean_shift").alias("worst_move"))


def noise_stability(df: DataFrame, cols, score_fn, sd_frac: float = 0.01, reps: int = 5, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """Mean Spearman correlation between p and p on ``reps`` noisy copies (hash-seeded normal noise)."""
    sd = _stds(df, cols)
    base = score_fn(df).withColumnRenamed("p", "_p0")
    rep = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    noisy = rep.withColumns({c: F.col(c) + hash_normal(seed, F.col(key).cast("string"), F.col("rep").cast("string"), c) * (sd_frac * sd[c])
                             for c in cols})
    sc = score_fn(noisy)
    per = spearman(sc, "_p0", "p", by=["rep"])
    return per.agg(F.avg("spearman").alias("stability"), F.count(F.lit(1)).alias("replicas"))


def robustness_report(df: DataFrame, cols, score_fn, y: str = "churned", p: str = "churn_probability", key: str = "customer_id") -> DataFrame:
    """0.4 stability + 0.3 max(0, 1 - 5 ECE) + 0.3 max(0, 1 - 2 shift); pass needs >= .85 / <= .10 / <= .20."""
    st = noise_stability(df, cols, score_fn, key=key)
    ece = calibration_ece(df, y, p)
    adv = adversarial(df, cols, score_fn, p=p, key=key)
    r = st.crossJoin(ece).crossJoin(adv)  # one row each
    s = F.coalesce(F.col("stability"), F.lit(0.5))
    e = F.when(F.col("ece").isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("ece") * 5.0))
    a = F.when(F.col("adversarial_max_shift").isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("adversarial_max_shift") * 2.0))
    passed = ((F.col("stability") >= 0.85) | F.col("stability").isNull()) & ((F.col("ece") <= 0.10) | F.col("ece").isNull()) \
        & ((F.col("adversarial_max_shift") <= 0.20) | F.col("adversarial_max_shift").isNull())
    return r.select(F.round(s, 4).alias("stability_score"), F.round("ece", 4).alias("calibration_ece"),
                    F.round("adversarial_max_shift", 4).alias("adversarial_max_shift"), "worst_move",
                    F.round(0.4 * s + 0.3 * e + 0.3 * a, 4).alias("overall_score"), passed.alias("passed"))
