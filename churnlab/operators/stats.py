"""Distribution comparison, experiment analysis, rank correlation, conformal prediction.

All statistics are Spark aggregates over a long (feature, value, side) form,
so every feature is tested in the same scan.  P-values are computed on the
small per-feature result (one row per feature / experiment).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.functions import special as SP
from churnlab.operators.prefix import prefix_sum
from churnlab.operators.select import GRID, SMALL, exact_quantiles, number, sketch_grid

ALPHA = 0.05


def _long(df: DataFrame, cols, side: str, cast: str = "double") -> DataFrame:
    return df.select(F.lit(side).alias("side"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast(cast).alias("value")) for c in cols])).alias("_kv")
    ).select("side", "_kv.feature", "_kv.value")


def _both(ref: DataFrame, cur: DataFrame, cols, cast="double") -> DataFrame:
    return _long(ref, cols, "ref", cast).unionByName(_long(cur, cols, "cur", cast)).filter(F.col("value").isNotNull())


def hash_half(key, seed: int = 42, parts: int = 2) -> Column:
    """Deterministic split index from md5("seed:key") (stable across engines and partitionings)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(parts))


# ---------------------------------------------------------------------------------------------
# drift
# ---------------------------------------------------------------------------------------------
def drift_moments(ref: DataFrame, cur: DataFrame, cols) -> DataFrame:
    """Rows, mean and population deviation of either side per feature (map-side partial aggregates)."""
    v, side = F.col("value"), F.col("side")
    of = {k: F.when(side == k, v) for k in ("ref", "cur")}
    return _both(ref, cur, cols).groupBy("feature").agg(
        F.count(of["ref"]).alias("n_ref"), F.count(of["cur"]).alias("n_cur"), F.avg(of["ref"]).alias("ref_mean"), F.avg(of["cur"]).alias("cur_mean"),
        F.stddev_pop(of["ref"]).alias("ref_std"), F.stddev_pop(of["cur"]).alias("cur_std"))


def _bucketed(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(side, feature, bucket, value): bucket j starts at edge j - 1; NaN, the largest value, has the last one."""
    from pyspark.ml.feature import Bucketizer

    cols = list(edges)
    vals, buckets = [f"v{i}" for i in range(len(cols))], [f"b{i}" for i in range(len(cols))]
    wide = df.select("_side", *[(number(c) + 0.0).alias(v) for c, v in zip(cols, vals, strict=True)])  # + 0.0: one zero
    splits = [[-math.inf, *[e + 0.0 for e in edges[c] if math.isfinite(e)], math.inf] for c in cols]
    cut = Bucketizer(splitsArray=splits, inputCols=vals, outputCols=buckets, handleInvalid="keep").transform(wide)
    return cut.select(F.col("_side").alias("side"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(b).cast("int").alias("bucket"), F.col(v).alias("value"))
        for c, v, b in zip(cols, vals, buckets, strict=True)])).alias("k")).select("side", "k.*").filter(F.col("value").isNotNull())


def _sides() -> list[Column]:
    return [F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c")]


def drift_ks_stat(ref: DataFrame, cur: DataFrame, cols, grid: int = GRID, small: int = SMALL) -> DataFrame:
    """Two-sample KS statistic D per feature: max |F_ref - F_cur| over the distinct values, exact.

    Sketch quantiles cut each feature into buckets.  Their counts give the gap at every cut and a bound on the gap
    inside; distinct values are counted, and moved, only for buckets of several values whose bound exceeds the largest
    gap at a cut.  The driver holds features x buckets counts."""
    cols = list(cols)
    both = (ref.select(F.lit("ref").alias("_side"), *cols)).unionByName(cur.select(F.lit("cur").alias("_side"), *cols))
    edges = {c: e for c, e in sketch_grid(both, cols, grid).items() if e}
    spark = ref.sparkSession
    schema = "feature string, statistic double"
    if not edges:
        return spark.createDataFrame([], schema)
    rows = _bucketed(both, edges)
    counts: dict[str, list] = {c: [] for c in edges}
    for x in rows.groupBy("feature", "bucket").agg(*_sides(), (F.min("value") == F.max("value")).alias("one")).collect():
        counts[x["feature"]].append((x["bucket"], x["r"], x["c"], x["one"]))
    best, open_ = {}, []
    for c, bs in counts.items():
        nr, nc = sum(x[1] for x in bs), sum(x[2] for x in bs)
        if not nr or not nc:
            continue
        d, r0, c0, bounds = 0.0, 0, 0, []
        for b, r, k, one in sorted(bs):
            if not one:
                bounds.append((max((r0 + r) / nr - c0 / nc, (c0 + k) / nc - r0 / nr), b, r0, c0))
            r0, c0 = r0 + r, c0 + k
            d = max(d, abs(r0 / nr - c0 / nc))
        best[c] = d
        open_ += [(c, b, r, k, nr, nc) for bound, b, r, k in bounds if bound > d]
    if open_:
        before = spark.createDataFrame(open_, "feature string, bucket int, r0 long, c0 long, nr long, nc long")
        keys = F.broadcast(before.select("feature", "bucket"))  # features x buckets rows at most
        values = rows.join(keys, ["feature", "bucket"], "left_semi").groupBy("feature", "bucket", "value").agg(*_sides())
        size = {(c, x[0]): x[1] + x[2] for c, bs in counts.items() for x in bs}
        if max(size[o[:2]] for o in open_) <= small:  # a window task per bucket; larger ones are cut again
            w = Window.partitionBy("feature", "bucket").orderBy("value")
            cum = values.select("feature", "bucket", F.sum("r").over(w).alias("cum_r"), F.sum("c").over(w).alias("cum_c"))
        else:
            cum = prefix_sum(values, "value", ["r", "c"], by=["feature", "bucket"])
        gap = F.abs((F.col("cum_r") + F.col("r0")) / F.col("nr") - (F.col("cum_c") + F.col("c0")) / F.col("nc"))
        for x in cum.join(F.broadcast(before), ["feature", "bucket"]).groupBy("feature").agg(F.max(gap).alias("d")).collect():
            best[x["feature"]] = max(best[x["feature"]], x["d"])
    return spark.createDataFrame(list(best.items()), schema)


def drift_ks(ref: DataFrame, cur: DataFrame, cols, alpha: float = ALPHA) -> DataFrame:
    mom = drift_moments(ref, cur, cols).filter((F.col("n_ref") >= 2) & (F.col("n_cur") >= 2))
    r = mom.join(F.broadcast(drift_ks_stat(ref, cur, cols)), "feature")  # one row per feature
    p = SP.ks_pvalue(F.col("statistic"), F.col("n_ref"), F.col("n_cur"))
    return r.withColumn("p_value", p).withColumn("drifted", F.col("p_value") < alpha).withColumn("test", F.lit("kolmogorov_smirnov"))


def drift_chi2_stat(ref: DataFrame, cur: DataFrame, cols) -> DataFrame:
    """Goodness of fit of current counts against reference shares; cells with expected 0 are left out
    and reported as ``unseen_share``; expected counts are renormalised to the kept current rows."""
    t = _both(ref, cur, cols, cast="string")
    cnt = t.groupBy("feature", "value").agg(F.count_if(F.col("side") == "ref").alias("r"),
                                             F.count_if(F.col("side") == "cur").alias("c"))
    tot = cnt.groupBy("feature").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"),
                                     F.sum(F.when(F.col("r") == 0, F.col("c")).otherwise(0)).alias("unseen"))
    j = cnt.join(F.broadcast(tot), "feature").filter(F.col("r") > 0)
    e = F.col("r") / F.col("n_ref") * (F.col("n_cur") - F.col("unseen"))
    return j.groupBy("feature").agg(
        F.sum(F.try_divide((F.col("c") - e) * (F.col("c") - e), e)).alias("statistic"),
        F.count(F.lit(1)).alias("cells"),
        F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"),
        F.try_divide(F.first("unseen").cast("double"), F.first("n_cur")).alias("unseen_share"),
    ).filter(F.col("cells") >= 2)


def drift_chi2(ref: DataFrame, cur: DataFrame, cols, alpha: float = ALPHA) -> DataFrame:
    s = drift_chi2_stat(ref, cur, cols)
    return (s.withColumn("p_value", SP.chi2_sf(F.col("statistic"), F.col("cells") - 1))
            .withColumn("drifted", F.col("p_value") < alpha).withColumn("test", F.lit("chi_square")))


def drift_summary(results: DataFrame, majority: float = 0.5) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("features_tested"),
        F.count_if(F.col("drifted")).alias("features_drifted"),
        F.coalesce(F.round(F.try_divide(F.count_if(F.col("drifted")).cast("double"), F.count(F.lit(1))), 4), F.lit(0.0))
        .alias("share_drifted_features"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))), ",").alias("drifted_features"),
    ).withColumn("dataset_drift", F.col("share_drifted_features") >= majority)


def drift_split(df: DataFrame, key: str, numeric, categorical, seed: int = 42) -> DataFrame:
    """Halve one table by a hash of the key into reference / current and run both tests."""
    part = hash_half(key, seed)
    ref, cur = df.filter(part == 0), df.filter(part == 1)
    cols = ["feature", "statistic", "p_value", "drifted", "test"]
    return drift_ks(ref, cur, numeric).select(*cols).unionByName(drift_chi2(ref, cur, categorical).select(*cols))


def psi(ref: DataFrame, cur: DataFrame, cols, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index per feature on reference-decile bins (right-closed), shares floored at eps."""
    edges = exact_quantiles(ref, cols, [i / bins for i in range(1, bins)])  # a feature without reference values is left out

    def binned(df, side):
        cells = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("feature"), sum((number(c) > e).cast("int") for e in qs.values()).alias("bin")))
                 for c, qs in edges.items()]
        return df.select(F.lit(side).alias("side"), F.explode(F.array_compact(F.array(*cells))).alias("k")).select("side", "k.*")

    if not edges:
        return ref.sparkSession.createDataFrame([], "feature string, psi double")
    cnt = binned(ref, "ref").unionByName(binned(cur, "cur")).groupBy("feature", "bin").agg(*_sides())
    tot = cnt.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    j = cnt.join(F.broadcast(tot), "feature")
    rs = F.greatest(F.col("r") / F.col("nr"), F.lit(eps))
    cs = F.greatest(F.col("c") / F.col("nc"), F.lit(eps))
    return j.groupBy("feature").agg(F.sum((cs - rs) * F.log(cs / rs)).alias("psi"))


def baseline_stats(df: DataFrame, cols) -> DataFrame:
    """Mean and sample std per feature (one row per feature)."""
    t = _long(df, cols, "ref").filter(F.col("value").isNotNull())
    return t.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                    F.count(F.lit(1)).alias("n"))


def zscore_flags(df: DataFrame, baseline: DataFrame, cols, key: str = "customer_id", z: float = 3.0,
                 n_features: int | None = None) -> DataFrame:
    """Per row: features with |(x - mean) / std| > z (std < 1e-9 skipped); score = flagged / n_features,
    passed if score < 0.3.  The baseline is one row per feature; flags are found inside the row (no shuffle)."""
    nf = float(n_features or len(cols))
    stats = baseline.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_s"))  # one row
    pairs = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in cols])

    def far(x):
        b = F.try_element_at(F.col("_s"), x["f"])
        return x["v"].isNotNull() & (b["std"] >= 1e-9) & (F.abs(F.try_divide(x["v"] - b["mean"], b["std"])) > z)

    g = df.crossJoin(F.broadcast(stats)).select(key, F.array_sort(F.transform(F.filter(pairs, far), lambda x: x["f"])).alias("_f"))
    g = g.select(key, F.size("_f").cast("long").alias("n_flagged"), F.array_join("_f", ",").alias("flagged"))
    return g.withColumn("anomaly_score", F.col("n_flagged") / F.lit(nf)).withColumn("passed", F.col("anomaly_score") < 0.3)


# ---------------------------------------------------------------------------------------------
# experiments
# ---------------------------------------------------------------------------------------------
def ab_summary(df: DataFrame, by: str = "experiment_id", arm: str = "group") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total_outcomes"),
                              F.count_if(F.col(arm) == "treatment").alias("treatment_n"),
                              F.count_if(F.col(arm) == "control").alias("control_n"))


def ab_chi2(df: DataFrame, by: str = "experiment_id", arm: str = "group", outcome: str = "outcome_value") -> DataFrame:
    """2x2 chi-square (success = outcome >= 0.5) with the Yates correction, per experiment."""
    s = F.col(outcome) >= 0.5
    g = df.groupBy(by).agg(
        F.count_if((F.col(arm) == "treatment") & s).alias("a"), F.count_if((F.col(arm) == "treatment") & ~s).alias("b"),
        F.count_if((F.col(arm) == "control") & s).alias("c"), F.count_if((F.col(arm) == "control") & ~s).alias("d"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    r1, r2 = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    c1, c2 = F.col("a") + F.col("c"), F.col("b") + F.col("d")

    def cell(o, r, c):
        e = r * c / n
        adj = F.least(F.lit(0.5), F.abs(e - o))
        return F.try_divide((F.abs(o - e) - adj) * (F.abs(o - e) - adj), e)

    chi = cell(F.col("a"), r1, c1) + cell(F.col("b"), r1, c2) + cell(F.col("c"), r2, c1) + cell(F.col("d"), r2, c2)
    return g.withColumn("chi2_statistic", chi)


def ab_mannwhitney(df: DataFrame, by: str = "experiment_id", arm: str = "group", outcome: str = "outcome_value") -> DataFrame:
    """U of the treatment arm with average ranks; normal approximation with tie and continuity correction."""
    cnt = df.groupBy(by, F.col(outcome).alias("v")).agg(
        F.count_if(F.col(arm) == "treatment").alias("nt"), F.count_if(F.col(arm) == "control").alias("nc"))
    cnt = cnt.withColumn("t", F.col("nt") + F.col("nc"))
    cum = prefix_sum(cnt, "v", ["t"], by=[by])
    rank = (F.col("cum_t") - F.col("t")) + (F.col("t") + 1) / 2.0
    g = cum.groupBy(by).agg(F.sum(F.col("nt") * rank).alias("rank_sum_t"), F.sum("nt").alias("n1"), F.sum("nc").alias("n2"),
                            F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("rank_sum_t") - n1 * (n1 + 1) / 2.0
    n = n1 + n2
    mu = n1 * n2 / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    umax = F.greatest(u1, n1 * n2 - u1)
    return g.select(by, "n1", "n2", u1.alias("u_statistic"), F.try_divide(umax - mu - 0.5, sd).alias("z"))


def ab_report(df: DataFrame, by: str = "experiment_id", arm: str = "group", outcome: str = "outcome_value",
              min_n: int = 30) -> DataFrame:
    means = df.groupBy(by).agg(
        F.count_if(F.col(arm) == "treatment").alias("treatment_n"), F.count_if(F.col(arm) == "control").alias("control_n"),
        F.avg(F.when(F.col(arm) == "treatment", F.col(outcome))).alias("treatment_mean"),
        F.avg(F.when(F.col(arm) == "control", F.col(outcome))).alias("control_mean"))
    mw = ab_mannwhitney(df, by, arm, outcome).select(by, "u_statistic", "z")
    ch = ab_chi2(df, by, arm, outcome).select(by, "chi2_statistic")
    r = means.join(mw, by).join(ch, by)
    uplift = F.round(F.col("treatment_mean") - F.col("control_mean"), 4)
    r = r.withColumns({
        "uplift": uplift,
        "uplift_pct": F.round(uplift / F.greatest(F.col("control_mean"), F.lit(1e-9)) * 100.0, 2),
        "p_value_mannwhitney": F.least(F.lit(1.0), 2.0 * SP.norm_sf(F.col("z"))),
        "p_value_chisq": SP.chi2_sf(F.col("chi2_statistic"), F.lit(1.0)),
    })
    enough = (F.col("treatment_n") >= min_n) & (F.col("control_n") >= min_n)
    return r.withColumns({
        "is_significant": enough & ((F.col("p_value_mannwhitney") < 0.05) | (F.col("p_value_chisq") < 0.05)),
        "warning": F.when(~enough, F.lit("insufficient samples")),
    })


# ---------------------------------------------------------------------------------------------
# rank correlation and conformal prediction
# ---------------------------------------------------------------------------------------------
def _avg_rank(df: DataFrame, col: str, by) -> DataFrame:
    cnt = df.groupBy(*by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = prefix_sum(cnt, "_v", ["_n"], by=by)
    return cum.select(*by, F.col("_v").alias(col), ((F.col("cum__n") - F.col("_n")) + (F.col("_n") + 1) / 2.0).alias(f"_rank_{col}"))


def spearman(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """Spearman correlation with average ranks: Pearson correlation of the ranks."""
    by = list(by)
    d = df.select(*by, a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    j = d.join(_avg_rank(d, a, by), by + [a]).join(_avg_rank(d, b, by), by + [b])
    return j.groupBy(*by).agg(F.corr(f"_rank_{a}", f"_rank_{b}").alias("spearman"))


def conformal_quantile(cal: DataFrame, y: str, p: str, alpha: float = 0.10, by=()) -> DataFrame:
    """Score = 1 - p(true class); q = k-th smallest score, k = ceil((n + 1)(1 - alpha)) (q = 1 if k > n)."""
    by = list(by)
    s = cal.select(*by, F.when(F.col(y) == 1, 1.0 - F.col(p)).otherwise(F.col(p)).alias("score"))
    cnt = s.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"))
    j = prefix_sum(cnt, "score", ["n"], by=by, totals=True).withColumnRenamed("tot_n", "n_cal")
    k = F.ceil((F.col("n_cal") + 1) * (1.0 - alpha))
    q = j.groupBy(*by).agg(F.min(F.when(F.col("cum_n") >= k, F.col("score"))).alias("q"), F.first("n_cal").alias("n_cal"))
    return q.withColumn("q", F.coalesce(F.col("q"), F.lit(1.0)))


def conformal_sets(df: DataFrame, p: str, q: Column) -> DataFrame:
    in1 = (1.0 - F.col(p)) <= q
    in0 = F.col(p) <= q
    return df.withColumns({"in_set_1": in1, "in_set_0": in0, "set_size": in1.cast("int") + in0.cast("int"),
                           "uncertain": in1 & in0})


def conformal_coverage(df: DataFrame, y: str, p: str, q: Column, by=()) -> DataFrame:
    s = conformal_sets(df, p, q)
    covered = F.when(F.col(y) == 1, F.col("in_set_1")).otherwise(F.col("in_set_0"))
    return s.groupBy(*by).agg(F.avg(covered.cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"),
                              F.avg(F.col("set_size").cast("double")).alias("avg_set_size"))
