"""Explanations as Spark jobs: exact linear attributions, permutation-sampled attributions, local
surrogates, driver lists, and counterfactual moves — every scoring is one ``score_fn`` pass over an
exploded DataFrame (rows x variants), never a per-row Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlab.operators import neighbours as NB
from churnlab.operators.prefix import prefix_sum
from churnlab.session import cut_lineage, require_small


def hash_uniform(*parts) -> Column:
    """Deterministic U(0,1) from the high 53 bits of a 64-bit hash of the parts (independent of partitioning)."""
    h = F.xxhash64(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def hash_normal(*parts) -> Column:
    """Deterministic N(0,1) by Box-Muller on two hash uniforms."""
    u1, u2 = hash_uniform(*parts, "a"), hash_uniform(*parts, "b")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * np.pi * u2)


def _long(df: DataFrame, key: str, cols: dict) -> DataFrame:
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in cols.items()])).alias("kv")) \
        .select(key, "kv.feature", "kv.value")


# ---------------------------------------------------------------------------------------------
# attributions
# ---------------------------------------------------------------------------------------------
def attrib_rows(df: DataFrame, terms: dict) -> DataFrame:
    """``df`` with ``attrib``: array of (feature, value), the exact linear attribution term_j(x) - mean_j
    (log-odds space for a logistic model).

    ``terms``: feature name -> Column holding that feature's weighted contribution w_j * z_j(x).
    The means are one aggregate row, broadcast; the values of a row sum to its score minus the mean score."""
    names = [f"_t{i}" for i in range(len(terms))]
    t = df.select("*", *[c.alias(x) for x, c in zip(names, terms.values(), strict=True)])
    means = t.agg(*[F.avg(x).alias(f"_m{x}") for x in names])
    j = t.crossJoin(F.broadcast(means))
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), (F.col(x) - F.col(f"_m{x}")).alias("value")) for n, x in zip(terms, names, strict=True)])
    return j.withColumn("attrib", pairs).drop(*names, *[f"_m{x}" for x in names])


def attrib_linear(df: DataFrame, terms: dict, key: str = "customer_id") -> DataFrame:
    """:func:`attrib_rows` in long form: (key, feature, value)."""
    return attrib_rows(df, terms).select(key, F.explode("attrib").alias("kv")).select(key, "kv.feature", "kv.value")


def global_importance(attrib: DataFrame) -> DataFrame:
    g = attrib.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.col("mean_abs").desc(), F.col("feature"))))  # one row per feature


def top_drivers(rows: DataFrame, k: int = 5, key: str = "customer_id", attrib: str = "attrib", carry=()) -> DataFrame:
    """Per row: top-k positive, top-k negative and top-k by |value| (feature names, strongest first), by one sort
    of the row's own (feature, value) array."""
    ranked = F.array_sort(F.transform(attrib, lambda x: F.struct((-F.abs(x["value"])).alias("a"), x["feature"].alias("f"), x["value"].alias("v"))))
    r = rows.select(key, *carry, ranked.alias("_r"))

    def top(keep):
        return F.array_join(F.transform(F.slice(F.filter("_r", keep), 1, k), lambda x: x["f"]), ",")

    signed = F.transform(F.slice("_r", 1, k), lambda x: F.concat(x["f"], F.when(x["v"] >= 0, F.lit("+")).otherwise(F.lit("-"))))
    return r.select(key, *carry, top(lambda x: x["v"] > 0).alias("top_positive"), top(lambda x: x["v"] < 0).alias("top_negative"),
                    F.array_join(signed, ",").alias("top_abs"))


def attrib_interactions(attrib: DataFrame, top: int = 10, key: str = "customer_id") -> DataFrame:
    """Correlation between the attributions of the ``top`` most important features (one pass, pairs in one agg)."""
    feats = [r["feature"] for r in global_importance(attrib).filter(F.col("rank") <= top).orderBy("rank").collect()]  # <= top names
    wide = attrib.filter(F.col("feature").isin(feats)).groupBy(key).pivot("feature", feats).agg(F.first("value"))
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    g = wide.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return g.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("corr"))
                                        for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def attrib_agreement(a: DataFrame, b: DataFrame, k: int = 5, key: str = "customer_id") -> DataFrame:
    """Mean over j = 1..k of |top_j(a) & top_j(b)| / j per row (rankings by |value|)."""
    def ranked(d, name):
        w = Window.partitionBy(key).orderBy(F.abs("value").desc(), F.col("feature"))
        r = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        return r.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "feature"))), lambda s: s["feature"]).alias(name))
    j = ranked(a, "_a").join(ranked(b, "_b"), key)
    score = sum(F.size(F.array_intersect(F.slice("_a", 1, i), F.slice("_b", 1, i))) / float(i) for i in range(1, k + 1)) / float(k)
    return j.select(key, score.alias("agreement"))


def attrib_sampled(df: DataFrame, background: DataFrame, cols, score_fn, perms: int = 16, seed: int = 42,
                   key: str = "customer_id") -> DataFrame:
    """Permutation-sampled Shapley values against a background (model agnostic).

    For each row and permutation: a background row is picked by hash, features are switched
    from background to the row's values one at a time in permutation order, every variant is
    scored in ONE ``score_fn`` pass, and the score increments are averaged per feature.
    The background is a bounded sample (broadcast).
    """
    cols = list(cols)
    nf = len(cols)
    bg = background.select(*[F.col(c).alias(f"_bg_{c}") for c in cols]).withColumn(
        "_bid", F.row_number().over(Window.orderBy(*[F.col(f"_bg_{c}") for c in cols])) - 1)  # bounded sample
    nb = require_small(bg, 100_000, "background sample")
    spark = df.sparkSession
    # permutation p: feature order by hash(seed, p, feature)
    perm_rows = []
    for p in range(perms):
        order = sorted(range(nf), key=lambda j: hash_key_py(seed, p, cols[j]))
        perm_rows.append((p, order))
    pr = spark.createDataFrame(perm_rows, "perm int, ord array<int>")
    extra = [c for c in df.columns if c not in cols and c != key]  # carried unchanged (e.g. categorical inputs)
    base = df.select(key, *cols, *extra).crossJoin(F.broadcast(pr))
    base = base.withColumn("_bid", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("perm").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(nb)))
    base = base.join(F.broadcast(bg), "_bid")
    steps = base.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(nf))))
    # feature j takes the row's value when its position in the permutation is < step
    variant = steps.select(key, "perm", "step", "ord", *extra, *[
        F.when(F.array_position(F.col("ord"), F.lit(j)) - 1 < F.col("step"), F.col(c)).otherwise(F.col(f"_bg_{c}")).alias(c)
        for j, c in enumerate(cols)])
    scored = score_fn(variant)
    w = Window.partitionBy(key, "perm").orderBy("step")
    inc = scored.withColumn("_d", F.col("p") - F.lag("p").over(w)).filter(F.col("step") >= 1)
    inc = inc.withColumn("feature_idx", F.element_at(F.col("ord"), F.col("step")))
    names = F.array(*[F.lit(c) for c in cols])
    g = inc.groupBy(key, "feature_idx").agg(F.avg("_d").alias("value"))
    return g.select(key, F.element_at(names, F.col("feature_idx") + 1).alias("feature"), "value")


def hash_key_py(*parts) -> int:
    import hashlib
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)


# ---------------------------------------------------------------------------------------------
# local surrogate (LIME-style)
# ---------------------------------------------------------------------------------------------
_SUR = T.StructType([T.StructField("k", T.LongType()), T.StructField("intercept", T.DoubleType()),
                     T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("local_pred", T.DoubleType())])


def _scales(train: DataFrame, cols) -> tuple[dict, dict]:
    """Mean and standard deviation per column of the training frame (one row; an all-null or constant column: 0 and 1)."""
    r = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    return {c: float(r[f"m_{c}"] or 0.0) for c in cols}, {c: float(r[f"s_{c}"] or 1.0) or 1.0 for c in cols}


def surrogate_local(df: DataFrame, cols, score_fn, n: int = 500, seed: int = 42, key: str = "customer_id",
                    kernel_width: float | None = None, ridge: float = 1.0, train: DataFrame | None = None) -> DataFrame:
    """Per row: ``n`` Gaussian neighbours (scale = column std of ``train``, missing values = its mean), one scoring
    pass (in the drawing task if ``score_fn`` has ``arrays``), kernel-weighted ridge fit.  The weighted normal equations are summed where the neighbours are drawn; only the (d+1)x(d+1) solve per row
    runs in numpy (mapInPandas over one row per explained instance)."""
    cols = list(cols)
    d = len(cols)
    kw = kernel_width or float(np.sqrt(d) * 0.75)
    mean, sd = _scales(df if train is None else train, cols)
    extra = [c for c in df.columns if c not in cols and c != key]
    x = df.select(key, *extra, *[F.coalesce(F.col(c).cast("double"), F.lit(mean[c])).alias(c) for c in cols])
    if hasattr(score_fn, "arrays"):
        g = NB.drawn_sums(NB.spread(x), cols, sd, n, seed, key, extra, score_fn.arrays, kw)
    else:
        g = NB.weighted_sums(score_fn(NB.draw(NB.spread(x), cols, sd, n, seed, key, extra)), cols, key, kw)

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            m = len(pdf)
            A = np.zeros((m, d + 1, d + 1))
            for a in range(d + 1):
                for b in range(a, d + 1):
                    A[:, a, b] = A[:, b, a] = pdf[f"a_{a}_{b}"].to_numpy()
            A[:, 1:, 1:] += ridge * np.eye(d)
            B = np.stack([pdf[f"b_{a}"].to_numpy() for a in range(d + 1)], axis=1)
            coef = np.linalg.solve(A, B[..., None])[..., 0]
            yield pd.DataFrame({"k": pdf[key].astype("int64"), "intercept": coef[:, 0],
                                "weights": list(coef[:, 1:]), "local_pred": coef[:, 0]})

    out = g.mapInPandas(solve, _SUR)
    return out.withColumnRenamed("k", key)


def surrogate_attrib(sur: DataFrame, cols, key: str = "customer_id") -> DataFrame:
    return sur.select(key, F.posexplode("weights").alias("i", "value")).select(
        key, F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1).alias("feature"), "value")


def surrogate_fidelity(df: DataFrame, sur: DataFrame, cols, score_fn, n: int = 500, seed: int = 7, key: str = "customer_id",
                       train: DataFrame | None = None) -> DataFrame:
    """Per instance on fresh neighbours: AUC of the surrogate against (model p > 0.5); where all neighbours fall on one
    side, max(0, R^2) of the surrogate against p instead (``measure`` says which).  ``score_fn`` works row by row: a row's
    neighbours stay side by side in one partition."""
    cols = list(cols)
    mean, sd = _scales(df if train is None else train, cols)
    extra = [c for c in df.columns if c not in cols and c != key]
    x = df.select(key, *extra, *[F.coalesce(F.col(c).cast("double"), F.lit(mean[c])).alias(c) for c in cols]).join(sur, key)
    if hasattr(score_fn, "arrays"):
        res = NB.drawn_likeness(NB.spread(x, key), cols, sd, n, seed, key, extra, score_fn.arrays)
    else:
        sc = score_fn(NB.draw(NB.spread(x, key), cols, sd, n, seed, key, ["intercept", "weights", *extra]))
        lin = F.col("intercept") + sum(F.element_at("weights", i + 1) * F.col(f"_z_{c}") for i, c in enumerate(cols))
        res = NB.likeness(sc.select(key, "p", lin.alias("s")), key)
    return res.select(key, F.coalesce("_auc", F.greatest(F.col("_r2"), F.lit(0.0))).alias("fidelity"),
                      F.when(F.col("_auc").isNull(), "r2").otherwise("auc").alias("measure"))


# ---------------------------------------------------------------------------------------------
# counterfactuals
# ---------------------------------------------------------------------------------------------
# Single-feature intervention catalogue (feature, relative change, absolute change,
# action text, cost USD, effort, days to effect).
CATALOGUE_B = [
    ("monthly_charges", -0.15, None, "Reduce monthly price by 15%", 45.0, 1, 7),
    ("monthly_charges", -0.25, None, "Reduce monthly price by 25%", 75.0, 1, 7),
    ("feature_adoption_rate", None, 0.30, "Assign dedicated onboarding / CSM support", 120.0, 3, 30),
    ("num_support_tickets_30d", None, -2.0, "Proactive support outreach to resolve open issues", 60.0, 2, 14),
    ("nps_score", None, 2.0, "Offer loyalty upgrade with annual contract incentive", 80.0, 2, 21),
    ("login_frequency_30d", None, 5.0, "Personalised re-engagement campaign (email + in-app)", 20.0, 1, 10),
]


def catalogue_b_df(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(CATALOGUE_B)],
                                 "move int, feature string, delta_pct double, delta_abs double, action string, cost_usd double, effort int, days_to_effect int")


def cf_rules(df: DataFrame, score_fn, min_drop: float = 0.02, key: str = "customer_id") -> DataFrame:
    """Every row x every catalogue move (catalogue broadcast), one scoring pass; keep moves whose
    probability drop exceeds ``min_drop``.  A missing value counts as 0 before the change."""
    spark = df.sparkSession
    base = score_fn(df).withColumnRenamed("p", "_base_p")
    cat = catalogue_b_df(spark)
    j = base.crossJoin(F.broadcast(cat))
    feats = sorted({r[0] for r in CATALOGUE_B})
    rep = {}
    for f in feats:
        old = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        new = F.when(F.col("delta_pct").isNotNull(), old * (1.0 + F.col("delta_pct"))).otherwise(old + F.col("delta_abs"))
        rep[f] = F.when(F.col("feature") == f, new).otherwise(F.col(f))
    moved = score_fn(j.withColumns(rep))
    red = F.col("_base_p") - F.col("p")
    return moved.filter(red > min_drop).select(
        key, "move", "feature", "action", "cost_usd", "effort", "days_to_effect", F.col("_base_p").alias("churn_probability"),
        F.round("p", 4).alias("new_churn_prob"), F.round(red, 4).alias("prob_reduction"),
        F.when(F.col("feature") == "monthly_charges", -F.col("delta_pct")).alias("discount_pct"))


def cf_constraints(cf: DataFrame, max_cost: float = 300.0, max_discount: float = 0.30) -> DataFrame:
    return cf.filter((F.col("cost_usd") <= max_cost) & (F.coalesce(F.col("discount_pct"), F.lit(0.0)) <= max_discount))


def cf_rank_feasibility(cf: DataFrame, k: int = 5, key: str = "customer_id") -> DataFrame:
    fs = F.round(F.col("prob_reduction") / F.greatest(F.col("cost_usd"), F.lit(1.0)) / F.greatest(F.col("days_to_effect"), F.lit(1)) * 1000.0, 6)
    w = Window.partitionBy(key).orderBy(F.col("feasibility_score").desc(), F.col("move"))
    return cf.withColumn("feasibility_score", fs).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cf_rank_prob(cf: DataFrame, k: int = 3, key: str = "customer_id", p: str = "new_churn_prob", cost: str = "cost_usd") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(p).asc(), F.col(cost).asc(), F.col("move"))
    return cf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cf_search(df: DataFrame, donors: DataFrame, cols, score_fn, n: int = 10, seed: int = 42, target: float = 0.5,
              key: str = "customer_id", tries_per_round: int = 50) -> DataFrame:
    """Random counterfactuals: up to ``n`` flips per row, each changing 1-3 features to values of a hash-picked donor.

    Only rows with p >= target are searched.  Tries come in rounds of ``tries_per_round`` up to 50 * n, rows that have
    their ``n`` flips leave after each round; a row keeps its first ``n`` by try number.  Donors are joined by their
    number.  Tables of customers are joined by sorting: a small file of well packed columns, which the planner takes for
    a small table, would pass through the driver as a broadcast."""
    cols, k_max = list(cols), min(3, len(list(cols)))
    dn = cut_lineage(donors.select(*cols).distinct().withColumn("_h", F.xxhash64(*cols)))
    dn = cut_lineage(prefix_sum(dn.withColumn("_one", F.lit(1)), "_h", ["_one"], tiebreak=[F.col(c).asc_nulls_first() for c in cols])
                     .select(*[F.col(c).alias(f"_d_{c}") for c in cols], (F.col("cum__one") - 1).cast("long").alias("_did")))
    nd = dn.count()
    base = cut_lineage(score_fn(df).filter(F.col("p") >= target).drop("p"))
    found, left = [], base.withColumn("_have", F.lit(0).cast("long"))
    for start in range(0, 50 * n if nd else 0, tries_per_round):
        stop = min(start + tries_per_round, 50 * n)
        # one hash array per try: donor, number of changes, then a random order of the features
        h = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col("cand"), F.lit(c)).alias("h"), F.lit(c).alias("c")) for c in cols])
        cand = left.withColumn("cand", F.explode(F.sequence(F.lit(start), F.lit(stop - 1))))
        pick = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col("cand"), F.lit("donor"))
        size = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col("cand"), F.lit("size"))
        cand = (cand.withColumn("_did", F.pmod(pick, F.lit(nd))).withColumn("_pick", F.slice(F.transform(F.array_sort(h), lambda x: x["c"]), 1, (F.pmod(size, F.lit(k_max)) + 1).cast("int")))
                .join(dn.hint("merge"), "_did"))

        def differs(c):
            new, old = F.col(f"_d_{c}"), F.col(c)
            far = F.abs(new - old) > 1e-4 if isinstance(df.schema[c].dataType, T.NumericType) else new != old
            return F.array_contains("_pick", c) & F.coalesce(far, ~new.eqNullSafe(old))

        cand = cand.withColumn("changed", F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in cols]))).filter(F.size("changed") > 0)
        cand = cand.select(*[(F.when(F.array_contains("changed", c), F.col(f"_d_{c}")).otherwise(F.col(c)) if c in cols else F.col(c)).alias(c)
                             for c in [*df.columns, "_have", "cand", "changed"]])
        hits = cut_lineage(score_fn(cand).filter(F.col("p") < target).select(key, "cand", "changed", *cols, "_have", F.col("p").alias("new_churn_prob")))
        w = Window.partitionBy(key).orderBy("cand")  # at most tries_per_round rows per key
        found.append(hits.withColumn("_r", F.row_number().over(w) + F.col("_have")).filter(F.col("_r") <= n).drop("_r", "_have"))
        got = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_new"))
        left = cut_lineage(left.join(got.hint("merge"), key, "left").withColumn("_have", F.col("_have") + F.coalesce("_new", F.lit(0))).drop("_new").filter(F.col("_have") < n))
        if left.isEmpty():
            break
    if not found:
        return base.select(key, F.lit(0).alias("cand"), F.array().cast("array<string>").alias("changed"), *cols, F.lit(0.0).alias("new_churn_prob")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# Feature -> (action text, cost USD) of searched counterfactuals; a price cut costs 3 USD per USD, other features 10.
CF_ACTIONS = {
    "monthly_charges": ("Reduce monthly price by {pct}%", 3.0),
    "feature_adoption_rate": ("Assign dedicated onboarding / CSM support", 50.0),
    "contract_type": ("Offer annual contract upgrade with loyalty discount", 80.0),
    "num_support_tickets_30d": ("Prioritise support queue — proactive resolution", 20.0),
    "plan_tier": ("Offer complimentary plan tier upgrade", 60.0),
}


def cf_cost(cf: DataFrame, base: DataFrame, key: str = "customer_id", p0: str = "churn_probability", max_cut: float = 0.30) -> DataFrame:
    """Cost and action text of searched counterfactuals, worked out inside the row.

    A price cut above ``max_cut`` is no offer: it brings neither action nor cost, and a counterfactual without any
    action left goes.  New p is floored at 0.05, the reduction at 0."""
    j = cf.join(base.select(key, F.col("monthly_charges").alias("_old_mc"), p0).hint("merge"), key)  # as in the search: never broadcast
    new, old = F.col("monthly_charges"), F.col("_old_mc")
    cut = F.when(F.array_contains("changed", "monthly_charges") & (new < old), (old - new) / F.greatest(old, F.lit(1.0)))
    parts = [F.struct(F.when(cut <= max_cut, F.concat(F.lit("Reduce monthly price by "), F.round(cut * 100).cast("int"), F.lit("%"))).alias("a"),
                      ((old - new) * CF_ACTIONS["monthly_charges"][1]).alias("c")),
             F.struct(F.when(F.array_contains("changed", "monthly_charges") & cut.isNull(), F.lit(CF_ACTIONS["monthly_charges"][0].replace(" by {pct}%", ""))).alias("a"),
                      F.lit(CF_ACTIONS["monthly_charges"][1]).alias("c"))]
    parts += [F.struct(F.when(F.array_contains("changed", f), F.lit(a)).alias("a"), F.lit(c).alias("c")) for f, (a, c) in CF_ACTIONS.items() if f != "monthly_charges"]
    named = F.filter(F.array(*parts), lambda x: x["a"].isNotNull())
    other = F.transform(F.array_except("changed", F.array(*[F.lit(f) for f in CF_ACTIONS])), lambda f: F.struct(F.concat(F.lit("Change "), f).alias("a"), F.lit(10.0).alias("c")))
    j = j.withColumn("_m", F.concat(named, other)).filter(F.size("_m") > 0)
    return j.select(key, "cand", F.aggregate("_m", F.lit(0.0), lambda s, x: s + x["c"]).alias("cost_usd"),
                    F.array_join(F.array_sort(F.transform("_m", lambda x: x["a"])), "; ").alias("actions"), F.coalesce(cut, F.lit(0.0)).alias("price_cut"),
                    F.greatest(F.col("new_churn_prob"), F.lit(0.05)).alias("new_churn_prob"), p0,
                    F.greatest(F.col(p0) - F.col("new_churn_prob"), F.lit(0.0)).alias("churn_prob_reduction"))


def top_names(attrib: str | Column, k: int) -> Column:
    """Names of the ``k`` strongest features of a row's (feature, value) array, by |value|."""
    ranked = F.array_sort(F.transform(attrib, lambda x: F.struct((-F.abs(x["value"])).alias("a"), x["feature"].alias("f"))))
    return F.slice(F.transform(ranked, lambda x: x["f"]), 1, k)


def rank_correlation(a: Column, b: Column) -> Column:
    """Positional Spearman over the features that two top lists share, clamped to [-1, 1]; 0 if they share none."""
    both = F.array_intersect(a, b)
    n = F.size(both).cast("double")
    d2 = F.aggregate(both, F.lit(0.0), lambda s, f: s + F.pow(F.array_position(a, f) - F.array_position(b, f), 2))
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - 6 * d2 / (n * (n * n - 1) + 1e-9)))).otherwise(F.lit(0.0))


def attrib_stability(rows: DataFrame, neighbours: DataFrame, k: int = 5, key: str = "customer_id",
                     query: str = "query_id", neighbour: str = "customer_id") -> DataFrame:
    """Per explained row: mean positional correlation of its top-``k`` features with those of its neighbours.

    ``rows``: key and ``attrib`` (:func:`attrib_rows`); ``neighbours``: (query, neighbour) pairs of a kNN operator."""
    top = rows.select(F.col(key).alias("_n"), top_names("attrib", k).alias("_t"))
    pairs = neighbours.select(F.col(query).alias("_q"), F.col(neighbour).alias("_n")).join(top, "_n")
    own = top.select(F.col("_n").alias("_q"), F.col("_t").alias("_own"))
    return pairs.join(own, "_q").groupBy(F.col("_q").alias(query)).agg(F.avg(rank_correlation(F.col("_own"), F.col("_t"))).alias("stability"))
