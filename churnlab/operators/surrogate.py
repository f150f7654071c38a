"""Local surrogates on conditions: "tenure in its second quartile", "contract = One Year".

Each explained row gets ``n`` neighbours drawn column by column from the training table: a quartile bin by its
frequency, then a normal draw truncated to the bin (mean, deviation and range of its training values); a category by its
frequency.  A neighbour is described by one 0/1 feature per column, 1 where it meets the row's own condition, and a
ridge fit weighted by closeness on these features gives one weight per condition.  Draws are hashes of (seed, key, number,
column), so results do not depend on partitioning; sums are Spark aggregates and only a small system per row is solved
in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.operators.explain import hash_uniform
from churnlab.operators.select import exact_quantiles

POINTS = 128  # steps of a bin's quantile table, read with linear interpolation
MAX_CATEGORIES = 256  # values of a category are listed in the plan


@dataclass
class Binned:
    """Fitted on the training table: quartile edges, share and quantile table per bin, shares per category."""
    mean: dict[str, float]
    edges: dict[str, list[float]]
    share: dict[str, list[float]]
    table: dict[str, list[list[float]]]
    values: dict[str, list[str]]


def bin_index(v: Column, edges: list[float]) -> Column:
    """Number of edges below the value: bins are (lower, upper]."""
    return sum(((v > e).cast("int") for e in edges), F.lit(0))


def truncated_table(mean: float, sd: float, lo: float, hi: float, points: int = POINTS) -> list[float]:
    """Quantiles of the normal (mean, sd) cut to [lo, hi] at even steps; a bin of one value holds that value."""
    if sd <= 0 or hi <= lo:
        return [min(max(mean, lo), hi)] * (points + 1)
    z = NormalDist(mean, sd)
    a, b = z.cdf(lo), z.cdf(hi)
    inner = [z.inv_cdf(min(max(a + (b - a) * i / points, 1e-15), 1 - 1e-15)) for i in range(1, points)]
    return [lo, *[min(max(x, lo), hi) for x in inner], hi]


def fit_binned(train: DataFrame, cols, cats=()) -> Binned:
    """Three passes over ``train``; what comes back is bounded by columns x (bins or categories)."""
    cols, cats = list(cols), list(cats)
    q = exact_quantiles(train, cols, [0.25, 0.5, 0.75])
    empty = [c for c in cols if c not in q]
    if empty:
        raise ValueError(f"no training values in {empty}")
    edges = {c: sorted(set(q[c].values())) for c in cols}
    num = [F.struct(F.lit(c).alias("c"), bin_index(F.col(c), edges[c]).cast("string").alias("b"), F.col(c).cast("double").alias("v")) for c in cols]
    cat = [F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("b"), F.lit(0.0).alias("v")) for c in cats]
    long = train.select(F.explode(F.array(*num, *cat)).alias("k")).select("k.*").filter(F.col("v").isNotNull())
    got = long.groupBy("c", "b").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows: dict[str, list] = {}
    for r in got.limit((len(cols) * 4) + len(cats) * (MAX_CATEGORIES + 1)).collect():
        rows.setdefault(r["c"], []).append(r)
    fit = Binned({}, edges, {}, {}, {})
    for c in cols:
        at = {int(r["b"]): r for r in rows[c]}
        total = sum(r["n"] for r in at.values())
        fit.mean[c] = sum(r["n"] * r["m"] for r in at.values()) / total
        fit.share[c] = [at[b]["n"] / total if b in at else 0.0 for b in range(len(edges[c]) + 1)]
        # a bin without training values has share 0 and is never drawn
        fit.table[c] = [truncated_table(at[b]["m"], at[b]["s"], at[b]["lo"], at[b]["hi"]) if b in at else [0.0] * (POINTS + 1)
                        for b in range(len(edges[c]) + 1)]
    for c in cats:
        rs = sorted(rows[c], key=lambda r: r["b"])
        if len(rs) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} values")
        total = sum(r["n"] for r in rs)
        fit.values[c], fit.share[c] = [r["b"] for r in rs], [r["n"] / total for r in rs]
    return fit


def _pick(u: Column, share: list[float]) -> Column:
    """Index drawn by ``share`` from a uniform; shares of 0 are never drawn."""
    return sum(((u >= F.lit(float(x))).cast("int") for x in np.cumsum(share)[:-1]), F.lit(0))


def neighbours(df: DataFrame, fit: Binned, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows per row of ``df``: key, _i, drawn columns, other columns as they are, ``_f_<column>`` 0/1 features.  Number
    0 is the row itself.  A missing number counts as the training mean, a missing category as ''."""
    cols, cats = list(fit.edges), list(fit.values)
    other = [c for c in df.columns if c not in cols and c not in cats and c != key]
    own = df.select(key, *other, *[F.coalesce(F.col(c).cast("double"), F.lit(fit.mean[c])).alias(c) for c in cols],
                    *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cats])
    own = own.select("*", *[bin_index(F.col(c), fit.edges[c]).alias(f"_o_{c}") for c in cols])
    nb = own.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def u(c, what):
        return hash_uniform(F.lit(seed), F.col(key), F.col("_i"), F.lit(c), F.lit(what))

    nb = nb.select("*", *[u(c, "bin").alias(f"_p_{c}") for c in [*cols, *cats]])
    drawn = nb.select("*", *[F.when(F.col("_i") == 0, F.col(f"_o_{c}")).otherwise(_pick(F.col(f"_p_{c}"), fit.share[c])).alias(f"_b_{c}") for c in cols],
                      *[F.when(F.col("_i") == 0, F.col(c)).otherwise(F.get(F.array(*[F.lit(x) for x in fit.values[c]]), _pick(F.col(f"_p_{c}"), fit.share[c]))).alias(f"_b_{c}") for c in cats],
                      *[(u(c, "value") * POINTS).alias(f"_u_{c}") for c in cols])

    def value(c):
        flat = _numbers([float(x) for t in fit.table[c] for x in t])
        j = F.floor(f"_u_{c}").cast("int") + F.col(f"_b_{c}") * (POINTS + 1)
        a, b = F.get(flat, j), F.get(flat, j + 1)
        return F.when(F.col("_i") == 0, F.col(c)).otherwise(a + (F.col(f"_u_{c}") - F.floor(f"_u_{c}")) * (b - a))

    return drawn.select(key, "_i", *other, *[value(c).alias(c) for c in cols], *[F.col(f"_b_{c}").alias(c) for c in cats],
                        *[(F.col(f"_b_{c}") == F.col(f"_o_{c}")).cast("double").alias(f"_f_{c}") for c in cols],
                        *[(F.col(f"_b_{c}") == F.col(c)).cast("double").alias(f"_f_{c}") for c in cats])


def _numbers(values: list[float]) -> Column:
    return F.expr("array(" + ", ".join(f"double('{x!r}')" for x in values) + ")")  # folded to one constant of the plan


def conditions(df: DataFrame, fit: Binned) -> Column:
    """array<string>: the row's own condition per column, numbers first."""
    out = []
    for c, e in fit.edges.items():
        names = [f"{c} <= {e[0]:.6g}", *[f"{a:.6g} < {c} <= {b:.6g}" for a, b in zip(e, e[1:], strict=False)], f"{c} > {e[-1]:.6g}"]
        out.append(F.get(F.array(*[F.lit(x) for x in names]), bin_index(F.coalesce(F.col(c).cast("double"), F.lit(fit.mean[c])), e)))
    return F.array(*out, *[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fit.values])


def surrogate_binned(df: DataFrame, cols, score_fn, cats=(), n: int = 5000, seed: int = 42, key: str = "customer_id",
                     train: DataFrame | None = None, ridge: float = 1.0, fit: Binned | None = None) -> DataFrame:
    """Per row of ``df`` (unique key): intercept, weights and conditions (arrays, in the order of ``cols`` then ``cats``),
    local_pred (the fit at the row itself).  Closeness is sqrt(exp(-m / w^2)) with m the conditions not met and
    w = 0.75 sqrt(columns).  An empty table gives no rows; training without values raises."""
    fit = fit or fit_binned(df if train is None else train, cols, cats)
    names = [*fit.edges, *fit.values]
    d = len(names)
    sc = score_fn(neighbours(df, fit, n, seed, key))
    f = [F.lit(1.0), *[F.col(f"_f_{c}") for c in names]]
    w = F.exp(-(F.lit(float(d)) - sum(f[1:])) / F.lit(2 * 0.5625 * d))
    g = sc.withColumn("_w", w).groupBy(key).agg(*[F.sum(F.col("_w") * f[a] * f[b]).alias(f"a_{a}_{b}") for a in range(d + 1) for b in range(a, d + 1)],
                                                *[F.sum(F.col("_w") * f[a] * F.col("p")).alias(f"b_{a}") for a in range(d + 1)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = np.zeros((len(pdf), d + 1, d + 1))
            for i in range(d + 1):
                for j in range(i, d + 1):
                    a[:, i, j] = a[:, j, i] = pdf[f"a_{i}_{j}"]
            a[:, 1:, 1:] += ridge * np.eye(d)
            coef = np.linalg.solve(a, pdf[[f"b_{i}" for i in range(d + 1)]].to_numpy()[..., None])[..., 0]
            yield pd.DataFrame({"k": pdf[key], "intercept": coef[:, 0], "weights": list(coef[:, 1:]), "local_pred": coef.sum(1)})

    kind = df.schema[key].dataType.simpleString()
    solved = g.mapInPandas(solve, f"k {kind}, intercept double, weights array<double>, local_pred double")
    own = df.select(F.col(key).alias("k"), conditions(df, fit).alias("conditions"))
    return solved.join(own, "k").withColumnRenamed("k", key)
