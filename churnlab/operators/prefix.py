"""P1: running totals over a global order without putting all rows in one task.

Spark evaluates an un-partitioned ``Window.orderBy`` in a single task.  Here the
input (already reduced to distinct keys, e.g. one row per distinct score) is
cut into buckets by *literal* split points taken once with ``approxQuantile``
(a bounded list), so ties always share a bucket and a recomputed stage places
rows the same way.  Bucket totals (groups x buckets rows) get their own running
sum, and each bucket adds that offset to a window that is partitioned by the
bucket.  Hot keys are harmless: after the reduction a key is a single row.

Where rows are not reduced (a total order of key and tiebreakers), buckets are the range partitions
of the whole order instead, written out with their number, so one hot key is cut over many buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.session import cut_lineage


def split_points(df: DataFrame, key: str, n_buckets: int, rel_err: float | None = None) -> list[float]:
    if n_buckets <= 1:
        return []
    rel_err = rel_err if rel_err is not None else min(1e-3, 1.0 / (4 * n_buckets))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    pts = df.approxQuantile(key, probs, rel_err)
    return sorted(set(float(x) for x in pts if x is not None))


def bucket_of(key, splits: list[float]):
    """Index of the bucket of ``key``: number of split points <= key (ties share a bucket).
    Linear in the number of splits: for short lists only (see :func:`with_bucket`)."""
    if not splits:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s <= key))


def with_bucket(df: DataFrame, key: str, splits: list[float], out: str = "_b") -> DataFrame:
    """Add the bucket index of ``key`` (same rule as :func:`bucket_of`); long split lists use the
    JVM binary search of ``Bucketizer`` instead of one comparison per split."""
    if len(splits) <= 64:
        return df.withColumn(out, bucket_of(F.col(key), splits))
    from pyspark.ml.feature import Bucketizer
    tmp = f"{out}_in"
    b = Bucketizer(splits=[float("-inf")] + list(splits) + [float("inf")], inputCol=tmp, outputCol=f"{out}_d", handleInvalid="keep")
    r = b.transform(df.withColumn(tmp, F.col(key).cast("double")))
    return r.withColumn(out, F.col(f"{out}_d").cast("int")).drop(tmp, f"{out}_d")


def default_buckets(spark) -> int:
    """Buckets follow the cluster's shuffle width (each bucket is one window task), 32 at least."""
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    except ValueError:
        n = 200
    return max(32, n)


def ordered_buckets(df: DataFrame, order, n_buckets: int | None = None, out: str = "_b") -> DataFrame:
    """``df`` as a table with the number of its range partition over the whole ``order`` (ascending along it)."""
    n = n_buckets or default_buckets(df.sparkSession)
    return cut_lineage(df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id()).sortWithinPartitions(*order))


def prefix_sum(df: DataFrame, key: str, values: list[str], by=(), descending: bool = False,
               n_buckets: int | None = None, materialize: bool = True, prefix: str = "cum_", tiebreak=None,
               totals: bool = False, splits: list[float] | None = None) -> DataFrame:
    """Add ``cum_<v>`` = sum of ``v`` over rows with key <= current (>= if descending), per ``by`` group.

    Ties in ``key`` are summed together (range frame), so the result does not
    depend on row order.  ``materialize`` checkpoints the (reduced) input once,
    so the quantile pass and the main pass read the same stable data.
    ``totals`` adds ``tot_<v>`` per group, taken from the bucket totals (no second
    pass over the input).  ``splits`` reuses split points computed earlier (any
    increasing list keeps the result exact; only the bucket balance depends on it).
    """
    by = list(by)
    korder = F.col(key).desc() if descending else F.col(key).asc()
    if tiebreak:
        b = ordered_buckets(df, [F.col(c) for c in by] + [korder, *tiebreak], n_buckets)
    else:
        if materialize:
            df = cut_lineage(df)
        if splits is None:
            splits = split_points(df, key, n_buckets or default_buckets(df.sparkSession))
        b = with_bucket(df, key, splits)
    tot = b.groupBy(*by, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    border = F.col("_b").desc() if descending and not tiebreak else F.col("_b").asc()
    wo = Window.partitionBy(*by).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{v}").over(wo), F.lit(0)).alias(f"_o_{v}") for v in values])
    if tiebreak:
        # total order (key, tiebreak...): running sums follow it row by row
        w = Window.partitionBy(*by, "_b").orderBy(korder, *tiebreak).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        w = Window.partitionBy(*by, "_b").orderBy(korder).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    j = b.join(offs, by + ["_b"], "left")
    res = j.select(*[c for c in b.columns if c != "_b"],
                   *[(F.sum(v).over(w) + F.col(f"_o_{v}")).alias(f"{prefix}{v}") for v in values])
    if totals:
        gt = tot.groupBy(*by).agg(*[F.sum(f"_t_{v}").alias(f"tot_{v}") for v in values])
        res = res.join(gt, by, "left") if by else res.crossJoin(F.broadcast(gt))  # one row when ungrouped
    return res


def rank_avg(df: DataFrame, key: str, by=(), weight: str | None = None) -> DataFrame:
    """Average ranks with ties (1-based) per distinct key: rank = below + (n + 1) / 2.

    Input: raw rows; output: one row per (by, key) with ``n`` and ``rank``.
    """
    by = list(by)
    cnt = df.groupBy(*by, key).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    ps = prefix_sum(cnt, key, ["n"], by=by)
    return ps.withColumn("rank", (F.col("cum_n") - F.col("n")) + (F.col("n") + F.lit(1)) / F.lit(2.0)).drop("cum_n")


def exact_percentiles(df: DataFrame, value: str, probs: list[float], by=(), bounded_groups: bool = True, weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles (same rule as SQL ``percentile`` / ``quantile_cont``).

    Works on counts per distinct value plus running counts, so no group's
    values are ever held in one buffer.  The wanted ranks (groups x probs x 2
    rows) are joined to the running counts with a range condition; when the
    group list is bounded (features of a report), that side is broadcast.
    Output: (by..., prob, value).
    """
    by = list(by)
    spark = df.sparkSession
    n = F.sum(weight) if weight else F.count(F.lit(1))  # weight: rows per value of an already counted table
    cnt = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(n.alias("n"))
    cum = prefix_sum(cnt, "_v", ["n"], by=by, totals=True).withColumnRenamed("tot_n", "_N")
    tot = cum.select(*by, "_N").distinct()
    pr = spark.createDataFrame([(float(q), i) for i, q in enumerate(probs)], "prob double, _qi int")
    h = (F.col("_N") - 1) * F.col("prob")
    want = tot.crossJoin(F.broadcast(pr)).select(*by, "prob", h.alias("_h"))
    ranks = (want.select(*by, "prob", "_h", F.floor("_h").cast("long").alias("_r"), F.lit("lo").alias("_w"))
             .unionByName(want.select(*by, "prob", "_h", F.ceil("_h").cast("long").alias("_r"), F.lit("hi").alias("_w"))))
    cm = cum.alias("cm")
    sd = (F.broadcast(ranks) if bounded_groups else ranks).alias("sd")
    cond = (F.col("cm.cum_n") - F.col("cm.n") <= F.col("sd._r")) & (F.col("sd._r") < F.col("cm.cum_n"))
    for b in by:
        cond = cond & (F.col(f"cm.{b}") == F.col(f"sd.{b}"))
    hit = sd.join(cm, cond, "inner").select(*[F.col(f"sd.{b}").alias(b) for b in by], F.col("sd.prob").alias("prob"),
                                            F.col("sd._h").alias("_h"), F.col("sd._w").alias("_w"), F.col("cm._v").alias("_v"))
    g = hit.groupBy(*by, "prob", "_h").agg(F.max(F.when(F.col("_w") == "lo", F.col("_v"))).alias("lo"),
                                          F.max(F.when(F.col("_w") == "hi", F.col("_v"))).alias("hi"))
    return g.select(*by, "prob", (F.col("lo") + (F.col("_h") - F.floor("_h")) * (F.col("hi") - F.col("lo"))).alias("value"))
