"""Prefix sums, AUC, calibration, KM and percentiles against hand-worked or numpy answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlab.operators import metrics as M
from churnlab.operators import temporal as TM
from churnlab.operators.prefix import exact_percentiles, prefix_sum


def test_auc_all_ties_is_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "y int, p double")
    assert M.auc_roc(df, "y", "p").first()["auc_roc"] == pytest.approx(0.5)


def test_auc_symmetry_and_brute_force(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.random(400), 2)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    a = M.auc_roc(df, "y", "p").first()["auc_roc"]
    b = M.auc_roc(df.withColumn("p", -F.col("p")), "y", "p").first()["auc_roc"]
    pos, neg = p[y == 1], p[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert a == pytest.approx(brute) and a + b == pytest.approx(1.0)


@pytest.mark.parametrize("parts", [1, 2, 200])
def test_prefix_sum_partition_invariant(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rng = np.random.default_rng(7)
        k = rng.integers(0, 50, 1000)
        g = rng.integers(0, 3, 1000)
        v = rng.random(1000)
        df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(g, k, v)], "g int, k int, v double")
        cnt = df.groupBy("g", "k").agg(F.sum("v").alias("v"))
        got = {(r.g, r.k): r.cum_v for r in prefix_sum(cnt, "k", ["v"], by=["g"], n_buckets=4).collect()}
        for (gg, kk), val in got.items():
            assert val == pytest.approx(v[(g == gg) & (k <= kk)].sum())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=501), 1)
    df = spark.createDataFrame([(float(a),) for a in x], "value double")
    got = {r.prob: r.value for r in exact_percentiles(df, "value", [0.1, 0.25, 0.5, 0.9]).collect()}
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(x, q))


def test_ece_last_bin_closed(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.05), (1, 0.95)], "y int, p double")
    bins = {r.bin: r.n for r in M.calibration_bins(df, "y", "p").collect()}
    assert bins == {9: 2, 0: 1}  # p = 1.0 lands in the last bin, empty bins are absent


def test_km_hand_worked(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.0, 1), (3.0, 1), (4.0, 0)], "t double, e int")
    s = {r.t: r.survival for r in TM.km_curve(df, "t", "e").collect()}
    assert s[0] == 1.0 and s[1] == pytest.approx(0.8) and s[2] == pytest.approx(0.6) and s[3] == pytest.approx(0.3)
    assert TM.km_median(df, "t", "e").first()["median_survival"] == 3.0
    vals = [s[k] for k in sorted(s)]
    assert all(a >= b for a, b in zip(vals, vals[1:]))
