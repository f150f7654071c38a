"""Synthetic customer table, one row per key of an input table (so its size follows the data).

Every random draw is a function of (seed, key, stream name) through md5, so the
output does not depend on partitioning or on re-execution.  Normal draws use
Box-Muller, Poisson an inverse CDF, Beta a ratio of Marsaglia-Tsang gamma draws
(a fixed number of attempts expressed as columns).  Two one-row aggregates give
the min/max normalisation and the intercept of the churn logit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.session import cut_lineage

# Category shares, plan levels and churn-logit weights of the synthetic generator.
CONTRACTS = [("Month-to-Month", 0.55), ("One Year", 0.25), ("Two Year", 0.20)]
PLANS = [("Basic", 0.40), ("Standard", 0.35), ("Premium", 0.25)]
PAYMENTS = [("Credit Card", 0.30), ("Bank Transfer", 0.25), ("Electronic Check", 0.30), ("Mailed Check", 0.15)]
PLAN_CHARGE = {"Basic": 25.0, "Standard": 55.0, "Premium": 90.0}
PLAN_LOGINS = {"Basic": 10.0, "Standard": 20.0, "Premium": 35.0}
PLAN_ADOPTION = {"Basic": 0.25, "Standard": 0.55, "Premium": 0.80}
CONTRACT_RISK = {"Month-to-Month": 1.0, "One Year": 0.4, "Two Year": 0.1}


class _Draws:
    def __init__(self, key: Column, seed: int):
        self.key, self.seed = key.cast("string"), seed

    def u(self, name: str) -> Column:
        h = F.md5(F.concat_ws(":", F.lit(str(self.seed)), self.key, F.lit(name)))
        return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16 ** 13))

    def normal(self, name: str, mean=0.0, sd=1.0) -> Column:
        z = F.sqrt(-2.0 * F.log(self.u(name + "/1"))) * F.cos(2.0 * math.pi * self.u(name + "/2"))
        return F.lit(mean) + z * sd if not isinstance(mean, Column) else mean + z * sd

    def randint(self, name: str, lo: int, hi: int) -> Column:
        return F.floor(F.lit(lo) + self.u(name) * (hi - lo)).cast("double")

    def choice(self, name: str, options) -> Column:
        u = self.u(name)
        acc, expr = 0.0, None
        for v, p in options[:-1]:
            acc += p
            expr = F.when(u < acc, v) if expr is None else expr.when(u < acc, v)
        return expr.otherwise(options[-1][0])

    def poisson(self, name: str, lam: Column, kmax: int = 10) -> Column:
        u = self.u(name)
        k, cdf, term = F.lit(0), None, F.exp(-lam)
        for i in range(kmax):
            cdf = term if cdf is None else cdf + term
            k = k + (cdf < u).cast("int")
            term = term * lam / float(i + 1)
        return k.cast("double")

    def gamma(self, name: str, a: Column, attempts: int = 8) -> Column:
        """Marsaglia-Tsang for shape >= 1; the first accepted attempt wins (failure of all has p < 1e-9)."""
        d = a - 1.0 / 3.0
        c = 1.0 / F.sqrt(9.0 * d)
        res = d
        for i in reversed(range(attempts)):
            x = self.normal(f"{name}/x{i}")
            v = (1.0 + c * x) ** 3
            ok = (v > 0) & (F.log(self.u(f"{name}/u{i}")) < 0.5 * x * x + d - d * v + d * F.log(F.when(v > 0, v)))
            res = F.when(ok, d * v).otherwise(res)
        return res

    def beta(self, name: str, a: Column, b: Column) -> Column:
        x, y = self.gamma(name + "/a", a), self.gamma(name + "/b", b)
        return x / (x + y)


def _clip(c: Column, lo=None, hi=None) -> Column:
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    if hi is not None:
        c = F.least(c, F.lit(float(hi)))
    return c


def _map(col: Column, mapping: dict) -> Column:
    e = None
    for k, v in mapping.items():
        e = F.when(col == k, F.lit(v)) if e is None else e.when(col == k, F.lit(v))
    return e


def synthetic_customers(keys: DataFrame, key: str, seed: int = 42, churn_rate: float = 0.27) -> DataFrame:
    r = _Draws(F.col(key), seed)
    b = keys.select(
        F.col(key),
        F.concat_ws("-", *[F.substring(F.md5(F.concat_ws(":", F.lit(f"id{seed}"), F.col(key).cast("string"))), s, n)
                           for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]).alias("customer_id"),
        r.randint("age", 18, 76).alias("age"), r.randint("tenure", 1, 85).alias("tenure_months"),
        r.choice("contract", CONTRACTS).alias("contract_type"), r.choice("plan", PLANS).alias("plan_tier"),
        r.choice("payment", PAYMENTS).alias("payment_method"),
        r.normal("charge").alias("_zc"), r.normal("total", 0.0, 50.0).alias("_zt"), r.normal("logins").alias("_zl"),
        r.normal("nps", 0.0, 20.0).alias("_zn"), r.normal("usage", 50.0, 15.0).alias("_u90"),
        (r.u("declining") < 0.35).alias("declining"), (F.lit(0.3) + r.u("decline_rate") * 0.5).alias("_dr"),
        (F.lit(0.9) + r.u("u60") * 0.2).alias("_f60"), (F.lit(0.9) + r.u("u30") * 0.2).alias("_f30"),
        r.randint("days_hi", 30, 365).alias("_dh"), r.randint("days_lo", 0, 60).alias("_dl"),
        r.normal("logit_noise", 0.0, 0.5).alias("_noise"), r.u("label").alias("_ul"))
    monthly = _clip(_map(F.col("plan_tier"), PLAN_CHARGE) + F.col("_zc") * 8.0, 18.0, 120.0)
    b = b.withColumn("monthly_charges", monthly)
    b = b.withColumn("total_charges", _clip(F.col("tenure_months") * F.col("monthly_charges") + F.col("_zt"), 0.0))
    lam = 1.0 + F.when(F.col("contract_type") == "Month-to-Month", 1.5).otherwise(0.5) * _clip(1.0 - F.col("tenure_months") / 84.0, 0.0, 1.0) * 3.0
    b = b.withColumn("num_support_tickets_30d", _clip(r.poisson("tickets", lam), 0.0, 10.0))
    b = b.withColumn("login_frequency_30d", _clip(_map(F.col("plan_tier"), PLAN_LOGINS) + F.col("_zl") * 8.0, 0.0, 60.0))
    base = _map(F.col("plan_tier"), PLAN_ADOPTION)
    b = b.withColumn("feature_adoption_rate", _clip(r.beta("adoption", base * 5.0 + F.col("tenure_months") / 84.0 * 0.3,
                                                           (1.0 - base) * 5.0 + 0.5), 0.0, 1.0))
    b = b.withColumn("nps_score", _clip((F.col("feature_adoption_rate") - 0.5) * 160.0 - F.col("num_support_tickets_30d") * 10.0 + F.col("_zn"),
                                        -100.0, 100.0))
    b = b.withColumn("usage_90d", _clip(F.col("_u90"), 0.0, 100.0))
    b = b.withColumn("usage_60d", _clip(F.when(F.col("declining"), F.col("usage_90d") * (1.0 - F.col("_dr") * 0.4))
                                        .otherwise(F.col("usage_90d") * F.col("_f60")), 0.0, 100.0))
    b = b.withColumn("usage_30d", _clip(F.when(F.col("declining"), F.col("usage_60d") * (1.0 - F.col("_dr") * 0.4))
                                        .otherwise(F.col("usage_60d") * F.col("_f30")), 0.0, 100.0))
    b = b.withColumn("days_since_last_login", F.when(F.col("declining"), F.col("_dh")).otherwise(F.col("_dl")))
    b = cut_lineage(b)
    norm_cols = {"num_support_tickets_30d": "num_support_tickets_30d", "feature_adoption_rate": "feature_adoption_rate",
                 "login_frequency_30d": "login_frequency_30d", "days_since_last_login": "days_since_last_login",
                 "nps_shift": None, "tenure_months": "tenure_months"}
    b = b.withColumn("nps_shift", F.col("nps_score") + 100.0)
    mm = b.agg(*[F.min(c).alias(f"mn_{c}") for c in norm_cols], *[F.max(c).alias(f"mx_{c}") for c in norm_cols]).first()

    def nrm(c):
        return (F.col(c) - F.lit(mm[f"mn_{c}"])) / (F.lit(mm[f"mx_{c}"] - mm[f"mn_{c}"]) + 1e-9)

    logit = (2.5 * _map(F.col("contract_type"), CONTRACT_RISK) + 1.5 * nrm("num_support_tickets_30d") - 1.5 * nrm("feature_adoption_rate")
             - 1.2 * nrm("login_frequency_30d") + 1.8 * nrm("days_since_last_login") - 1.0 * nrm("nps_shift")
             + 1.0 * F.col("declining").cast("double") - 0.8 * nrm("tenure_months") + F.col("_noise"))
    b = b.withColumn("_logit", logit)
    mean = b.agg(F.avg("_logit").alias("m")).first()["m"]
    icpt = math.log(churn_rate / (1 - churn_rate)) - mean
    p = 1.0 / (1.0 + F.exp(-(F.col("_logit") + icpt)))
    return b.select(
        "customer_id", F.round("age", 0).cast("int").alias("age"), F.round("tenure_months", 0).cast("int").alias("tenure_months"),
        "contract_type", "plan_tier", "payment_method", F.round("monthly_charges", 2).alias("monthly_charges"),
        F.round("total_charges", 2).alias("total_charges"), F.col("num_support_tickets_30d").cast("int").alias("num_support_tickets_30d"),
        F.round("login_frequency_30d", 1).alias("login_frequency_30d"), F.round("feature_adoption_rate", 4).alias("feature_adoption_rate"),
        F.round("nps_score", 1).alias("nps_score"), F.round("usage_30d", 2).alias("usage_30d"), F.round("usage_60d", 2).alias("usage_60d"),
        F.round("usage_90d", 2).alias("usage_90d"), F.col("days_since_last_login").cast("int").alias("days_since_last_login"),
        (F.col("_ul") < p).cast("int").alias("churn"))
