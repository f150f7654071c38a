"""Schema rules, row validation, quality warnings and coverage gaps.

Rules compile to ``Column`` predicates; all column rules are counted in one
aggregate pass, uniqueness is one ``groupBy(id)``.  Every violation is
reported (lazy validation), nothing stops at the first failure.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class ColumnRule:
    name: str
    dtype: str = "double"            # target type the value must cast to
    nullable: bool = True
    ge: float | None = None
    le: float | None = None
    isin: list | None = None
    unique: bool = False
    required: bool = True


@dataclass
class Rules:
    columns: list[ColumnRule] = field(default_factory=list)

    def without(self, *names: str) -> "Rules":
        return Rules([c for c in self.columns if c.name not in names])


# Customer table rules (ranges, allowed sets, nullability).
CUSTOMER_RULES = Rules([
    ColumnRule("customer_id", "string", nullable=False, unique=True),
    ColumnRule("age", nullable=False, ge=18, le=100),
    ColumnRule("tenure_months", nullable=False, ge=0, le=240),
    ColumnRule("contract_type", "string", nullable=False, isin=["Month-to-Month", "One Year", "Two Year"]),
    ColumnRule("plan_tier", "string", nullable=False, isin=["Basic", "Standard", "Premium"]),
    ColumnRule("payment_method", "string", nullable=False,
               isin=["Credit Card", "Bank Transfer", "Electronic Check", "Mailed Check"]),
    ColumnRule("monthly_charges", nullable=False, ge=0, le=500),
    ColumnRule("total_charges", ge=0),
    ColumnRule("num_support_tickets_30d", ge=0, le=100),
    ColumnRule("login_frequency_30d", ge=0),
    ColumnRule("feature_adoption_rate", ge=0.0, le=1.0),
    ColumnRule("nps_score", ge=-100, le=100),
    ColumnRule("usage_30d", ge=0),
    ColumnRule("usage_60d", ge=0),
    ColumnRule("usage_90d", ge=0),
    ColumnRule("days_since_last_login", ge=0, le=1825),
    ColumnRule("churned", "int", nullable=False, isin=[0, 1], required=False),
])
INFERENCE_RULES = CUSTOMER_RULES.without("churned")


def _checks(r: ColumnRule) -> list[tuple[str, Column]]:
    """(rule name, predicate that is TRUE when the row passes)."""
    c = F.col(r.name)
    out = []
    if not r.nullable:
        out.append((f"{r.name}:not_null", c.isNotNull()))
    if r.dtype not in ("string",):
        out.append((f"{r.name}:type_{r.dtype}", c.isNull() | c.try_cast(r.dtype).isNotNull()))
    v = c.try_cast(r.dtype) if r.dtype != "string" else c
    if r.ge is not None:
        out.append((f"{r.name}:ge_{r.ge:g}", c.isNull() | (v >= F.lit(r.ge))))
    if r.le is not None:
        out.append((f"{r.name}:le_{r.le:g}", c.isNull() | (v <= F.lit(r.le))))
    if r.isin is not None:
        out.append((f"{r.name}:isin", c.isNull() | v.isin(*r.isin)))
    return out


def _all_checks(df: DataFrame, rules: Rules):
    checks = []
    for r in rules.columns:
        if r.name not in df.columns:
            if r.required:
                raise ValueError(f"missing column {r.name}")  # never invent data for a missing column
            continue
        checks.extend(_checks(r))
    return checks


def validate_rules(df: DataFrame, rules: Rules = CUSTOMER_RULES, key: str = "customer_id") -> DataFrame:
    """One row per rule: failing rows and the smallest failing key as a sample."""
    checks = _all_checks(df, rules)
    aggs = []
    for i, (name, ok) in enumerate(checks):
        aggs.append(F.count_if(~ok).alias(f"f{i}"))
        aggs.append(F.min(F.when(~ok, F.col(key).cast("string"))).alias(f"s{i}"))
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"f{i}").alias("failing"), F.col(f"s{i}").alias("sample"))
        for i, (name, _) in enumerate(checks)])).alias("r")).select("r.*")
    uniq = [r.name for r in rules.columns if r.unique and r.name in df.columns]
    for u in uniq:
        d = df.groupBy(u).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        long = long.unionByName(d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failing"),
                                      F.min(F.col(u).cast("string")).alias("sample"))
                                .select(F.lit(f"{u}:unique").alias("rule"), "failing", "sample"))
    return long


def validate_rows(df: DataFrame, rules: Rules = CUSTOMER_RULES, key: str = "customer_id") -> DataFrame:
    """Adds ``broken`` (array of failed rule names) and ``valid``; duplicate keys are flagged too."""
    checks = _all_checks(df, rules)
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]))
    uniq = [r.name for r in rules.columns if r.unique and r.name in df.columns]
    out = df
    for u in uniq:
        dup = df.groupBy(u).agg((F.count(F.lit(1)) > 1).alias(f"_dup_{u}"))
        out = out.join(dup, u, "left")
        broken = F.when(F.col(f"_dup_{u}"), F.array_append(broken, F.lit(f"{u}:unique"))).otherwise(broken)
    return out.withColumn("broken", broken).withColumn("valid", F.size("broken") == 0).drop(*[f"_dup_{u}" for u in uniq])


def quality_warnings(df: DataFrame) -> Column:
    """Warnings array: required fields missing; monthly charge zero or negative."""
    req = ["tenure_months", "monthly_charges", "contract_type"]
    return F.array_compact(F.array(
        *[F.when(F.col(c).isNull(), F.lit(f"Missing required field: {c}")) for c in req],
        F.when(F.coalesce(F.col("monthly_charges"), F.lit(0.0)) <= 0, F.lit("monthly_charges is zero or negative"))))


def coverage_gaps(df: DataFrame, cols, min_n: int = 30) -> DataFrame:
    """(column, value, n) for segment values with fewer than min_n rows."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    t = df.select(kv.alias("_kv")).select("_kv.column", "_kv.value")
    return t.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < min_n)


def filter_status(df: DataFrame, label: str = "churned", status: str = "all", key: str = "customer_id",
                  after=None, limit: int = 50) -> DataFrame:
    """Keyset page: rows of a status with key > ``after``, ordered by key (a total order), ``limit`` rows."""
    d = df
    if status == "churned":
        d = d.filter(F.col(label) == 1)
    elif status == "active":
        d = d.filter(F.col(label) == 0)
    if after is not None:
        d = d.filter(F.col(key) > F.lit(after))
    return d.orderBy(key).limit(limit)


# Columns a client may read.
SAFE_COLUMNS = ["customer_id", "age", "tenure_months", "contract_type", "plan_tier", "payment_method", "monthly_charges",
                "total_charges", "num_support_tickets_30d", "login_frequency_30d", "feature_adoption_rate", "nps_score",
                "usage_30d", "usage_60d", "usage_90d", "days_since_last_login", "churned", "churn_probability"]


def select_safe(df: DataFrame, allowed=SAFE_COLUMNS) -> DataFrame:
    return df.select(*[c for c in allowed if c in df.columns])


def filter_target_set(df: DataFrame, ids: DataFrame | None = None, tiers=None, min_p: float = 0.70,
                      key: str = "customer_id", p: str = "churn_probability", tier_col: str = "risk_tier") -> DataFrame:
    """Explicit ids (semi join), else risk tiers, else p >= min_p.  No silent 'first n rows' fallback."""
    if ids is not None:
        return df.join(ids.select(key).distinct(), key, "left_semi")
    if tiers:
        return df.filter(F.col(tier_col).isin(*tiers))
    return df.filter(F.col(p) >= F.lit(min_p))
