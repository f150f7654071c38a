"""Sorts, limits, per-group top-k, set operations and seeded sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def watchlist(df: DataFrame, y: str = "churned", charge: str = "monthly_charges", n: int = 20, key: str = "customer_id") -> DataFrame:
    """Top-n churned rows by charge (TakeOrderedAndProject: a per-partition top-n, then a merge of n rows each)."""
    return df.filter(F.col(y) == 1).orderBy(F.col(charge).desc(), F.col(key).asc()).limit(n)


def recent_n(df: DataFrame, ts: str, n: int = 50, tiebreak: str | None = None) -> DataFrame:
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    return df.orderBy(*order).limit(n)


def top_k_per_group(df: DataFrame, by, order, k: int) -> DataFrame:
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def union_categories(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values present in either table with their counts on both sides (0 when absent)."""
    ca = a.groupBy(col).agg(F.count(F.lit(1)).alias("n_a"))
    cb = b.groupBy(col).agg(F.count(F.lit(1)).alias("n_b"))
    j = ca.join(cb, col, "full_outer")
    return j.select(col, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def topk_overlap(a, b, k: int):
    """|top_k(a) & top_k(b)| for two ranked arrays."""
    return F.size(F.array_intersect(F.slice(a, 1, k), F.slice(b, 1, k)))


def except_rows(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def sample_key(key: str, seed: int):
    """Deterministic pseudo-random order key from md5("seed:key") (independent of partitioning)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("bigint")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, seeded; a top-n by hash (no full sort, no driver collect)."""
    return df.withColumn("_h", sample_key(key, seed)).orderBy("_h", key).limit(n).drop("_h")
