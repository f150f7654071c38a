"""Registry of named queries: Spark callable (spark, sf_dir) -> DataFrame, plus DuckDB oracle text."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []

_MODULES = [
    "churnlab.plans.q_core",
    "churnlab.plans.q_features",
    "churnlab.plans.q_metrics",
    "churnlab.plans.q_stats",
    "churnlab.plans.q_temporal",
    "churnlab.plans.q_decide",
    "churnlab.plans.q_quality",
    "churnlab.plans.q_search",
    "churnlab.plans.q_events",
    "churnlab.plans.q_streaming",
    "churnlab.plans.q_ml",
    "churnlab.plans.q_models",
    "churnlab.plans.q_sources",
]


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def load_all():
    for m in _MODULES:
        importlib.import_module(m)
    return QUERIES, ORACLE


def out(df: DataFrame, dp: int = 6) -> DataFrame:
    """Comparison form: doubles rounded, timestamps as text, decimals as double."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), dp) + F.lit(0.0)  # no negative zero
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)
