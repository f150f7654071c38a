"""Survival, cohort retention and monthly series.

Everything is reduced first to counts per (group, distinct time) — bounded by
groups x distinct durations — before any ordered computation, and those
ordered computations use the bucketed running sums of
:mod:`churnlab.operators.prefix`, never a single-task global window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.operators.prefix import prefix_sum

Z975 = 1.959963984540054


def _g(by):
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


def km_table(df: DataFrame, duration: str, event: str, by=None) -> DataFrame:
    """Kaplan-Meier at each distinct time: at_risk, events, survival, Greenwood sum."""
    by = _g(by)
    t = df.select(*by, F.greatest(F.col(duration).cast("double"), F.lit(0.0)).alias("t"), F.col(event).cast("int").alias("e"))
    cnt = t.groupBy(*by, "t").agg(F.count(F.lit(1)).alias("removed"), F.sum("e").alias("d"))
    risk = prefix_sum(cnt, "t", ["removed"], by=by, descending=True).withColumnRenamed("cum_removed", "at_risk")
    full = F.col("d") >= F.col("at_risk")
    risk = risk.withColumns({
        "_log": F.when(full | (F.col("d") == 0), F.lit(0.0)).otherwise(F.log(1.0 - F.col("d") / F.col("at_risk"))),
        "_zero": full.cast("int") * (F.col("d") > 0).cast("int"),
        "_gw": F.when(full, F.lit(0.0)).otherwise(F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d")))),
    })
    cum = prefix_sum(risk, "t", ["_log", "_zero", "_gw"], by=by)
    return cum.select(*by, "t", "at_risk", "d", "removed",
                      F.when(F.col("cum__zero") > 0, F.lit(0.0)).otherwise(F.exp("cum__log")).alias("survival"),
                      F.col("cum__gw").alias("greenwood"))


def _ci(s: Column, gw: Column, z: float = Z975):
    """Exponential Greenwood (log-log) band; 1 before the first event, 0 after S reaches 0."""
    ls = F.log(s)
    v = F.sqrt(gw / (ls * ls))
    lower = F.when(s >= 1.0, 1.0).when(s <= 0.0, 0.0).otherwise(F.pow(s, F.exp(F.lit(z) * v)))
    upper = F.when(s >= 1.0, 1.0).when(s <= 0.0, 0.0).otherwise(F.pow(s, F.exp(F.lit(-z) * v)))
    return lower, upper


def km_curve(df: DataFrame, duration: str, event: str, by=None, max_t: int | None = None, ci: bool = True) -> DataFrame:
    """Survival on the integer timeline 0..max_t (default: max duration) per group, step function."""
    by = _g(by)
    tab = km_table(df, duration, event, by)
    if max_t is None:
        mx = df.agg(F.max(F.col(duration)).cast("int").alias("_mx"))  # one row
    else:
        mx = df.sparkSession.range(1).select(F.lit(int(max_t)).alias("_mx"))
    groups = tab.select(*by).distinct() if by else None
    tl = mx.select(F.explode(F.sequence(F.lit(0), F.col("_mx"))).alias("t"))
    tl = (groups.crossJoin(F.broadcast(tl)) if by else tl).withColumn("t", F.col("t").cast("double"))
    marks = tab.select(*by, "t", "survival", "greenwood", F.lit(1).alias("_src"))
    u = tl.select(*by, "t", F.lit(None).cast("double").alias("survival"), F.lit(None).cast("double").alias("greenwood"),
                  F.lit(0).alias("_src")).unionByName(marks)
    # a timeline point takes the value of the last event time <= t (an event at t itself included):
    # at equal t the event row sorts first.  Rows per group: timeline + distinct times (bounded).
    w = Window.partitionBy(*by).orderBy(F.col("t"), F.col("_src").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumns({"survival": F.coalesce(F.last("survival", True).over(w), F.lit(1.0)),
                       "greenwood": F.coalesce(F.last("greenwood", True).over(w), F.lit(0.0))}).filter(F.col("_src") == 0)
    res = u.select(*by, F.col("t").cast("int").alias("t"), "survival", "greenwood")
    if ci:
        lo, hi = _ci(F.col("survival"), F.col("greenwood"))
        res = res.withColumns({"ci_lower": lo, "ci_upper": hi})
    return res.drop("greenwood")


def km_median(df: DataFrame, duration: str, event: str, by=None) -> DataFrame:
    """First distinct time with S <= 0.5 (null if the curve never gets there)."""
    by = _g(by)
    tab = km_table(df, duration, event, by)
    return tab.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median_survival"))


def churn_projection(df: DataFrame, p: str, months: int = 12, by=()) -> DataFrame:
    """Expected churns / active customers per month from per-row constant monthly hazards.

    One aggregate pass with one sum per month (no row explosion), then unpivot.
    """
    by = list(by)
    pc = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    h = 1.0 - F.pow(1.0 - pc, F.lit(1.0 / max(months, 1)))
    aggs = []
    for m in range(1, months + 1):
        aggs.append(F.sum(h * F.pow(1.0 - h, F.lit(float(m - 1)))).alias(f"c{m}"))
        aggs.append(F.sum(F.pow(1.0 - h, F.lit(float(m)))).alias(f"a{m}"))
    wide = df.groupBy(*by).agg(*aggs)
    long = wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("month"), F.col(f"c{m}").alias("c"), F.col(f"a{m}").alias("a")) for m in range(1, months + 1)
    ])).alias("_m"))
    return long.select(*by, "_m.month", F.bround("_m.c", 1).alias("expected_churns"), F.bround("_m.a", 1).alias("expected_active"))


def _cohort_long(cells: DataFrame, cohort: str, months: int, shift: Column | None) -> DataFrame:
    spark = cells.sparkSession
    ms = spark.range(months).select(F.col("id").cast("int").alias("month"))
    size = cells.groupBy(cohort).agg(F.sum("n").alias("size"))
    lim = F.col("month") + (shift if shift is not None else F.lit(0))
    j = cells.crossJoin(F.broadcast(ms))  # months: fixed small parameter
    g = j.groupBy(cohort, "month").agg(
        F.sum(F.when(F.col("tenure") >= lim, F.col("n")).otherwise(0)).alias("observed"),
        F.sum(F.when(F.col("tenure") <= lim, F.col("churned_n")).otherwise(0)).alias("churned_by_month"))
    g = g.join(size, cohort)
    return g.select(cohort, "month", F.when(F.col("observed") > 0,
                                            F.bround(1.0 - F.col("churned_by_month") / F.col("size"), 4)).alias("retention"))


def cohort_matrix(df: DataFrame, signup: str, tenure: str, event: str, months: int = 24) -> DataFrame:
    """Long-form retention matrix: (cohort 'YYYY-MM', month 0..months-1, retention or null)."""
    d = df.filter(F.col(signup).isNotNull())
    cells = d.groupBy(F.date_format(F.col(signup), "yyyy-MM").alias("cohort"), F.col(tenure).alias("tenure")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(event) == 1, 1).otherwise(0)).alias("churned_n"))
    return _cohort_long(cells, "cohort", months, None)


def cohort_matrix_tenure(df: DataFrame, tenure: str, event: str, months: int = 24, bucket: int = 6) -> DataFrame:
    b = (F.floor(F.col(tenure) / bucket) * bucket).cast("int")
    cells = df.filter(F.col(tenure).isNotNull()).groupBy(b.alias("bucket"), F.col(tenure).alias("tenure")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(event) == 1, 1).otherwise(0)).alias("churned_n"))
    # thresholds are shifted by the bucket start
    r = _cohort_long(cells, "bucket", months, F.col("bucket"))
    return r.select(F.concat(F.lit("Cohort T+"), F.col("bucket").cast("string")).alias("cohort"), "month", "retention")


def cohort_churn_by_month(matrix: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Average over cohorts of retention[k-1] - retention[k], nulls ignored, 4 dp."""
    w = Window.partitionBy(cohort).orderBy("month")
    d = matrix.withColumn("_pc", F.lag("retention", 1).over(w) - F.col("retention")).filter(F.col("month") >= 1)
    return d.groupBy("month").agg(F.bround(F.avg("_pc"), 4).alias("avg_churn"))


def monthly_rate_series(df: DataFrame, date: str, y, by=()) -> DataFrame:
    """Mean of ``y`` per calendar month from the first to the last month; empty months are 0."""
    by = list(by)
    yc = F.col(y) if isinstance(y, str) else y
    d = df.filter(F.col(date).isNotNull()).select(*by, F.trunc(F.col(date).cast("date"), "month").alias("m"), yc.cast("double").alias("_y"))
    agg = d.groupBy(*by, "m").agg(F.avg("_y").alias("rate"))
    rng = d.groupBy(*by).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    tl = rng.select(*by, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("m"))
    r = tl.join(agg, by + ["m"], "left")
    return r.select(*by, F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("rate", F.lit(0.0)).alias("value"))


def classical_decompose(series: DataFrame, by=(), period: int = 12) -> DataFrame:
    """Additive decomposition: centred 2x12 moving average trend, mean detrended value per
    position in the cycle (centred to sum 0) as the seasonal part, and the residual."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("month")
    half = period // 2
    s = series.withColumn("_i", F.row_number().over(w) - 1)
    wr = Window.partitionBy(*by).orderBy("_i").rowsBetween(-half, half)
    lag, lead = F.lag("value", half).over(Window.partitionBy(*by).orderBy("_i")), F.lead("value", half).over(Window.partitionBy(*by).orderBy("_i"))
    trend = F.when(lag.isNotNull() & lead.isNotNull(), (F.sum("value").over(wr) - 0.5 * (lag + lead)) / float(period))
    s = s.withColumn("trend", trend).withColumn("_pos", F.pmod(F.col("_i"), F.lit(period)))
    ws = Window.partitionBy(*by, "_pos")
    s = s.withColumn("_sm", F.avg(F.col("value") - F.col("trend")).over(ws))
    # centre the cycle: subtract the mean of the per-position averages (each position once)
    s = s.withColumn("_first", F.when(F.row_number().over(ws.orderBy("_i")) == 1, F.col("_sm")))
    s = s.withColumn("seasonal", F.col("_sm") - F.avg("_first").over(Window.partitionBy(*by)))
    return s.select(*by, "month", "value", "trend", "seasonal",
                    (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def seasonality_summary(decomp: DataFrame, by=()) -> DataFrame:
    by = list(by)
    return decomp.groupBy(*by).agg(
        F.max_by("month", F.struct(F.col("seasonal"), -F.unix_timestamp(F.to_timestamp("month", "yyyy-MM")))).alias("peak_month"),
        F.max("seasonal").alias("peak_value"),
        F.min_by("month", F.struct(F.col("seasonal"), F.unix_timestamp(F.to_timestamp("month", "yyyy-MM")))).alias("trough_month"),
        F.min("seasonal").alias("trough_value"))


__all__ = ["km_table", "km_curve", "km_median", "churn_projection", "cohort_matrix", "cohort_matrix_tenure",
           "cohort_churn_by_month", "monthly_rate_series", "classical_decompose", "seasonality_summary", "math"]
