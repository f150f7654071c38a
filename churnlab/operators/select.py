"""Exact order statistics of many columns without shuffling the data.

A wanted rank is narrowed down instead of sorted for: a mergeable quantile sketch (``percentile_approx``) proposes two
edges around it, one pass counts the rows below, on and between the edges, and only the open interval that holds the
rank is looked at in the next round.  Counts are exact whatever the sketch says, so a poor edge costs a round, never a
wrong result; a hot value becomes an edge and is settled by its count.  Rows are moved (as counts per distinct value)
only once an interval holds at most ``small`` of them.  What reaches the driver is bounded by columns x ranks x grid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 400  # points a sketch is read at
ACCURACY = 10_000  # relative error 1e-4 of the sketch
SMALL = 50_000


@dataclass
class _Span:
    """Open interval (lo, hi) of a column (None: no limit) with ``n`` rows, ``below`` rows before it, ranks looked for."""
    col: str
    lo: float | None
    hi: float | None
    below: int
    n: int
    ranks: list[int]


def number(c: str) -> Column:
    return F.col(c).cast("double")


def _within(s: _Span) -> Column:
    v = number(s.col)
    cond = v.isNotNull() & ~F.isnan(v)
    if s.lo is not None:
        cond = cond & (v > F.lit(s.lo))
    if s.hi is not None:
        cond = cond & (v < F.lit(s.hi))
    return cond


def _cells(df: DataFrame, spans: list[_Span], value) -> DataFrame:
    """(s, x): for every span ``value(i, column)`` of each row inside it; a map-side unpivot."""
    cells = [F.when(_within(s), F.struct(F.lit(i).alias("s"), value(i, number(s.col)).alias("x"))) for i, s in enumerate(spans)]
    return df.select(F.explode(F.array_compact(F.array(*cells))).alias("k")).select("k.s", "k.x")


def _sketch(value: Column, grid: int) -> Column:
    """Sketch quantiles of ``value`` at ``grid`` + 1 even points (one parsed array: the points are a constant of the plan)."""
    points = F.expr("array(" + ", ".join(f"{i / grid!r}D" for i in range(grid + 1)) + ")")
    return F.percentile_approx(value, points, ACCURACY)


def sketch_grid(df: DataFrame, cols, grid: int = GRID) -> dict[str, list[float]]:
    """Distinct sketch quantiles at ``grid`` + 1 even points per column (nulls and NaN left out); one aggregate."""
    names = {c: f"q{i}" for i, c in enumerate(cols)}
    row = df.agg(*[_sketch(F.when(~F.isnan(number(c)), number(c)), grid).alias(q) for c, q in names.items()]).first()
    return {c: sorted(set(row[q] or [])) for c, q in names.items()}


def _edges(df: DataFrame, spans: list[_Span], grid: int) -> list[list[float]]:
    """Per span the sketch values on both sides of each wanted rank."""
    got = {r["s"]: r["q"] for r in _cells(df, spans, lambda i, v: v).groupBy("s").agg(_sketch(F.col("x"), grid).alias("q")).collect()}
    edges = []
    for i, s in enumerate(spans):
        q = got[i]
        near = set()
        for r in s.ranks:
            at = (r - s.below + 0.5) / s.n * grid
            near.update((q[max(0, math.floor(at) - 1)], q[min(grid, math.ceil(at) + 1)]))
        edges.append(sorted(near))
    return edges


def select_ranks(df: DataFrame, wanted: dict[str, list[int]], n: dict[str, int], small: int = SMALL, grid: int = GRID) -> dict[tuple[str, int], float]:
    """{(column, rank): value} for 0-based ranks among a column's ``n`` values that are neither null nor NaN."""
    found: dict[tuple[str, int], float] = {}
    open_, ready = [_Span(c, None, None, 0, n[c], sorted(set(rs))) for c, rs in wanted.items() if rs], []
    while open_:
        ready += [s for s in open_ if s.n <= small]
        open_ = [s for s in open_ if s.n > small]
        if not open_:
            break
        edges = _edges(df, open_, grid)
        # slot 2j: strictly between edge j-1 and edge j; slot 2j + 1: on edge j
        slot = _cells(df, open_, lambda i, v: sum((v > e).cast("int") + (v >= e).cast("int") for e in edges[i]))
        counts = {(r["s"], r["x"]): r["n"] for r in slot.groupBy("s", "x").agg(F.count(F.lit(1)).alias("n")).collect()}
        narrower = []
        for i, s in enumerate(open_):
            e, below = edges[i], s.below
            for k in range(2 * len(e) + 1):
                m = counts.get((i, k), 0)
                inside = [r for r in s.ranks if below <= r < below + m]
                if inside and k % 2:
                    found.update({(s.col, r): e[k // 2] for r in inside})
                elif inside:
                    j = k // 2
                    narrower.append(_Span(s.col, e[j - 1] if j else s.lo, e[j] if j < len(e) else s.hi, below, m, inside))
                below += m
        open_ = narrower
    if ready:
        found.update(_finish(df, ready))
    return found


def _finish(df: DataFrame, spans: list[_Span]) -> dict[tuple[str, int], float]:
    """The ranks of spans of few rows: running counts over the distinct values of each."""
    spark = df.sparkSession
    cnt = _cells(df, spans, lambda i, v: v).groupBy("s", "x").agg(F.count(F.lit(1)).alias("n"))
    cum = cnt.withColumn("c", F.sum("n").over(Window.partitionBy("s").orderBy("x")))
    want = spark.createDataFrame([(i, r - s.below) for i, s in enumerate(spans) for r in s.ranks], "i int, r long")
    hit = cum.join(F.broadcast(want), (F.col("s") == F.col("i")) & (F.col("c") - F.col("n") <= F.col("r")) & (F.col("r") < F.col("c")))
    return {(spans[h["i"]].col, h["r"] + spans[h["i"]].below): h["x"] for h in hit.select("i", "r", "x").collect()}


def exact_quantiles(df: DataFrame, cols, probs, small: int = SMALL, grid: int = GRID) -> dict[str, dict[float, float]]:
    """{column: {prob: value}}: exact linear-interpolation quantiles (the rule of SQL ``percentile`` / ``quantile_cont``).

    Nulls are left out, NaN counts as the largest value; a column without values has no entry.  ``df`` is read once to
    count, twice per round of narrowing (rows of an interval shrink about ``grid`` / 4 times a round) and once at the end."""
    cols = list(cols)
    row = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.count(c).alias(f"n{i}"), F.count_if(F.isnan(number(c))).alias(f"x{i}"))]).first()
    total = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    real = {c: row[f"n{i}"] - row[f"x{i}"] for i, c in enumerate(cols)}
    place = {c: {p: (total[c] - 1) * p for p in probs} for c in cols if total[c]}
    wanted = {c: [r for h in hs.values() for r in (math.floor(h), math.ceil(h)) if r < real[c]] for c, hs in place.items()}
    got = select_ranks(df, wanted, real, small, grid)

    def at(c, h):
        lo, hi = (got.get((c, r), math.nan) for r in (math.floor(h), math.ceil(h)))
        return lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)

    return {c: {p: at(c, h) for p, h in hs.items()} for c, hs in place.items()}
