"""Contiguous shards of near-equal bytes from global prefix sums.

Rows (narrow: no text) are range-partitioned into one global order and written with their partition number; the
totals per partition, prefix-summed, are the offset of every partition, and a running sum inside each adds the rest.
Shards are cut at equal targets of the global sum.

With ``group`` the order is by group, so that rows of a group lie together, and a cut that would fall into a group
moves to its nearer end.  Groups that weigh more than 1/32 of a shard come first, the heaviest first (at most 32 per
shard, whatever the input), so that the cuts between the rest find small groups.  Only a group above a whole shard's
target is cut inside: kept whole it would make the shards unequal.

Null text has no bytes; repeated rows are rows of their own; a null id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, fresh

HEAVY = 32


def _running(rows: DataFrame, order: list[Column], size: str) -> tuple[DataFrame, str, str]:
    """rows with two new columns, and their names: rows and bytes ahead of each in the global order."""
    part, n0, b0, r, s, pos, before = (fresh(rows, f"shard_{x}") for x in ("part", "n0", "b0", "r", "s", "pos", "before"))
    placed = cut_lineage(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    totals = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(part, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(n0), F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias(b0))
    own = Window.partitionBy(part).orderBy(*order)
    inside = placed.select("*", F.row_number().over(own).alias(r), F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias(s))
    out = (inside.join(F.broadcast(offsets), part)  # one row per partition of the range exchange
           .withColumn(pos, (F.col(n0) + F.col(r) - 1).cast("long"))
           .withColumn(before, (F.col(b0) + F.col(s) - F.col(size)).cast("long"))
           .drop(part, n0, b0, r, s))
    return out, pos, before


def shard_by_bytes(df: DataFrame, size: str, key: str, n_shards: int = 16, group: list[str] | None = None) -> DataFrame:
    """df with shard (0 .. n_shards - 1) and slot (gapless from 0 in each shard, in the global order).

    ``key`` orders rows (within their group); ``group`` lists columns whose equal values stay together.  Columns that df
    already has stay: a shard or slot of its own makes the new ones ``shard_`` and ``slot_``.  A group below a shard's
    target is never cut, so a shard may hold up to two targets where all groups are that large; an empty table gives an
    empty result."""
    group = group or []
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    target = max(total / n_shards, 1e-9)
    w, shard_col, slot_col = fresh(df, "shard_weight"), fresh(df, "shard"), fresh(df, "slot")
    rows = df.withColumn(w, F.lit(0).cast("long"))
    if group:
        heavy = df.groupBy(*group).agg(F.sum(size).cast("long").alias(w)).filter(F.col(w) > target / HEAVY)  # n_shards * HEAVY rows at most
        rows = df.join(F.broadcast(heavy), group, "left").withColumn(w, F.coalesce(w, F.lit(0).cast("long")))
    order = [F.col(w).desc(), *map(F.col, group), F.col(key).asc_nulls_first()]
    placed, pos, before = _running(rows, order, size)
    placed = cut_lineage(placed)
    cuts = [target * b for b in range(1, n_shards)]
    if group:  # the groups that the cuts fall into: n_shards - 1 at most
        a, b = fresh(df, "shard_a"), fresh(df, "shard_b")
        inside = placed.select(*group, F.col(before).alias(a), (F.col(before) + F.col(size)).alias(b))
        wanted = F.lit(False)
        for c in cuts:
            wanted = wanted | ((F.col(a) < c) & (F.col(b) >= c))
        straddled = inside.filter(wanted).select(*group).distinct()
        ends = inside.join(F.broadcast(straddled), group, "left_semi").groupBy(*group).agg(F.min(a).alias(a), F.max(b).alias(b)).select(a, b).collect()
        for k, c in enumerate(cuts):
            for lo, hi in ends:
                if lo < c < hi and hi - lo <= target:
                    cuts[k] = lo if c - lo <= hi - c else hi
    middle = F.col(before) + (0 if group else F.col(size) / 2)
    shard = sum((F.when(middle >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    out, first_col = placed.withColumn(shard_col, shard.cast("int")), fresh(placed, "shard_first")
    first = out.groupBy(shard_col).agg(F.min(pos).alias(first_col))
    return out.join(F.broadcast(first), shard_col).withColumn(slot_col, (F.col(pos) - F.col(first_col)).cast("long")).drop(w, pos, before, first_col)


def document_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard; equal texts are a group."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"))
    placed = shard_by_bytes(cut_lineage(rows), "size", "doc_id", n_shards, ["g1", "g2"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
