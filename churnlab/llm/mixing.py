"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; its documents then have the same fractional number of copies,
target / words of the source.  Whole copies are taken at once.  The fractions are rounded by the pivotal method on
words: two documents meet, and words move from one to the other, in a random direction that keeps both expectations,
until one of them is in or out as a whole.  The sum of words stays what it was, so a source misses its target by less
than one document.

Documents meet in a random order inside buckets that depend on their key alone; a bucket is streamed with one open
document at a time.  The open documents of the buckets meet in the same way, ``fan`` at a time, level by level, until
each source has one left, which a random number decides.  Random numbers are hashes of (seed, key, level): reruns
and other partitionings give the same rows.

Null text has no words; documents without words are taken with no words.  A null source is a source of its own, the
last.  Exactly repeated rows are rows of their own; they share a bucket.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, fresh

# fixed values of the contract
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
#: documents per bucket on average, and open documents that meet in one group of the tree
BUCKET, FAN = 4096, 64
_BLANK = " \t\n\x0b\f\r"
_OPEN = "source_no long, bucket long, doc_id string, size long, h long, extra double"  # ids as text: pandas has no nullable long


def n_words(text):
    """Number of runs without a blank; each run becomes one letter, so memory stays that of the text."""
    return F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), _BLANK, "")).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with ``source_no`` from 0 by code point (null last): ranges of the names, then offsets of the ranges."""
    order = F.asc_nulls_last("source")
    part = cut_lineage(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return part.withColumn("r", own).join(offsets, "part").select("source", "source_size", "n_docs", (F.col("r") - 1 + F.col("n0")).alias("source_no"))


def source_targets(sources: DataFrame, weights=WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, source_no, target); ``sources`` has the first three.

    Targets share ``percent`` of all words by weight; who would get more than ``most`` times its words gets just that, and
    the rest is shared again until nobody is above.  A round is one aggregate; the sums are whole numbers."""
    numbered = cut_lineage(_numbered(sources))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")
    t = numbered.withColumn("w", weight)
    total = t.agg(F.sum("source_size")).first()[0] or 0
    if percent > 100 * most:
        raise ValueError("targets above what the sources may give")
    per_weight, capped = None, -1
    while True:  # words per unit of weight grow, so a capped source stays capped
        full = F.lit(False) if per_weight is None else F.col("w") * F.lit(per_weight) > most * F.col("source_size")
        row = t.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("w"))), F.sum(F.when(full, 1).otherwise(0))).first()
        given, open_weight, n = (x or 0 for x in row)
        if n == capped or open_weight == 0:
            break
        capped, per_weight = n, (total * percent / 100 - most * given) / open_weight
    limit = (most * F.col("source_size")).cast("double")
    target = limit if per_weight is None else F.least(F.col("w") * F.lit(float(per_weight)), limit)
    return t.select("source", "source_size", "n_docs", "source_no", target.alias("target"))


def _meet(keys: list[str], seed: int, level: int):
    """Streams rows sorted by ``keys``: rows of a group meet one after the other; ``extra`` is the expected further copy.

    Rows come out as they are decided, 0 or 1; a group's last open one comes out with its fraction."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        def draw(no, doc, h):
            return (xxhash.xxh64_intdigest(f"{seed}:{level}:{no}:{doc}:{h}") >> 11) / float(1 << 53)

        group, held, done = None, None, []
        for frame in frames:
            for row in frame.itertuples(index=False):
                g = tuple(getattr(row, k) for k in keys)
                if g != group:
                    if held is not None:
                        done.append(held)
                    group, held = g, None
                no, bucket, doc, size, h, extra = row.source_no, row.bucket, row.doc_id, row.size, row.h, row.extra
                if extra <= 0.0 or extra >= 1.0 or size == 0:
                    done.append((no, bucket, doc, size, h, extra if size else 0.0))
                    continue
                if held is None:
                    held = (no, bucket, doc, size, h, extra)
                    continue
                have, come = held[3] * held[5], size * extra
                gain, loss = min(held[3] - have, come), min(have, size - come)  # what the held one can get, and give
                if draw(no, doc, h) * (gain + loss) < loss:
                    have, come = have + gain, come - gain
                else:
                    have, come = have - loss, come + loss
                pair = []
                for (a, b, c, s, e, _), words in ((held, have), ((no, bucket, doc, size, h, extra), come)):
                    x = words / s
                    pair.append((a, b, c, s, e, 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x))
                done += [p for p in pair if p[5] in (0.0, 1.0)]
                still = [p for p in pair if p[5] not in (0.0, 1.0)]
                held = still[0] if still else None
            if done:
                yield pd.DataFrame(done, columns=["source_no", "bucket", "doc_id", "size", "h", "extra"])
                done = []
        if held is not None:
            yield pd.DataFrame([held], columns=["source_no", "bucket", "doc_id", "size", "h", "extra"])

    return run


def _rounded(rows: DataFrame, group: list[str], order: list[str], seed: int, level: int) -> DataFrame:
    placed = rows.repartition(*group).sortWithinPartitions(*group, *order)
    return placed.select("source_no", "bucket", "doc_id", "size", "h", "extra", *[g for g in group if g not in ("source_no", "bucket")]).mapInPandas(
        _meet(group, seed, level), _OPEN)


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
                percent: int = SHARE_PERCENT, most: int = MOST_COPIES, seed: int = 42, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """doc_id, size, source, source_size, target, copies: one row per document; ``copies`` <= ``most``."""
    docs = cut_lineage(df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(n_words(F.col(text_col)), F.lit(0).cast("long")).alias("size"),
                                 F.col(source_col).cast("string").alias("source")))
    per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = cut_lineage(source_targets(per_source, weights, percent, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = F.col("d.source").eqNullSafe(F.col("t.source"))
    h = F.xxhash64(F.lit(seed).cast("long"), F.coalesce("doc_id", F.lit(-1).cast("long")), "size")
    rows = docs.alias("d").join(targets.alias("t"), known).select(
        "source_no", F.pmod(h, F.ceil(F.col("n_docs") / bucket)).alias("bucket"), F.col("doc_id").cast("string").alias("doc_id"), "size",
        F.xxhash64(F.lit(seed + 1).cast("long"), F.coalesce("doc_id", F.lit(-1).cast("long")), "size").alias("h"), (rate - F.floor(rate)).alias("extra"))
    met = cut_lineage(_rounded(rows, ["source_no", "bucket"], ["h", "doc_id", "size"], seed, 0))
    left = met.filter("extra > 0 AND extra < 1")  # at most one row a bucket
    decided, level, buckets = None, 0, (targets.agg(F.max("n_docs")).first()[0] or 0) // bucket + 1
    while True:
        level, buckets = level + 1, -(-buckets // fan)
        nodes = left.withColumn("node", F.floor(F.col("bucket") / F.lit(fan ** level)).cast("long"))
        got = cut_lineage(_rounded(nodes, ["source_no", "node"], ["bucket"], seed, level))
        closed = got.filter("extra = 0 OR extra = 1")
        decided = closed if decided is None else decided.unionByName(closed)
        left = got.filter("extra > 0 AND extra < 1")
        if buckets <= 1:
            break
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2).cast("long"), "source_no", "doc_id", "h"), 11) / F.lit(float(1 << 53))
    decided = decided.unionByName(left.withColumn("extra", (u < F.col("extra")).cast("double")))
    rounded = met.filter("extra = 0 OR extra = 1").unionByName(decided)
    return rounded.join(targets.withColumn("whole", F.floor(rate)), "source_no").select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "source", "source_size", "target", (F.col("whole") + F.col("extra")).cast("long").alias("copies"))


def mixed_documents(df: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``df``, each as often as ``mix`` (a result of :func:`mix_sources`) takes it, with its number.

    Rows with the same id, source and words are told apart by a running number, in the order of a hash of their text."""
    copy, k = fresh(df, "copy"), fresh(df, "k")
    keys = [fresh(df, x) for x in ("mix_id", "mix_size", "mix_source")]
    rows = df.withColumns({keys[0]: F.col(id_col).cast("long"), keys[1]: F.coalesce(n_words(F.col(text_col)), F.lit(0).cast("long")), keys[2]: F.col(source_col).cast("string")})
    rows = rows.withColumn(k, F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(text_col))))
    same = Window.partitionBy("doc_id", "size", "source").orderBy("copies")
    taken = mix.withColumn("k", F.row_number().over(same)).filter("copies > 0").alias("m")
    on = F.lit(True)
    for a, b in zip([*keys, k], ["doc_id", "size", "source", "k"], strict=True):
        on = on & F.col(f"r.`{a}`").eqNullSafe(F.col(f"m.{b}"))
    return rows.alias("r").join(taken, on).select(*[F.col(f"r.`{c}`") for c in df.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("m.copies"))).alias(copy))


def mix_digests(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix_sources(df).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
