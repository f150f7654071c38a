"""Line dedup with DataFrame functions only.

Every line's key is hashed (two 64-bit hashes).  Line places are range-partitioned by hash, then document and
position, and sorted so within partitions, then written.  The table read back has neither that partitioning nor that
order for Spark, so documents and first occurrence of a key come from two hash aggregates (by key and document, then by
key), not from streaming the sorted ranges.  Keys that lose lines are joined
back to the places; what each document keeps comes out as a bitmap in run lengths, never as text.

A document is a row's (doc_id, text); repeated rows count once and each gets the bitmap.  Null text is one empty
line; keys shorter than ``min_chars`` stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, hash128
from .decontaminate import ascii_lower

_STRIP = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_STRIP)))


def _places(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, t1, t2, pos: one row per line with a key, ranged and sorted, as a table."""
    t1, t2 = hash128(F.coalesce(F.col(text_col), F.lit("")))
    lines = docs.select(F.col(id_col).alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keyed = lines.select("doc_id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    h1, h2 = hash128(F.col("key"))
    order = ["h1", "h2", "doc_id", "t1", "t2", "pos"]
    ranged = keyed.select(h1.alias("h1"), h2.alias("h2"), "doc_id", "t1", "t2", "pos").repartitionByRange(*order)
    return cut_lineage(ranged.sortWithinPartitions(*order))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t1, t2, dropped (sorted array of (start, end) line runs) for the documents that lose lines.

    ``keep_first`` false: keys in at least ``min_docs`` documents lose all their lines.  True: they keep the first
    occurrence in the order of doc_id, then position."""
    places = _places(docs, id_col, text_col, min_chars)
    doc = ["doc_id", "t1", "t2"]
    once = places.groupBy("h1", "h2", *doc).agg(F.min("pos").alias("pos"))
    keys = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(*doc, "pos")).alias("first"))
    gone = keys.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "first")
    lost = places.join(gone, ["h1", "h2"])
    if keep_first:
        lost = lost.filter(~F.struct(*doc, "pos").eqNullSafe(F.col("first")))
    per = lost.select(*doc, "pos").groupBy(*doc).agg(F.sort_array(F.collect_set("pos")).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: F.coalesce(F.get("p", i + 1) != x + 1, F.lit(True)))
    return per.select(*doc, F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.struct(r["s"].alias("start"), r["e"].alias("end"))).alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines outside the dropped runs: one slice per kept run."""
    lines = lines_of(text)
    n = F.size(lines)
    edge = F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))), dropped, F.array(F.struct(n.alias("start"), n.alias("end"))))
    runs = F.transform(F.array(F.struct(lines.alias("l"), edge.alias("e"))), lambda s: F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(s["e"]) - 1), lambda i: F.slice(
            s["l"], F.get(s["e"], i - 1)["end"] + 2, F.get(s["e"], i)["start"] - F.get(s["e"], i - 1)["end"] - 1))))[0]
    return F.when(F.size(dropped) > 0, F.array_join(runs, "\n")).otherwise(F.coalesce(text, F.lit("")))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the bitmap of each row in column ``out`` (null: nothing dropped)."""
    names = [fresh(docs, x) for x in ("_id", "_t1", "_t2")]
    b = bitmaps.select(*[F.col(x).alias(y) for x, y in zip(("doc_id", "t1", "t2"), names, strict=True)], F.col("dropped").alias(out))
    t1, t2 = hash128(F.coalesce(docs[text_col], F.lit("")))
    joined = docs.join(b, docs[id_col].eqNullSafe(b[names[0]]) & (t1 == b[names[1]]) & (t2 == b[names[2]]), "left")
    return joined.drop(*names)


def drop_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the kept lines as text; a null text stays null."""
    out = fresh(docs, "_dropped")
    bitmaps = keep_bitmaps(docs, min_docs, keep_first, min_chars, id_col, text_col)
    joined = with_bitmaps(docs, bitmaps, out, id_col, text_col)
    text = F.when(F.col(out).isNull(), F.col(text_col)).otherwise(kept_text(F.col(text_col), F.col(out)))
    return joined.select(*[text.alias(x) if x == text_col else F.col(f"`{x}`") for x in docs.columns])


def line_digests(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    d = docs.select("doc_id", "text")
    joined = with_bitmaps(d, keep_bitmaps(d, min_docs), "dropped")
    lost = F.aggregate("dropped", F.lit(0), lambda a, r: a + r["end"] - r["start"] + 1)
    return joined.select("doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
                         F.coalesce(lost, F.lit(0)).cast("long").alias("n_dropped"),
                         F.sha2(kept_text(F.col("text"), F.coalesce("dropped", F.array().cast("array<struct<start:int,end:int>>"))), 256).alias("kept_sha256"),
                         F.col("dropped").alias("dropped_runs"))
