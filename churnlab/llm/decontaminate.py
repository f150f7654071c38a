"""Benchmark decontamination with DataFrame functions only.

Test items become a set of normalised word windows (``n`` words, or the whole item where it has fewer).  Training
texts are scanned once: each row's words, then one hash per window, exploded against the broadcast set; a hash that
matches is verified against the window's words.  The first exploded element of a row is no window: it carries the row
through, so texts without a hit need no second scan.

Rows: repeated (doc_id, text) rows give one result row, one doc_id with different texts one per text.  Null or
wordless texts and items have no windows.  An empty benchmark hits nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, hash128

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing: what is between words
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # in the text as it is
#: The set is broadcast up to this size; beyond it the windows are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), _BREAKS), "")


def _windows(w: Column, length: int) -> Column:
    """One hash per window of ``length`` words."""
    n = F.size(w) - (length - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, length)))
                  ).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """length, hash, gram, items (sorted ids as strings): one row per distinct window."""
    b = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    b = b.withColumn("length", F.least(F.lit(n), F.size("w")))
    grams = b.select("item", "length", F.explode(F.expr("transform(sequence(1, size(w) - length + 1), i -> slice(w, i, length))")).alias("g"))
    return (grams.groupBy("length", F.xxhash64("g").alias("hash"), F.concat_ws(" ", "g").alias("gram"))
            .agg(F.sort_array(F.collect_set("item")).alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, t1, t2 (text hashes), n_words, n_hit (words inside a hit), items, spans (start word, words) of hits."""
    windows = cut_lineage(benchmark_windows(benchmark, n, item_col, item_text_col))
    lengths = sorted((r[0] for r in windows.select("length").distinct().collect()), reverse=True)  # n values at most
    size = windows.agg(F.coalesce(F.sum(F.length("gram") * 4 + 64 + F.size("items") * 32), F.lit(0))).first()[0]
    probe = windows.select("length", "hash", "gram", "items")
    if size <= BROADCAST_BYTES:
        probe = F.broadcast(probe)

    t1, t2 = hash128(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), t1.alias("t1"), t2.alias("t2"), words(F.col(text_col)).alias("w"))
    none = F.array(F.lit(None).cast("long"))
    # bound once per row: array(w) -> transform, so that the words are not split again for every window
    hashes = F.transform(F.array("w"), lambda w: F.concat(none, *[_windows(w, k) for k in lengths]))[0]
    rows = rows.select("doc_id", "t1", "t2", "w", F.size("w").alias("n_words"), hashes.alias("h"))
    at = rows.select("doc_id", "t1", "t2", "w", "n_words", F.posexplode("h").alias("at", "h"))
    before = F.lit(0)
    start = F.lit(None).cast("int")
    for k in lengths:  # the windows of each length follow one another
        start = F.when(F.col("length") == k, F.col("at") - 1 - before).otherwise(start)
        before = before + F.greatest(F.col("n_words") - (k - 1), F.lit(0))
    same = (F.col("h") == F.col("hash")) & (F.concat_ws(" ", F.slice("w", F.greatest(start + 1, F.lit(1)), F.col("length"))) == F.col("gram"))
    found = at.join(probe, same, "left").filter((F.col("at") == 0) | F.col("gram").isNotNull())
    hit = F.when(F.col("gram").isNotNull(), F.struct(start.alias("start"), F.col("length").alias("n")))
    per = found.groupBy("doc_id", "t1", "t2").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(hit)).alias("spans"),
                                                  F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("n")))["n"]
    return per.select("doc_id", "t1", "t2", "n_words", covered.alias("n_hit"), F.sort_array("items").alias("items"), "spans")


def contamination_digests(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    found = contamination(docs, benchmark, n)
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) whose text holds no benchmark window."""
    bad = contamination(docs, benchmark, n, id_col, text_col).filter("n_hit > 0")
    a, b, c = (fresh(docs, x) for x in ("_id", "_t1", "_t2"))
    bad = bad.select(F.col("doc_id").alias(a), F.col("t1").alias(b), F.col("t2").alias(c))
    t1, t2 = hash128(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad[a]) & (t1 == bad[b]) & (t2 == bad[c]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; words inside a hit go, each with what separates it from the next."""
    bad = contamination(docs, benchmark, n, id_col, text_col).filter("n_hit > 0")
    a, b, c, d = (fresh(docs, x) for x in ("_id", "_t1", "_t2", "_spans"))
    bad = bad.select(F.col("doc_id").alias(a), F.col("t1").alias(b), F.col("t2").alias(c), F.col("spans").alias(d))
    t1, t2 = hash128(F.coalesce(docs[text_col], F.lit("")))
    joined = docs.join(bad, docs[id_col].eqNullSafe(bad[a]) & (t1 == bad[b]) & (t2 == bad[c]), "left")
    gaps, own = F.split(F.col(text_col), _WORD), F.regexp_extract_all(F.col(text_col), F.lit(_WORD), F.lit(0))
    gone = F.array_distinct(F.flatten(F.transform(F.col(d), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    keep = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), gone)
    kept = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(keep, lambda i: F.concat(F.get(own, i), F.get(gaps, i + 1))), ""))
    text = F.when(F.col(d).isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*[text.alias(x) if x == text_col else docs[x] for x in docs.columns])
