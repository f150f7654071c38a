"""Keyed joins implied by lookups: edit overlay, history, subject export and erasure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.functions.features import anonymised_id

# Columns the edit overlay may change.
EDITABLE = ["contract_type", "monthly_charges", "num_support_tickets_30d", "feature_adoption_rate", "nps_score"]


def latest_edits(edits: DataFrame, key: str, editable, ts: str) -> DataFrame:
    """Per key and column the newest non-null value (a null in an edit keeps the earlier value)."""
    return edits.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in editable])


def overlay_updates(base: DataFrame, edits: DataFrame, key: str = "customer_id", editable=EDITABLE, ts: str = "updated_at") -> DataFrame:
    e = latest_edits(edits, key, editable, ts).select(key, *[F.col(c).alias(f"_e_{c}") for c in editable])
    j = base.join(e, key, "left")
    return j.select(*[F.coalesce(F.col(f"_e_{c}"), F.col(c)).alias(c) if c in editable else F.col(c) for c in base.columns])


ROW_GROUP_BYTES = 8 << 20


def cluster_for_lookup(df: DataFrame, key: str, path: str, files: int | None = None,
                       row_group_bytes: int = ROW_GROUP_BYTES, row_group_keys: int = 100_000) -> DataFrame:
    """``df`` as a table at ``path`` made for point lookups by ``key``; write it once, read it many times.

    Rows are ranged and sorted by key, so the key ranges of row groups and pages do not overlap and a lookup reads the
    one group (of a repeated key: the few groups) that can hold it.  Bloom filters on the key turn away keys that lie inside
    a group's range but do not occur (``row_group_keys``: keys expected in a group, sizes its filter).  Ranges are cut by rows, a hot key is spread over several files by a hash of the row."""
    spread = F.xxhash64(*[c for c in df.columns if c != key]) if len(df.columns) > 1 else F.lit(0)
    ranged = df.repartitionByRange(*([files] if files else []), F.col(key), spread).sortWithinPartitions(key)
    (ranged.write.mode("overwrite").option("parquet.bloom.filter.enabled", "false").option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{key}", str(row_group_keys)).option(f"parquet.enable.dictionary#{key}", "false")
     .option("parquet.block.size", str(row_group_bytes)).parquet(path))
    return df.sparkSession.read.parquet(path)


def lookup_by_id(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the equality filter reaches the parquet scan.  On a table of :func:`cluster_for_lookup` it skips every
    row group but those that may hold the key; on an unsorted table all groups whose range covers it are read."""
    return df.filter(F.col(key) == F.lit(value))


def history_top_n(df: DataFrame, key: str, ts: str, n: int = 20, tiebreak: str | None = None) -> DataFrame:
    """Newest n rows per key (``row_number <= n`` lets Spark prune per partition before the shuffle)."""
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def subject_export(subjects: DataFrame, logs: DataFrame, key: str, pii=()) -> DataFrame:
    """All records of each subject in long form (one row per record, PII columns dropped); a subject
    without records keeps one row with null record fields.  No per-subject array: a subject holding
    a third of all records must not become one row."""
    base = subjects.select(*[c for c in subjects.columns if c not in pii])
    recs = logs.select(key, *[c for c in logs.columns if c not in pii and c != key])
    return base.join(recs, key, "left")


def subject_counts(export: DataFrame, key: str, record_key: str) -> DataFrame:
    return export.groupBy(key).agg(F.count(record_key).alias("n_records"))


def erase_apply(df: DataFrame, erasures: DataFrame, key: str, pii) -> DataFrame:
    """Erased subjects: key replaced by its anonymised id, PII columns nulled; others unchanged."""
    er = erasures.select(key).distinct().withColumn("_erased", F.lit(True))
    j = df.join(er, key, "left")
    gone = F.coalesce(F.col("_erased"), F.lit(False))
    cols = []
    for c in df.columns:
        if c == key:
            cols.append(F.when(gone, anonymised_id(F.col(key))).otherwise(F.col(key).cast("string")).alias(key))
        elif c in pii:
            cols.append(F.when(gone, F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def erase_exclude(df: DataFrame, erasures: DataFrame, key: str) -> DataFrame:
    return df.join(erasures.select(key), key, "left_anti")


def erase_status(df: DataFrame, erasures: DataFrame, key: str) -> DataFrame:
    e = erasures.select(key, *[F.col(c) for c in erasures.columns if c != key]).dropDuplicates([key])
    return df.select(key).join(e, key, "left").withColumn("erased", F.col(e.columns[1]).isNotNull() if len(e.columns) > 1 else F.lit(False))
