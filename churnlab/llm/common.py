"""Shared pieces: scratch folders in spark.checkpoint.dir, file access by URI, ordered segments, exact digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.session import cut_lineage, ensure_checkpoint_dir

__all__ = ["cut_lineage", "scratch_uri", "open_fs", "texts_of", "fresh", "hash128", "tokenizer_path"]


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A new folder URI below the shared checkpoint folder (never a machine-local folder on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if "://" not in base:
        base = "file://" + base.removeprefix("file:")
    return f"{base}/llm/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str):
    """(pyarrow filesystem, path) for a URI; works inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only: extra columns cannot clash with an operator's own, a null text becomes empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def hash128(c):
    """Two 64-bit hashes with different seeds: one atomic decimal-free key pair for exact-match grouping."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
