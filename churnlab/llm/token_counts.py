"""Token counts per document from flat token files: ids end to end, an end-of-document id after each, no index.

Files are read in blocks of equal size, any number of tasks per file.  A task finds the separators of its block with
one vectorised comparison.  A document's length is the distance between two separators, which may lie in different
blocks: a prefix scan over the blocks of a file (separators so far, place of the last one) stitches the borders.

Ids after a file's last separator are a document that did not end: a row with ``ended`` false.  Two separators in a
row are an empty document (0 tokens).  An empty file gives no rows, an empty list of files an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, open_fs, scratch_uri, texts_of
from .encode import encoder


def count_flat_tokens(files: DataFrame, end_id: int, dtype: str = "<u2", block_bytes: int = 1 << 22) -> DataFrame:
    """files(file, uri, n_bytes) -> file, doc_no (from 0), n_tokens (without the separator), ended."""
    width = np.dtype(dtype).itemsize
    block = max(width, block_bytes // width * width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, uri, n_bytes, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(min(block, n_bytes - k * block) // width * width, k * block), dtype=dtype)
                seps = np.flatnonzero(ids == end_id) + k * (block // width)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64()),
                                                  pa.array([seps], pa.list_(pa.int64()))], ["file", "block", "n_ids", "seps"])

    blocks = (files.filter(f"n_bytes >= {width}")
              .select(F.col("file").cast("long").alias("file"), "uri", F.col("n_bytes").cast("long").alias("n_bytes"),
                      F.explode(F.expr(f"sequence(0L, (n_bytes - 1) div {block})")).alias("block"))
              .repartition("file", "block"))
    scanned = cut_lineage(blocks.mapInArrow(scan, "file long, block long, n_ids long, seps array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.select("file", "block", "n_ids", F.size("seps").alias("n_seps"), F.expr("try_element_at(seps, -1)").alias("last_sep"))
    scan_up_to = summary.select("file", "block", F.coalesce(F.sum("n_seps").over(before), F.lit(0)).alias("docs_before"),
                                F.coalesce(F.max("last_sep").over(before), F.lit(-1)).alias("sep_before"))
    ended = (scanned.join(scan_up_to, ["file", "block"])
             .select("file", "docs_before", F.explode(F.expr(
                 "transform(seps, (s, i) -> struct(i AS i, s - if(i = 0, sep_before, seps[i - 1]) - 1 AS n))")).alias("d"))
             .select("file", (F.col("docs_before") + F.col("d.i")).alias("doc_no"), F.col("d.n").alias("n_tokens"), F.lit(True).alias("ended")))
    rest = (summary.groupBy("file").agg(F.sum("n_seps").alias("doc_no"), (F.sum("n_ids") - F.coalesce(F.max("last_sep"), F.lit(-1)) - 1).alias("n_tokens"))
            .filter("n_tokens > 0").select("file", "doc_no", "n_tokens", F.lit(False).alias("ended")))
    return ended.union(rest)


def write_flat(df: DataFrame, tokenizer: str, end_id: int, dtype: str = "<u2", file_ids: int = 1 << 25,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes documents in input order into flat files; files(file, uri, n_bytes, doc_ids in order).

    Strings of special tokens are encoded as ordinary text, so the separator id stands for nothing else.  Each task
    writes files of its own name; the returned table, committed by Spark, lists those that count."""
    folder = scratch_uri(df.sparkSession, "flat")
    schema = pa.schema([("file", pa.int64()), ("uri", pa.string()), ("n_bytes", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer, True), TaskContext.get().partitionId(), 0
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out, docs, size, name = None, [], 0, ""

        def row():
            out.close()
            return pa.RecordBatch.from_pydict({"file": [part * 1_000_000 + seq], "uri": [f"{folder}/{name}"], "n_bytes": [size], "doc_ids": [docs]}, schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    name = f"p{part:06d}-{seq:06d}-{uuid.uuid4().hex}.bin"
                    out, docs, size = fs.open_output_stream(f"{root}/{name}"), [], 0
                ids = np.append(np.frombuffer(enc.encode(text), dtype="<u4"), end_id).astype(dtype)
                out.write(ids.tobytes())
                docs.append(doc_id)
                size += ids.nbytes
                if size >= file_ids * ids.itemsize:
                    yield row()
                    out, seq = None, seq + 1
        if out is not None:
            yield row()

    texts = texts_of(df, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(texts.mapInArrow(write, "file long, uri string, n_bytes long, doc_ids array<long>"))


def document_token_counts(df: DataFrame, tokenizer: str, end_id: int, dtype: str = "<u2", block_bytes: int = 1 << 22,
                          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens for every row: written flat, counted by the separator scan, matched by place in the file.

    Null text is empty (0 tokens); repeated rows stay separate; a null doc_id stays null."""
    files = write_flat(df, tokenizer, end_id, dtype, id_col=id_col, text_col=text_col)
    counts = count_flat_tokens(files, end_id, dtype, block_bytes)
    docs = files.select("file", F.posexplode("doc_ids").alias("doc_no", "doc_id"))
    return docs.join(counts.filter("ended"), ["file", "doc_no"]).select("doc_id", "n_tokens")
