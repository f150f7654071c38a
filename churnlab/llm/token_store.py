"""Token files as directly addressable codes (DAC).

An id is split into chunks of ``width`` bits.  Level k holds the k-th chunk of every id that has one, in order; a
bitmap per level says which of its entries go on at level k + 1, and a rank directory (ones before every 512 bits)
turns an entry's place into its place one level down.  Any token is read by one chunk, one bitmap word and one
directory entry per level, without decoding a block around it.

File: magic, counts, a table of section offsets, then per level chunks | bitmap words | rank directory, and the
document section (doc ids, validity, start offsets).  Little-endian throughout.

Rows in, rows out: every input row is one document (rows that repeat stay separate, ordered by id, then text);
null text is empty, null doc_id sorts first.  An empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, open_fs, scratch_uri, texts_of
from .encode import encoder

MAGIC = b"DACTOK01"
RANK_BITS = 512


def dac_encode(ids: np.ndarray, width: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """[(chunks, bitmap words, rank directory)] by level."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    kind, mask, levels = (np.uint8 if width <= 8 else np.uint16), np.uint32((1 << width) - 1), []
    while True:
        chunks, rest = (rest & mask).astype(kind), rest >> np.uint32(width)
        more = rest != 0
        bits = np.packbits(more, bitorder="little")
        words = np.frombuffer(bits.tobytes() + b"\0" * (-len(bits) % (RANK_BITS // 8)), dtype="<u8")
        ones = np.bitwise_count(words).reshape(-1, RANK_BITS // 64).sum(1, dtype=np.int64)
        directory = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append((chunks, words, directory))
        rest = rest[more]
        if not len(rest):
            return levels


def dac_file(ids: np.ndarray, doc_ids: list, starts: np.ndarray, width: int = 8) -> bytes:
    """One file: ids of whole documents, ``starts`` their offsets in it."""
    parts, levels = [], dac_encode(ids, width)
    for chunks, words, directory in levels:
        parts += [chunks.tobytes(), words.tobytes() if len(levels) > 1 else b"", directory.tobytes() if len(levels) > 1 else b""]
    parts.append(np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes())
    parts.append(np.array([d is not None for d in doc_ids], dtype="u1").tobytes())
    parts.append(np.asarray(starts, dtype="<u8").tobytes())
    head = MAGIC + struct.pack("<QQII", len(ids), len(doc_ids), width, len(levels))
    sizes = [len(p) for p in parts]
    return head + struct.pack(f"<{len(sizes)}Q", *sizes) + b"".join(parts)


class TokenFile:
    """Reads a token file from bytes (or a memory map): ``file[i]``, ``file.ids(a, b)``, ``file.document(k)``."""

    def __init__(self, data):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.n, self.n_docs, self.width, self.n_levels = struct.unpack_from("<QQII", self.data, 8)
        at = 8 + struct.calcsize("<QQII")
        sizes = struct.unpack_from(f"<{3 * self.n_levels + 3}Q", self.data, at)
        at += 8 * len(sizes)
        kind, views = ("u1" if self.width <= 8 else "<u2"), []
        for k, size in enumerate(sizes):
            last = k - 3 * self.n_levels
            form = ["<i8", "u1", "<u8"][last] if last >= 0 else [kind, "<u8", "<u4"][k % 3]
            views.append(np.frombuffer(self.data[at:at + size], dtype=form))
            at += size
        self.levels = [views[3 * k:3 * k + 3] for k in range(self.n_levels)]
        ids, valid, self.starts = views[3 * self.n_levels:]
        self.doc_ids = [int(d) if v else None for d, v in zip(ids.tolist(), valid.tolist(), strict=True)]

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, words, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (k * self.width)
            if k + 1 == self.n_levels or not int(words[i >> 6]) >> (i & 63) & 1:
                return value
            block = i // RANK_BITS
            ones = int(directory[block]) + int(np.bitwise_count(words[block * (RANK_BITS // 64):i >> 6]).sum())
            i = ones + (int(words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()
        return value

    def _rank(self, k: int, i: int) -> int:
        """Ones of level k before place i."""
        _, words, directory = self.levels[k]
        if i >= len(words) * 64:
            return int(np.bitwise_count(words).sum())
        block = i // RANK_BITS
        ones = int(directory[block]) + int(np.bitwise_count(words[block * (RANK_BITS // 64):i >> 6]).sum())
        return ones + (int(words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()

    def ids(self, a: int, b: int) -> np.ndarray:
        """ids a..b-1; two ranks per level find each level's range, nothing outside is read."""
        spans, lo, hi = [], a, b
        for k in range(self.n_levels):
            spans.append((lo, hi))
            if k + 1 < self.n_levels:
                lo, hi = self._rank(k, lo), self._rank(k, hi)
        value = None
        for k in reversed(range(self.n_levels)):
            lo, hi = spans[k]
            chunks, words, _ = self.levels[k]
            out = chunks[lo:hi].astype(np.uint32)
            if value is not None:
                bits = np.unpackbits(words[lo >> 6:(hi + 63) >> 6].view(np.uint8), bitorder="little")
                more = bits[lo & 63:(lo & 63) + hi - lo].astype(bool)
                out[more] |= value << np.uint32(self.width)
            value = out
        return value

    def document(self, k: int) -> np.ndarray:
        a = int(self.starts[k])
        return self.ids(a, int(self.starts[k + 1]) if k + 1 < self.n_docs else self.n)


def write_tokens(df: DataFrame, tokenizer: str, end_id: int = 0, width: int = 8, file_tokens: int = 4_000_000,
                 id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> tuple[str, DataFrame]:
    """Encodes every document, appends ``end_id``, writes token files in ascending id order.

    Documents are range-partitioned by id and sorted within partitions; a task streams its documents and closes a
    file after ``file_tokens`` ids (a longer document is a file of its own).  Files carry an attempt's own name;
    the manifest (a table committed by Spark) names those that count, so a repeated or lost task leaves no trace.
    Returns (folder, manifest(path, part, seq, n_docs, n_tokens)).
    """
    folder = scratch_uri(df.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        fs, root = open_fs(folder)
        docs, pieces, size = [], [], 0

        def close():
            lengths = np.array([len(p) // 4 for p in pieces], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            data = dac_file(np.frombuffer(b"".join(pieces), dtype="<u4"), docs, starts, width)
            path = f"p{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{root}/{path}") as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"path": [path], "part": [part], "seq": [seq], "n_docs": [len(docs)],
                                               "n_tokens": [int(lengths.sum())]}, schema=schema)

        schema = pa.schema([("path", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                if pieces and size + len(ids) > 4 * file_tokens:
                    yield close()
                    docs, pieces, size, seq = [], [], 0, seq + 1
                docs.append(doc_id)
                pieces.append(ids)
                size += len(ids)
        if pieces:
            yield close()

    texts = texts_of(df, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    ranged = (texts.repartitionByRange(partitions, order[0]) if partitions else texts.repartitionByRange(order[0])).sortWithinPartitions(*order)
    manifest = cut_lineage(ranged.mapInArrow(write, "path string, part long, seq long, n_docs long, n_tokens long"))
    return folder, manifest


def with_bases(manifest: DataFrame, block: int = 1024) -> DataFrame:
    """base: ids in all files before (part, seq).  Parts are totalled, blocks of parts prefix-summed, then added up."""
    m = manifest.withColumn("blk", F.floor(F.col("part") / block))
    blocks = m.groupBy("blk").agg(F.sum("n_tokens").alias("t"))
    before = blocks.withColumn("blk_base", F.sum("t").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))).select("blk", "blk_base")
    own = Window.partitionBy("blk").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return (m.withColumn("own_base", F.sum("n_tokens").over(own)).join(before, "blk")
            .select("path", "part", "seq", "n_docs", "n_tokens",
                    (F.coalesce("blk_base", F.lit(0)) + F.coalesce("own_base", F.lit(0))).cast("long").alias("base")))


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (all ids before it), n_tokens, ids_crc32, file, doc_no."""
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                f = TokenFile(data.as_buffer())
                ids = f.ids(0, f.n).astype("<u4")
                ends = np.append(f.starts[1:], f.n).astype(np.int64)
                starts = f.starts.astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"file": [path.as_py().rsplit("/", 1)[-1]] * f.n_docs, "doc_no": list(range(f.n_docs)),
                                                  "doc_id": f.doc_ids, "at": starts, "n_tokens": ends - starts, "ids_crc32": crc}, schema=schema)

    schema = pa.schema([("file", pa.string()), ("doc_no", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    names = "file string, doc_no long, doc_id long, at long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string, doc_no long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")
    rows = files.mapInArrow(read, names)
    bases = with_bases(manifest).select(F.col("path").alias("file"), "base")
    # the inner join also leaves out files of attempts that did not commit
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file", "doc_no")
