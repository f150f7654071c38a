"""Token groups of two tokenizers over the same bytes, and how often their ids meet in the corpus.

Both token sequences of a text are byte ranges over `` text``.  Two sequences are aligned by divide and conquer at
shared cuts: :func:`align` locates a common end near the middle by bisection and goes on with both halves; an interval
without a common end inside is a group.  Texts are cut into units at blanks and line ends where neither tokenizer can
join characters; the end of a unit is a shared cut, so the recursion starts below it and its result is kept per
distinct unit (bounded memory per worker, what was dropped is aligned again).

A null or empty text, and a text that one of the tokenizers does not give back byte for byte, has no tokens: zeros and an
empty digest.  Repeated rows are documents of their own, also under one id.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import accumulate
from operator import mul

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, texts_of

UNIT_LIMIT = 600_000  # units kept per worker, in two generations
LONG_UNIT = 400  # characters; longer units are aligned anew each time
BROADCAST_BYTES = 64 << 20  # of the pair table
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"  # letters in every Unicode version
_ALIGNED = ("doc_id long, uid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs array<struct<a:int,b:int,n:int>>")


def align(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Ends (exclusive token numbers) of the groups of two ascending lists of byte ends that share their last one."""
    groups: list[tuple[int, int]] = []
    todo = [(0, len(ends_a), 0, len(ends_b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        cut = None
        if a1 - a0 > 1 and b1 - b0 > 1:
            mid = (a0 + a1 - 1) // 2
            for k in range(a1 - 1 - a0):  # outwards from the middle; the last end is the interval's own
                i = mid + (k + 1) // 2 * (-1 if k % 2 else 1)
                if i == a1 - 1:  # an even number of ends: the one place that is left lies at the other side
                    i = a0
                j = bisect_left(ends_b, ends_a[i], b0, b1 - 1)
                if j < b1 - 1 and ends_b[j] == ends_a[i]:
                    cut = (i + 1, j + 1)
                    break
        if cut is None:
            groups.append((a1, b1))
        else:  # the left half is taken up first
            todo += [(cut[0], a1, cut[1], b1), (a0, cut[0], b0, cut[1])]
    return groups


def links(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Token numbers (i, j) whose byte ranges overlap."""
    found, j = [], 0
    start = 0
    for i, end in enumerate(ends_a):
        while ends_b[j] <= start:
            j += 1
        k = j
        while True:
            found.append((i, k))
            if ends_b[k] >= end:
                break
            k += 1
        start = end
    return found


class PairAligner:
    """Units of `` text`` as both tokenizers see them."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        import sentencepiece
        from tokenizers import Tokenizer

        from .encode import TextEncoder

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = {c: b for b, c in enumerate(TextEncoder._byte_letters())}
        self.a_bytes = {i: bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode() for s, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id("▁")
        self.names = [str(i) for i in range(max(self.a.get_vocab_size(), len(pieces)) + 1)]
        # a piece with a blank after another character, or with a line end, would reach over a cut: then texts stay whole
        joins = any(re.search("[^▁]▁|\n", p) for p in pieces)
        # marks that no piece has behind a letter; the other tokenizer never joins the two
        marks = "".join(c for c in ".,;:!?" if not any(re.search(_LETTER + re.escape(c), p) for p in pieces))
        rest = r"\S*(?:[^\S \n]\s*\S*)*"
        if joins:
            self.cut = re.compile("(?s).+")
        elif marks:
            ends = rf"[{marks}](?=[ \n]|\Z)"
            self.cut = re.compile(rf"(?<={_LETTER}){ends}|[ \n]\s*(?:{_LETTER}++(?={ends})|{rest})")
        else:
            self.cut = re.compile(rf"[ \n]\s*{rest}")
        self.units: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _encoded(self, units: list[str]):
        """Ids of both tokenizers for each unit, in one call each."""
        ids_a = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        # the model puts a blank in front; behind a line end nothing joins, so what follows it has none
        texts = [u[1:] if u[0] == " " else "\n" + u for u in units]
        ids_b = self.b.encode(texts, num_threads=1)
        return zip(ids_a, [(i if u != " " else [self.blank]) if u[0] == " " else i[2:] for u, i in zip(units, ids_b)])

    def _aligned(self, unit: str, ids_a: list[int], ids_b: list[int]) -> tuple | None:
        """(n_a, n_b, n_groups, groups text, a << 32 | b of each link as bytes); None where bytes differ."""
        parts_a, parts_b, raw = [self.a_bytes[i] for i in ids_a], [self.b_bytes[i] for i in ids_b], unit.encode()
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return None
        if len(ids_a) == 1 or len(ids_b) == 1:  # one group, and all links of it
            return (len(ids_a), len(ids_b), 1, f"{','.join(map(str, ids_a))}|{','.join(map(str, ids_b))}",
                    array("q", [a << 32 | b for a in ids_a for b in ids_b]).tobytes())
        ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
        names, texts, i0, j0 = self.names, [], 0, 0
        name_a, name_b = [names[i] for i in ids_a], [names[i] for i in ids_b]
        for i, j in align(ends_a, ends_b):
            texts.append(f"{','.join(name_a[i0:i])}|{','.join(name_b[j0:j])}")
            i0, j0 = i, j
        codes = array("q", [ids_a[i] << 32 | ids_b[j] for i, j in links(ends_a, ends_b)])
        return len(ids_a), len(ids_b), len(texts), ";".join(texts), codes.tobytes()

    def _keep(self, unit: str, got: tuple) -> None:
        """Units used since the last change of generation stay; the generation before goes."""
        if len(self.units) >= UNIT_LIMIT // 2:
            self.older, self.units = self.units, {}
        self.units[unit] = got

    def _all(self, wanted) -> dict[str, tuple | None]:
        out, need = {}, []
        get, older = self.units.get, self.older
        for u in wanted:
            got = get(u)
            if got is None:
                got = older.get(u)
                if got is None:
                    need.append(u)
                    continue
                self._keep(u, got)
                get, older = self.units.get, self.older
            out[u] = got
        for lo in range(0, len(need), 1000):
            some = need[lo:lo + 1000]
            for u, (a, b) in zip(some, self._encoded(some)):
                got = out[u] = self._aligned(u, a, b)
                if got is not None and len(u) <= LONG_UNIT:
                    self._keep(u, got)
        return out

    def text(self, text: str):
        """(n_a, n_b, n_groups, n_links, digest, codes, occurrences) of a whole text; None: no tokens."""
        import numpy as np

        if not text or "▁" in text:
            return None
        digest, sums, codes, times, first = hashlib.sha256(), [0, 0, 0], [], [], True
        units = self.cut.findall(" " + text)
        for lo in range(0, len(units), 50_000):
            some = units[lo:lo + 50_000]
            counts = Counter(some)
            known = self._all(counts)
            if None in known.values():
                return None
            groups = {u: got[3] for u, got in known.items()}
            digest.update(("" if first else ";").encode() + ";".join(map(groups.__getitem__, some)).encode())
            first = False
            n_a, n_b, n_groups, _, raw = zip(*map(known.__getitem__, counts))
            k = counts.values()
            sums = [s + sum(map(mul, n, k)) for s, n in zip(sums, (n_a, n_b, n_groups))]
            codes.append(np.frombuffer(b"".join(raw), dtype=np.int64))
            times.append(np.repeat(np.fromiter(k, np.int64, len(counts)), np.fromiter(map(len, raw), np.int64, len(raw)) // 8))
        times = np.concatenate(times)
        pairs, at = np.unique(np.concatenate(codes), return_inverse=True)
        return *sums, int(times.sum()), digest.hexdigest(), pairs, np.bincount(at, times).astype(np.int64)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> PairAligner:
    """One per worker process."""
    return PairAligner(path_a, path_b)


def aligned_documents(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts, digest of the groups, and its distinct id pairs with their occurrences (``pairs``).

    ``uid`` numbers the rows; write the result before relying on it."""
    rows = texts_of(df, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        al, none = aligner(path_a, path_b), np.zeros(0, np.int64)
        pair = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
        for batch in batches:
            ids, uids, texts = batch.column(0), batch.column(1), batch.column(2)
            for lo in range(0, batch.num_rows, 500):
                part = range(lo, min(lo + 500, batch.num_rows))
                nums, digests, offsets, codes, counts = [], [], [0], [], []
                for i in part:
                    got = al.text(texts[i].as_py())
                    n_a, n_b, n_groups, n_links, digest, pairs, times = got or (0, 0, 0, 0, "", none, none)
                    nums.append((n_a, n_b, n_groups, n_links))
                    digests.append(digest)
                    codes.append(pairs)
                    counts.append(times)
                    offsets.append(offsets[-1] + len(pairs))
                c = np.concatenate(codes)
                values = pa.StructArray.from_arrays([pa.array((c >> 32).astype(np.int32)), pa.array((c & 0xFFFFFFFF).astype(np.int32)),
                                                     pa.array(np.concatenate(counts).astype(np.int32))], fields=list(pair))
                cols = list(zip(*nums))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(part)), uids.slice(lo, len(part)), *[pa.array(x, pa.int64()) for x in cols], pa.array(digests, pa.string()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
                    names=["doc_id", "uid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return rows.select(F.col("doc_id").cast("long"), "uid", "text").mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): documents that hold the pair, and whether no other partner of ``a`` has more."""
    pairs = aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n_docs"))
    # at most one vocabulary of partners lies in a window
    return pairs.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def alignment_digests(df: DataFrame, path_a: str, path_b: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The pair table is broadcast while it has at most ``broadcast_bytes`` (32 a row); above that it is joined by shuffle,
    as a written table, so that a hot pair's rows can be split."""
    aligned = cut_lineage(aligned_documents(df, path_a, path_b))
    counts = cut_lineage(pair_counts(aligned))
    small = counts.count() * 32 <= broadcast_bytes
    each = aligned.select("uid", F.explode("pairs").alias("p")).select("uid", "p.a", "p.b", "p.n")
    met = each.join(F.broadcast(counts) if small else counts, ["a", "b"])
    sums = met.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"),
                                  F.sum(F.col("n") * F.col("n_docs")).cast("long").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return (aligned.drop("pairs").join(sums, "uid", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                    F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))
