"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprints are cut into two-bit segments and mapped to the number of ones in each (0, 1 or 2): a point of a grid.
The Manhattan distance of two points is a lower bound of the Hamming distance of their fingerprints.  Fingerprints
at ``max_bits`` or less agree up to max_bits / 2 in one of the two halves of the grid, so each fingerprint visits, per
half, the cells within half of that distance of its own; two that belong together meet in a cell.  Within a cell the
Manhattan distance of the whole points is tested first, the exact bit distance after it.

Equal fingerprints are one node before the search.  Cells that more than ``block`` fingerprints visit are dealt out as
pairs of blocks.  A task passes on only the links that join what it had not joined yet, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, hash128, texts_of
from .components import connected_components

SEED = 42
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def text_fingerprint(text: str, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash: ASCII lower case, words between ASCII white space, word shingles, XXH64."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    counts, n = np.zeros(64, dtype=np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 15):
        spans = zip(starts[at:min(at + (1 << 15), n)].tolist(), ends[at + k - 1:at + k - 1 + (1 << 15)].tolist(), strict=False)
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) per row; null or wordless text: 0."""
    texts = texts_of(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([text_fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, fp long")


def grid_point(fp: np.ndarray) -> np.ndarray:
    """Ones per two-bit segment, two bits each."""
    return fp - ((fp >> _ONE) & _LOW)


def unary_point(fp: np.ndarray) -> np.ndarray:
    """The same counts in unary (00, 01, 11): bits that differ are the Manhattan distance."""
    half = fp >> _ONE
    return ((fp | half) & _LOW) | ((fp & half & _LOW) << _ONE)


def visited_cells(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, index into fp): per half the cells within Manhattan distance ``radius`` of the point."""
    point, cells, owners = grid_point(fp), [], []
    for half in (0, 1):
        own = (point >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        seen_c, seen_o = own, np.arange(len(fp))
        ring_c, ring_o = seen_c, seen_o
        for _ in range(radius):
            near_c, near_o = [], []
            for s in range(16):
                step, field = np.uint64(1 << 2 * s), (ring_c >> np.uint64(2 * s)) & np.uint64(3)
                near_c += [ring_c[field < 2] + step, ring_c[field > 0] - step]
                near_o += [ring_o[field < 2], ring_o[field > 0]]
            ring_c, ring_o = np.concatenate(near_c), np.concatenate(near_o)
            seen_c, seen_o = np.concatenate([seen_c, ring_c]), np.concatenate([seen_o, ring_o])
        if radius > 1:
            both = np.unique(np.stack([seen_o.astype(np.uint64), seen_c], 1), axis=0)
            seen_o, seen_c = both[:, 0].astype(np.int64), both[:, 1]
        cells.append(seen_c | np.uint64(half << 32))
        owners.append(seen_o)
    return np.concatenate(cells), np.concatenate(owners)


class _Joined:
    """Union-find over the links of one task: says which links are new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.up[b] = a
        return a != b

    def stars(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.root(x) for x in nodes]


def _links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal key (rows sorted by it) at ``max_bits`` or less, by growing offset."""
    unary, left, right = unary_point(fp), [], []
    at = np.flatnonzero(key[1:] == key[:-1])
    off = 1
    while len(at):
        near = at[np.bitwise_count(unary[at] ^ unary[at + off]) <= max_bits]  # lower bound
        near = near[np.bitwise_count(fp[near] ^ fp[near + off]) <= max_bits]  # exact
        left.append(fp[near])
        right.append(fp[near + off])
        off += 1
        at = at[at + off < len(key)]
        at = at[key[at + off] == key[at]]
    if not left:
        return fp[:0], fp[:0]
    return np.concatenate(left), np.concatenate(right)


def near_links(nodes: DataFrame, max_bits: int = 4, block: int = 4096) -> DataFrame:
    """nodes(fp, distinct) -> edges(a, b): links at ``max_bits`` or less that connect what all such links connect."""
    radius = (max_bits // 2 + 1) // 2
    ball = 1 + 32 if radius == 1 else 33 ** radius  # points within the radius, at most

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at:at + 4096]
                cells, owner = visited_cells(part, radius)
                yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(part[owner].view(np.int64))], ["cell", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, left = _Joined(), None

        def out():
            nodes, roots = joined.stars()
            return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
                                               pa.array(np.array(roots, dtype=np.uint64).view(np.int64))], ["a", "b"])

        def done(key, fp):
            a, b = _links(key, fp, max_bits)
            if len(a):
                for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
                    joined.join(x, y)

        def keyed(b):
            cell, x, y, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            return np.rec.fromarrays([cell, x, y], names="c,x,y"), fp.view(np.uint64)

        held_k, held_f, held = [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            k, f = keyed(b)
            held_k.append(k)
            held_f.append(f)
            held += len(f)
            if held < 200_000 or (held_k[0][0] == k[-1]):
                continue
            key, fp = np.concatenate(held_k), np.concatenate(held_f)
            cut = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1  # the last cell may go on in the next batch
            done(key[:cut], fp[:cut])
            held_k, held_f, held = [key[cut:]], [fp[cut:]], len(key) - cut
            if len(joined.up) > 500_000:
                yield out()
                joined = _Joined()
        if held:
            done(np.concatenate(held_k), np.concatenate(held_f))
        if joined.up:
            yield out()

    cells = nodes.select("fp").mapInArrow(visit, "cell long, fp long")
    zero = F.lit(0)
    dealt = cells.select("cell", zero.alias("x"), zero.alias("y"), "fp")
    hot = _hot_cells(nodes, visited_cells, radius, block, ball)
    if not hot.isEmpty():
        mine = F.pmod(F.xxhash64("fp"), F.col("n_blocks"))
        pairs = F.when(F.col("n_blocks").isNull(), F.array(F.struct(zero.cast("long").alias("x"), zero.cast("long").alias("y")))).otherwise(
            F.transform(F.expr("sequence(0L, coalesce(n_blocks, 1L) - 1)"), lambda j: F.struct(F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y"))))
        dealt = (cells.join(hot, "cell", "left").select("cell", "fp", F.explode(pairs).alias("p"))
                 .select("cell", F.col("p.x").cast("int").alias("x"), F.col("p.y").cast("int").alias("y"), "fp"))
    return dealt.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y", "fp").mapInArrow(link, "a long, b long")


def _hot_cells(nodes: DataFrame, cells_of, radius: int, block: int, ball: int) -> DataFrame:
    """cell, n_blocks of the cells that may be visited by more than ``block`` nodes.

    Such a cell has a point in reach that more than block / ball nodes share; all other cells are small."""

    def halves(batches):
        for b in batches:
            point = grid_point(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for half in (0, 1):
                own = ((point >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)) | np.uint64(half << 32)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["own"])

    def reach(batches):
        for b in batches:
            own, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            # a fingerprint with this point in one half: per segment 0 -> 00, 1 -> 01, 2 -> 11
            half = own.astype(np.uint64) >> np.uint64(32)
            point = own.astype(np.uint64) & np.uint64(0xFFFFFFFF)
            two = (point >> _ONE) & _LOW
            fp = ((point & _LOW) | two | (two << _ONE)) << (half * np.uint64(32))
            cells, owner = cells_of(fp, radius)
            keep = (cells >> np.uint64(32)) == half[owner]
            yield pa.RecordBatch.from_arrays([pa.array(cells[keep].view(np.int64)), pa.array(n[owner[keep]])], ["cell", "n"])

    heavy = (nodes.select("fp").mapInArrow(halves, "own long").groupBy("own").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > block // ball))
    total = heavy.mapInArrow(reach, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return cut_lineage(total.select("cell", F.ceil((F.col("n") + block) / block).cast("long").alias("n_blocks")))


def simhash_components(df: DataFrame, shingle: int = 4, max_bits: int = 4, block: int = 4096,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row.

    Null, empty and wordless texts have fingerprint zero and link like any other.  Repeated rows repeat their result.
    A null doc_id is never a component's id unless all its ids are null."""
    docs = cut_lineage(fingerprints(df, shingle, id_col, text_col))
    nodes = cut_lineage(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = connected_components(near_links(nodes, max_bits, block)).join(nodes, F.col("node") == F.col("fp"))
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.select("fp", "root").join(least, "root").select("fp", "least")
    classes = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return docs.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_component(df: DataFrame, shingle: int = 4, max_bits: int = 4, block: int = 4096,
                           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` (all columns) with the smallest id of their component; of rows equal in id and text, one.

    A row without an id stays only where no row of its component has one.  Rows are told apart by id and text, so an id
    that repeats with another text is a document of its own."""
    row = fresh(df, "_row")
    h1, h2 = hash128(F.coalesce(F.col(text_col), F.lit("")))
    named = df.withColumn(row, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2")))
    classes = simhash_components(named, shingle, max_bits, block, row, text_col)
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = cut_lineage(kept.select(F.col("doc_id").alias("kept"), "n"))
    rows = named.join(kept.select("kept"), F.col(row).eqNullSafe(F.col("kept")), "left_semi")
    if not kept.filter("n > 1").isEmpty():
        rows = rows.dropDuplicates([row])  # some rows repeat
    return rows.drop(row)
