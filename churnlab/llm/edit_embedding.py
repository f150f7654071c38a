"""Document fingerprints by a randomised edit embedding.

All texts share one random walk rule: at step j over a character of class c a fixed coin says whether the walk goes on
to the next character or repeats this one.  The sequence of characters it writes down embeds edit distance into
Hamming distance: texts with a common start walk in step, and after an edit the walks can fall into step again.

A fingerprint samples the embedding at shared random places: sample k reads the place below the walk's length with
the least k-th random priority, so walks of unlike length still share most places.  It holds one byte per sample
(the class of the character there); likeness is the share of equal samples.  Bands of samples give candidate pairs,
which are verified by edit distance; what they leave unconnected is compared by edit distance alone.

Memory per text: about 20 bytes a character.  Null text is empty; an empty text has its own fingerprint (all zero).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, hash128, texts_of
from .components import connected_components
from .simhash import _Joined as Joined

PERIOD = 4096
SAMPLES = 128


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (the usual xor-multiply finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class EditEmbedding:
    def __init__(self, seed: int = 7, samples: int = SAMPLES):
        self.seed, self.samples = seed, samples
        coins = np.random.default_rng(seed).integers(0, 2, size=(256, PERIOD), dtype=np.uint8)
        coins[:, -1] = 1  # every walk goes on at least once a period
        steps = np.zeros((256, PERIOD), dtype=np.int64)
        gap = np.zeros(256, dtype=np.int64)
        for j in [*range(PERIOD - 1, -1, -1)]:
            gap = np.where(coins[:, j] == 1, 1, gap + 1)
            steps[:, j] = gap
        self.steps = [row.tolist() for row in steps]  # places written for a character of class c entered at j
        self.reach = 0
        self.best = np.zeros((samples, 0), dtype=np.int64)  # places of falling least priority, by sample
        self.least = np.full(samples, np.iinfo(np.uint64).max, dtype=np.uint64)
        self._extend(1 << 15)

    def _extend(self, reach: int) -> None:
        """Priorities of the places up to ``reach``: only those below all before them can ever be a sample's place."""
        rows = [[int(x) for x in r if x >= 0] for r in self.best]
        for at in range(self.reach, reach, 1 << 16):
            places = np.arange(at, min(at + (1 << 16), reach), dtype=np.uint64)
            for k in range(self.samples):
                pr = _mix(places * np.uint64(0x9E3779B97F4A7C15) + np.uint64((self.seed * 1000003 + k) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
                run = np.minimum.accumulate(np.concatenate([self.least[k:k + 1], pr]))
                rows[k] += (np.flatnonzero(run[1:] < run[:-1]) + at).tolist()
                self.least[k] = run[-1]
        self.reach = reach
        self.best = np.array([r + [-1] * (max(map(len, rows)) - len(r)) for r in rows], dtype=np.int64)

    @staticmethod
    def classes(text: str) -> bytes:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        return (_mix(cp + np.uint64(1)) >> np.uint64(56)).astype(np.uint8).tobytes()

    def walk(self, classes: bytes, start: int = 0) -> tuple[np.ndarray, int]:
        """(place where each character is first written, the walk's length)."""
        steps, mask, j, parts = self.steps, PERIOD - 1, start, []
        for at in range(0, len(classes), 1 << 16):
            places = []
            put = places.append
            for c in classes[at:at + (1 << 16)]:
                put(j)
                j += steps[c][j & mask]
            parts.append(np.array(places, dtype=np.int64))
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), j

    def sample(self, classes: bytes, places: np.ndarray, length: int) -> bytes:
        if not length:
            return bytes(self.samples)
        while length > self.reach:
            self._extend(2 * self.reach)
        valid = (self.best >= 0) & (self.best < length)
        last = valid.shape[1] - 1 - np.argmax(valid[:, ::-1], axis=1)
        at = self.best[np.arange(self.samples), last]
        return np.frombuffer(classes, dtype=np.uint8)[np.searchsorted(places, at, side="right") - 1].tobytes()

    def fingerprint(self, text: str) -> bytes:
        classes = self.classes(text)
        return self.sample(classes, *self.walk(classes))


def likeness(a: bytes, b: bytes) -> float:
    return float(np.mean(np.frombuffer(a, dtype=np.uint8) == np.frombuffer(b, dtype=np.uint8)))


@lru_cache(maxsize=2)
def embedding(seed: int = 7, samples: int = SAMPLES) -> EditEmbedding:
    return EditEmbedding(seed, samples)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, fingerprint (hex) per row."""
    texts = texts_of(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = embedding(samples=samples)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.fingerprint(t).hex() for t in b.column(1).to_pylist()], pa.string())],
                                             ["doc_id", "fingerprint"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def bands(fingerprint: Column, n_bands: int, rows: int, samples: int = SAMPLES) -> Column:
    """array<struct<band, key>>: band b samples ``rows`` bytes of the fingerprint at fixed random places."""
    rng, out = np.random.default_rng(11), []
    for b in range(n_bands):
        places = sorted(rng.choice(samples, size=rows, replace=False).tolist())
        out.append(F.struct(F.lit(b).alias("band"), F.concat(*[F.substring(fingerprint, 2 * p + 1, 2) for p in places]).alias("key")))
    return F.array(*out)


def same_samples(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal bytes of two hex fingerprints."""
    return sum((F.when(F.substring(a, 2 * p + 1, 2) == F.substring(b, 2 * p + 1, 2), 1).otherwise(0) for p in range(samples)), F.lit(0)) / samples


def near_pairs(df: DataFrame, max_edits: float = 0.3, n_bands: int = 24, rows: int = 6, block: int = 256,
               id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs(a, b, likeness, edits), members(doc_id, class, near)): links between near texts, and what they connect.

    Equal texts are one class (its smallest id).  Two classes are near if their edit distance is at most ``max_edits``
    of the longer text; ``near`` is the smallest class of a connected component of that relation, and the pairs are
    links that connect each component (not all its pairs).  Bands are the fast way: in each band every text is tried
    against the band's smallest id only.  They find little of what was edited in many places, so no pair is left to
    them: all texts of fitting length that they left unconnected are compared by edit distance (``_unlinked``)."""
    t = texts_of(df, id_col, text_col)
    h1, h2 = hash128(F.col("text"))
    t = t.withColumn("h1", h1).withColumn("h2", h2)
    members = cut_lineage(t.groupBy("h1", "h2").agg(F.min("doc_id").alias("class")))
    reps = t.join(members, ["h1", "h2"]).filter(F.col("doc_id").eqNullSafe(F.col("class"))).dropDuplicates(["h1", "h2"]).select("class", "text")
    reps = cut_lineage(reps)
    prints = cut_lineage(fingerprints(reps.select(F.col("class").alias("doc_id"), "text")))
    keys = prints.select("doc_id", F.explode(bands(F.col("fingerprint"), n_bands, rows)).alias("band"))
    least = cut_lineage(keys.groupBy("band").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    cand = keys.withColumnRenamed("doc_id", "b").join(least, "band").filter(F.col("a") < F.col("b")).select("a", "b").distinct()
    ta, tb = reps.select(F.col("class").alias("a"), F.col("text").alias("ta")), reps.select(F.col("class").alias("b"), F.col("text").alias("tb"))
    banded = cut_lineage(_verified(cand.join(ta, "a").join(tb, "b"), max_edits))
    roots = connected_components(banded).withColumnRenamed("node", "class")
    rest = cut_lineage(_unlinked(reps.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), max_edits, block))
    links = cut_lineage(banded.union(rest).distinct())
    fa, fb = prints.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("fa")), prints.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("fb"))
    pairs = links.join(fa, "a").join(fb, "b").select("a", "b", same_samples(F.col("fa"), F.col("fb")).alias("likeness"), "edits")
    near = connected_components(links).select(F.col("node").alias("class"), F.col("root").alias("near"))
    out = t.join(members, ["h1", "h2"]).join(near, "class", "left")
    return pairs, out.select("doc_id", "class", F.coalesce("near", "class").alias("near"))


@lru_cache(maxsize=1024)
def _char_masks(text: str) -> dict[str, int]:
    """For each character the set of its places, as the bits of one number."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return {chr(c): int.from_bytes(np.packbits(cp == c, bitorder="little").tobytes(), "little") for c in np.unique(cp).tolist()}


def edits_within(a: str, b: str, most: int) -> int:
    """Edit distance, or -1 if it is above ``most``: Myers' bit-parallel columns over the longer text."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return -1
    if not b:
        return len(a)
    masks, full, top = _char_masks(a), (1 << len(a)) - 1, 1 << len(a) - 1
    pv, mv, d, left = full, 0, len(a), len(b)
    for c in b:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph, mh = mv | (full ^ (xh | pv)), pv & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        left -= 1
        if d - left > most:  # every step to come saves one at most
            return -1
        ph = ((ph << 1) | 1) & full
        pv, mv = ((mh << 1) & full) | (full ^ (xv | ph)), ph & xv
    return d


def _verified(both: DataFrame, max_edits: float) -> DataFrame:
    """a, b, edits of the rows (a, b, ta, tb) whose edit distance is at most ``max_edits`` of the longer text."""
    most = F.floor(F.greatest(F.length("ta"), F.length("tb")) * max_edits).cast("int")
    both = both.select("a", "b", "ta", "tb", most.alias("most")).filter(F.abs(F.length("ta") - F.length("tb")) <= F.col("most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            edits = pa.array([edits_within(*v) for v in zip(*(c.to_pylist() for c in x.columns[2:]), strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), edits], ["a", "b", "edits"]).filter(pc.greater_equal(edits, 0))

    kind = both.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}, edits int")


def _unlinked(nodes: DataFrame, max_edits: float, block: int) -> DataFrame:
    """nodes(class, text, root) -> a, b, edits: links between texts of unlike root, from all pairs whose lengths allow it.

    Lengths fall into steps so wide that a near pair lies in one step or in neighbours; a step's texts are dealt into
    blocks of about ``block``, and each pair of blocks is a group of its own.  The work is the square of the texts in
    a step: nothing cheaper finds a text in which every third character was changed.  Tasks emit spanning links only."""
    wide = -math.log(max(1 - max_edits, 1e-9)) + 1e-9
    nodes = nodes.filter((F.length("text") > 0) & F.col("class").isNotNull()).withColumn("step", F.floor(F.log(F.length("text")) / wide))
    nodes = cut_lineage(nodes)
    n = nodes.groupBy("step").count().agg(F.max("count")).first()[0] or 0
    s = max(1, -(-n // block))
    own, every = F.pmod(F.xxhash64("class"), F.lit(s)).cast("int"), F.sequence(F.lit(0), F.lit(s - 1))
    x = nodes.select(F.col("class").alias("a"), F.col("text").alias("ta"), F.col("root").alias("ra"), own.alias("i"), F.explode(every).alias("j"), "step")
    x = x.withColumn("step", F.explode(F.array(F.col("step"), F.col("step") - 1)))  # the longer text: its own step and the one below
    y = nodes.select(F.col("class").alias("b"), F.col("text").alias("tb"), F.col("root").alias("rb"), own.alias("j"), F.explode(every).alias("i"), "step")
    longer = (F.length("ta") > F.length("tb")) | ((F.length("ta") == F.length("tb")) & (F.col("a") > F.col("b")))
    near = _verified(x.join(y, ["step", "i", "j"]).filter((F.col("ra") != F.col("rb")) & longer), max_edits)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "edits")

    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for batch in batches:
            new = [joined.join(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(new, pa.bool_()))
            if len(joined.up) > 500_000:
                joined = Joined()

    return near.mapInArrow(spanning, near.schema)


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against itself with its last third replaced by the start of the next text (descending id).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Ids are cut into ranges
    of near-equal count; each range's rows are one sorted stream, and the first row of the following range travels
    along, so no text order is global.  Ties of doc_id are ordered by text; a null id comes last; a single row is its
    own next."""
    spark = df.sparkSession
    texts = texts_of(df, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(texts.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    bucket = F.coalesce(bucket.cast("int"), F.lit(0)) if bounds else bucket
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket)
    ranged = texts.withColumn("bucket", bucket)
    heads = ranged.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy(F.col("bucket").desc()).collect()  # one row per range
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not heads:
        return spark.createDataFrame([], kind)
    rows = ranged.select("bucket", F.lit(0).alias("ahead"), "doc_id", "text")
    follows = {h["bucket"]: heads[k - 1]["bucket"] for k, h in enumerate(heads)}  # whose last row needs this range's head
    ids = [h["head"] for h in heads if h["head"] is not None]
    first = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if any(h["head"] is None for h in heads):
        first = first | F.col("doc_id").isNull()
    to = F.create_map(*[F.lit(int(x)) for kv in follows.items() for x in kv])
    extra = ranged.filter(first).select(F.element_at(to, F.col("bucket")).alias("bucket"), F.lit(1).alias("ahead"), "doc_id", "text")
    stream = rows.union(extra).repartition("bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, held = embedding(), None  # held: the row that waits for its next

        def shown(doc):
            classes = e.classes(doc[1])
            places, length = e.walk(classes)
            return (*doc, classes, places, e.sample(classes, places, length))

        for b in batches:
            out = [[] for _ in range(7)]
            for key, ahead, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                here = shown((doc_id, text)) if not ahead or (held and held[0] == key) else None
                if held and held[0] == key:
                    last, own, classes, places, fp = held[1]
                    cut = len(own) // 3
                    keep, tail = len(own) - cut, here[1][:cut]
                    start = int(places[keep]) if cut else 0  # the walk of what stays is known
                    tail_classes = here[2][:cut]
                    if cut:
                        more, length = e.walk(tail_classes, start)
                        efp = e.sample(classes[:keep] + tail_classes, np.concatenate([places[:keep], more]), length)
                    else:
                        efp = fp
                    for o, v in zip(out, (last, len(own), hashlib.sha256((own[:keep] + tail).encode("utf-8", "surrogatepass")).hexdigest(),
                                          fp.hex(), efp.hex(), likeness(fp, efp), likeness(fp, here[4])), strict=True):
                        o.append(v)
                held = None if ahead else (key, here)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(o, pa.string()) for o in out[2:5]),
                                                  *(pa.array(o, pa.float64()) for o in out[5:])],
                                                 ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return stream.mapInArrow(run, kind)
