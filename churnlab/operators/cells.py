"""Approximate cosine search over inverted lists: k-means cells, product-quantised residuals, exact re-rank.

Cells and code books are fitted on a bounded sample; every row is then indexed as (cell, key, codes) and the index is
written clustered by cell.  A query looks into the ``probes`` nearest cells, whose codes (one byte per ``part`` of the
vector) give approximate scores; the ``rerank`` x k best are scored exactly on their vectors.  ``probes`` is the
smallest number that reached ``goal`` recall for held-out rows of the sample, so vectors without structure probe more
cells instead of losing neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlab.operators.search import QUERY_BLOCK, dot, knn_cosine, norm, top_k
from churnlab.session import cut_lineage

SAMPLE = 20_000


@dataclass
class Cells:
    centres: np.ndarray  # cells x dim
    books: list[np.ndarray]  # per part: codes x width
    probes: int

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Cells of each row, nearest first."""
        return np.argsort(_far(x, self.centres), axis=1, kind="stable")


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _means(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = _far(x, c).argmin(1)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def fit_cells(corpus: DataFrame, key: str = "vec_id", vec: str = "embedding", cells: int | None = None, parts: int = 16,
              codes: int = 256, k: int = 10, goal: float = 0.97, sample: int = SAMPLE, seed: int = 42) -> Cells | None:
    """Fitted on at most ``sample`` rows (by key hash); None if no row has a vector."""
    rows = corpus.select(F.xxhash64(F.lit(seed), F.col(key)).alias("_h"), vec).filter(F.size(vec) > 0)
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod("_h", F.lit(1 << 31)) < int((1 << 31) * min(1.0, 1.1 * sample / n)))
    got = rows.limit(sample).orderBy("_h").collect()
    if not got:
        return None
    x = _unit(np.array([r[1] for r in got], dtype=np.float64))
    rng = np.random.default_rng(seed)
    centres = _means(x, cells or max(1, min(1024, int(np.sqrt(n)))), rng)
    home = _far(x, centres).argmin(1)
    left = x - centres[home]
    books = [_means(p, codes, rng) for p in np.array_split(left, min(parts, x.shape[1]), axis=1)]
    fit = Cells(centres, books, len(centres))
    asked = x[: min(300, len(x))]
    sims = asked @ x.T
    sims[np.arange(len(asked)), np.arange(len(asked))] = -np.inf  # not itself
    best = np.argsort(-sims, axis=1)[:, : min(k, max(1, len(x) - 1))]
    place = np.argsort(fit.order(asked), axis=1)  # place of each cell for the query
    fit.probes = int(np.quantile(np.take_along_axis(place, home[best], axis=1), goal, method="higher")) + 1
    return fit


def index_cells(corpus: DataFrame, fit: Cells, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The table (cell, key, code) of every row with a vector, clustered by cell (a large cell is spread over files)."""

    def encode(batches):
        for b in batches:
            x = _unit(np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)) if b.num_rows else np.zeros((0, fit.dim))
            home = _far(x, fit.centres).argmin(1).astype(np.int32)
            left = x - fit.centres[home]
            code = np.stack([_far(p, w).argmin(1) for p, w in zip(fit.cut(left), fit.books, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(home), b.column(0), pa.array([r.tobytes() for r in code], pa.binary())], ["cell", key, "code"])

    schema = T.StructType([T.StructField("cell", T.IntegerType()), corpus.schema[key], T.StructField("code", T.BinaryType())])
    coded = corpus.select(key, vec).filter((F.size(vec) == fit.dim) & F.col(key).isNotNull()).mapInArrow(encode, schema)
    return cut_lineage(coded.repartitionByRange("cell", F.xxhash64(key)).sortWithinPartitions("cell"))


def knn_cells(queries: DataFrame, corpus: DataFrame, k: int, qkey: str = "query_id", key: str = "vec_id", vec: str = "embedding",
              fit: Cells | None = None, index: DataFrame | None = None, rerank: int = 10, block: int = QUERY_BLOCK,
              stats: dict | None = None) -> DataFrame:
    """Top-k corpus rows per query, with the columns of :func:`knn_cosine`.  Rows without a vector or an id are not found,
    queries without a vector get no rows; a query whose cells hold fewer than ``k`` rows is searched exactly.

    Blocks of at most ``block`` queries travel to the tasks that read the index; ``fit`` and ``index`` may be given, else they
    are made.  ``stats`` (if given) receives pairs scored on codes and pairs scored on vectors."""
    spark = corpus.sparkSession
    fit = fit or fit_cells(corpus, key, vec, k=k)
    queries = queries.select(qkey, vec).filter(F.size(vec) > 0)
    if fit is None:
        return knn_cosine(queries, corpus, k, qkey, key, vec)
    index = index_cells(corpus, fit, key, vec) if index is None else index
    n = queries.count()
    parts = 1 if n <= block else -(-2 * n // block)
    schema = T.StructType([T.StructField("_q", T.IntegerType()), corpus.schema[key], T.StructField("_a", T.DoubleType())])
    done = []
    for part in range(parts):
        asked = queries.filter(F.pmod(F.xxhash64(qkey), F.lit(parts)) == part).collect()  # a block
        if not asked:
            continue
        done.append(cut_lineage(_search(spark, asked, queries.schema, corpus, fit, index, schema, k, qkey, key, vec, rerank * k, stats)))
    if not done:
        return knn_cosine(queries, corpus, k, qkey, key, vec)
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    full = found.filter(F.col("rank") == k).select(qkey)
    short = cut_lineage(queries.join(full, qkey, "left_anti"))
    if short.isEmpty():
        return found
    return found.join(full, qkey, "left_semi").unionByName(knn_cosine(short, corpus.filter((F.size(vec) == fit.dim) & F.col(key).isNotNull()), k, qkey, key, vec))


def _search(spark, asked, qschema, corpus, fit: Cells, index, schema, k, qkey, key, vec, keep, stats):
    q = _unit(np.array([r[1] for r in asked], dtype=np.float64))
    order = fit.order(q)[:, : fit.probes]
    of_cell: dict[int, np.ndarray] = {int(c): np.nonzero((order == c).any(1))[0].astype(np.int32) for c in np.unique(order)}
    sent = spark.sparkContext.broadcast((q, of_cell))  # one block of queries

    def scan(batches):
        q, of_cell = sent.value
        for b in batches:
            cell = b.column(0).to_numpy()
            code = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            for c in np.unique(cell):
                at, who = np.nonzero(cell == c)[0], of_cell.get(int(c))
                if who is None:
                    continue
                x = np.concatenate([w[code[at, j]] for j, w in enumerate(fit.books)], axis=1) + fit.centres[c]
                for lo in range(0, len(who), 512):
                    few = who[lo: lo + 512]
                    s = q[few] @ x.T
                    m = min(keep, len(at))
                    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(few, m)), b.column(1).take(pa.array(at[top.ravel()])),
                                                      pa.array(np.take_along_axis(s, top, 1).ravel())], schema.names)

    hits = index.filter(F.col("cell").isin(list(of_cell))).mapInArrow(scan, schema)
    best = top_k(hits, "_q", "_a", keep, key).select("_q", key).distinct()  # an id may repeat: its rows come with the join
    if stats is not None:
        sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # one row per cell
        stats["on_codes"] = stats.get("on_codes", 0) + sum(sizes.get(c, 0) * len(w) for c, w in of_cell.items())
        stats["on_vectors"] = stats.get("on_vectors", 0) + best.count()
    own = T.StructType([T.StructField("_q", T.IntegerType()), qschema[qkey], T.StructField("_qv", qschema[vec].dataType)])
    qdf = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(asked)], own)
    pairs = best.join(corpus.select(key, F.col(vec).alias("_cv")), key).join(F.broadcast(qdf), "_q")
    sim = F.try_divide(dot(F.col("_qv"), F.col("_cv")), norm(F.col("_qv")) * norm(F.col("_cv")))
    return top_k(pairs.select(qkey, key, sim.alias("_sim")), qkey, "_sim", k, key).select(qkey, key, "rank", F.round("_sim", 4).alias("similarity"))
