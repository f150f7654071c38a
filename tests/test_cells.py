"""Inverted lists with product-quantised residuals: recall against exact search and the share of the corpus looked at."""

import numpy as np
from pyspark.sql import functions as F

from churnlab.operators import cells as CE
from churnlab.operators import search as SE
from churnlab.sources.tables import table

SCHEMA = "vec_id long, embedding array<float>"


def recall(exact, got):
    pairs = {(r.query_id, r.vec_id) for r in exact.collect()}
    return len(pairs & {(r.query_id, r.vec_id) for r in got}) / len(pairs)


def asked(e):
    return e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def test_given_vectors(spark):
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    stats = {}
    rows = CE.knn_cells(asked(e), e, 10, stats=stats).collect()
    n, q = e.count(), asked(e).count()
    assert len(rows) == 10 * q and recall(SE.knn_cosine(asked(e), e, 10), rows) >= 0.9
    assert stats["on_vectors"] <= 100 * q and stats["on_codes"] <= n * q


def test_structured_vectors_read_a_small_share(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 32))
    x[rng.random(6000) < 0.3] = centres[0] + 0.25 * rng.normal(size=32)  # a hot cell: a third of all rows
    e = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)
    e = SE.cut_lineage(e)
    stats = {}
    q = asked(e)
    rows = CE.knn_cells(q, e, 10, block=70, stats=stats).collect()
    exact = {(r.query_id, r["rank"]): r.similarity for r in SE.knn_cosine(q, e, 10).collect()}
    same = sum(exact[r.query_id, r["rank"]] - r.similarity <= 1e-4 for r in rows)  # ties: equal vectors
    assert len(rows) == len(exact) and same / len(exact) >= 0.9
    pairs = e.count() * q.count()
    assert stats["on_codes"] < 0.3 * pairs and stats["on_vectors"] < 0.05 * pairs


def test_nulls_few_rows_and_empty_tables(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0]), (None, [2.0, 0.0])], SCHEMA)
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    rows = CE.knn_cells(q, e, 2).collect()
    assert {r.query_id for r in rows} == {7} and [(r.vec_id, r.similarity) for r in sorted(rows, key=lambda r: r['rank'])] == [(1, 1.0), (4, 0.7071)]
    assert CE.knn_cells(q, e.limit(0), 2).collect() == [] and CE.knn_cells(q.limit(0), e, 2).collect() == []
