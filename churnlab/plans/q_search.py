"""Section 2.12: vector kNN (exact, LSH and inverted lists), Euclidean neighbours, TF-IDF text search, upsert, stats."""

from pyspark.sql import functions as F

from churnlab.operators import cells as CE
from churnlab.operators import search as SE
from churnlab.plans.oracle import rnd, with_c360
from churnlab.plans.registry import out, register
from churnlab.sources.tables import customer360_table as customer360, table


def centroids(spark, sf):
    """One query vector per label: the element-wise mean embedding (rows = labels x dimensions)."""
    e = table(spark, sf, "embeddings")
    px = e.select("label", F.posexplode("embedding").alias("pos", "v"))
    m = px.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("embedding")) \
        .withColumnRenamed("label", "query_id")


CENT = """cen AS (SELECT label AS query_id, list(v ORDER BY pos) AS emb FROM (
  SELECT label, pos, AVG(CAST(v AS DOUBLE)) AS v FROM (
    SELECT label, UNNEST(embedding) AS v, UNNEST(generate_series(1, len(embedding))) AS pos FROM embeddings) AS a GROUP BY 1, 2) AS b GROUP BY 1)"""


@register("knn_cosine", """WITH """ + CENT + """
SELECT query_id, vec_id, CAST(rk AS INTEGER) AS rank, ROUND(sim, 4) AS similarity FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rk FROM (
    SELECT cen.query_id, e.vec_id, list_cosine_similarity(cen.emb, CAST(e.embedding AS DOUBLE[])) AS sim FROM embeddings AS e CROSS JOIN cen) AS s) AS r
WHERE rk <= 10""", headline=True)
def q_knn(spark, sf):
    return SE.knn_cosine(centroids(spark, sf), table(spark, sf, "embeddings"), 10)


@register("knn_lsh")
def q_knn_lsh(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")  # the stated query set, against all rows
    return SE.knn_lsh(q, e, 10)


@register("knn_cells")
def q_knn_cells(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")  # the stated query set, against all rows
    return CE.knn_cells(q, e, 10)


EU_COLS = ["age", "tenure_months", "monthly_charges", "nps_score"]
EU_SQL = """wl AS (SELECT * FROM c360 WHERE customer_id % 50 = 0)""", \
    """nb AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, customer_id) AS rk FROM (
  SELECT wl.customer_id AS query_id, c.customer_id, SQRT(""" + " + ".join(f"(c.{x} - wl.{x}) * (c.{x} - wl.{x})" for x in EU_COLS) + """) AS distance
  FROM c360 AS c CROSS JOIN wl WHERE c.customer_id <> wl.customer_id) AS d) AS r WHERE rk <= 5)"""


def _neighbours(spark, sf):
    d = customer360(spark, sf)
    q = d.filter(F.col("customer_id") % 50 == 0).select(F.col("customer_id").alias("query_id"), *EU_COLS)
    return d, SE.knn_euclid(q, d, EU_COLS, 5)


@register("knn_euclid", rnd(with_c360("SELECT query_id, customer_id, distance, CAST(rk AS INTEGER) AS rank FROM nb", *EU_SQL), "distance"))
def q_knn_euclid(spark, sf):
    _, nb = _neighbours(spark, sf)
    return out(nb.select("query_id", "customer_id", "distance", "rank"))


@register("retained_similar", rnd(with_c360("""
SELECT nb.query_id, COUNT(*) AS n_similar, COUNT(*) FILTER (WHERE c.churned = 0) AS n_retained, AVG(1e0 - c.churned) AS retained_share
FROM nb JOIN c360 AS c ON nb.customer_id = c.customer_id GROUP BY nb.query_id""", *EU_SQL), "retained_share"))
def q_retained_similar(spark, sf):
    d, nb = _neighbours(spark, sf)
    return out(SE.retained_similar(nb, d))


@register("text_search", """
WITH dt AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, regexp_split_to_table(lower(text), '[^a-z0-9]+') AS term FROM documents) AS a
            WHERE term <> '' GROUP BY 1, 2),
nd AS (SELECT COUNT(DISTINCT doc_id) AS n_docs FROM dt),
idf AS (SELECT term, LN((n_docs + 1e0) / (COUNT(*) + 1e0)) AS idf FROM dt CROSS JOIN nd GROUP BY term, n_docs),
dw AS (SELECT doc_id, term, tf * idf AS w FROM dt JOIN idf USING (term)),
dn AS (SELECT doc_id, SQRT(SUM(w * w)) AS dn FROM dw GROUP BY 1),
qt AS (SELECT item_id AS query_id, term, COUNT(*) AS tf FROM (SELECT item_id, regexp_split_to_table(lower(text), '[^a-z0-9]+') AS term FROM benchmark) AS a
       WHERE term <> '' GROUP BY 1, 2),
qw AS (SELECT query_id, term, tf * COALESCE(idf.idf, LN(nd.n_docs + 1e0)) AS qw FROM qt LEFT JOIN idf USING (term) CROSS JOIN nd),
qn AS (SELECT query_id, SQRT(SUM(qw * qw)) AS qn FROM qw GROUP BY 1),
sc AS (SELECT qw.query_id, dw.doc_id, SUM(dw.w * qw.qw) / (MAX(dn.dn) * MAX(qn.qn)) AS s FROM dw JOIN qw USING (term)
       JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY 1, 2)
SELECT query_id, doc_id, CAST(rk AS INTEGER) AS rank, ROUND(s, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(s, 9) DESC, doc_id) AS rk FROM sc) AS r WHERE rk <= 5""", headline=True)
def q_text(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return SE.text_search(q, table(spark, sf, "documents"), 5)


@register("vector_upsert", """
SELECT user_id, event_id, event_type FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) AS a WHERE rk = 1""")
def q_upsert(spark, sf):
    ev = table(spark, sf, "events")
    cut = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return SE.vector_upsert(ev.filter(cut), ev.filter(~cut), "user_id", "ts", tiebreak="event_id").select("user_id", "event_id", "event_type")


@register("collection_stats", "SELECT source, lang, COUNT(*) AS n FROM documents GROUP BY 1, 2")
def q_collection(spark, sf):
    return SE.collection_stats(table(spark, sf, "documents"), ["source", "lang"])
