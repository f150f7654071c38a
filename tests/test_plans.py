"""Plan shape: no raw-row single-partition exchange, filters and column pruning reach the scan."""

from churnlab.operators import metrics as M
from churnlab.operators import temporal as TM
from churnlab.operators.lookups import lookup_by_id
from churnlab.sources.tables import customer360, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_no_raw_single_partition(p):
    """A single-partition exchange is fine above a partial aggregate (one row per task) or the
    P1 bucket-total table (one row per bucket), never above raw rows."""
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            assert "partial_" in below or "HashAggregate(keys=[]" in below or "HashAggregate(keys=[_b#" in below, line + "\n" + below


def test_auc_has_no_single_partition_over_rows(spark, sf):
    assert_no_raw_single_partition(plan(M.auc_roc(customer360(spark, sf), "churned", "churn_probability", by=["segment"])))


def test_km_no_single_partition(spark, sf):
    assert_no_raw_single_partition(plan(TM.km_curve(customer360(spark, sf), "tenure_months", "churned", by="segment")))


def test_global_auc_and_greedy_prefix_no_single_partition(spark, sf):
    assert_no_raw_single_partition(plan(M.auc_roc(customer360(spark, sf), "churned", "churn_probability")))
    assert_no_raw_single_partition(plan(M.lift_curve(customer360(spark, sf), "churned", "churn_probability")))


def test_lookup_pushes_filter_and_prunes(spark, sf):
    o = table(spark, sf, "orders")
    p = plan(lookup_by_id(o, "o_orderkey", 7).select("o_orderkey", "o_totalprice"))
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def rows_scanned(df):
    """(rows returned, rows its scan gave out): rows of row groups or pages that were skipped do not count."""
    rows = df.collect()
    p = df._jdf.queryExecution().executedPlan()
    p = p.finalPhysicalPlan() if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else p
    return rows, p.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_lookup_on_clustered_table_reads_few_rows(spark, sf, tmp_path):
    import duckdb
    from pyspark.sql import functions as F

    from churnlab.operators.lookups import cluster_for_lookup

    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    n, key = o.count(), o.agg(F.min(F.when(F.col("o_orderkey") >= 700, F.col("o_orderkey")))).first()[0]
    t = cluster_for_lookup(o, "o_orderkey", str(tmp_path / "t"), files=4, row_group_bytes=4096)
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, o.collect()))
    rows, read = rows_scanned(lookup_by_id(t, "o_orderkey", key))
    assert rows == lookup_by_id(o, "o_orderkey", key).collect() and 1 <= read <= n / 4
    meta = duckdb.sql(f"SELECT file_name, row_group_id, bloom_filter_offset, stats_min_value::BIGINT, stats_max_value::BIGINT "
                      f"FROM parquet_metadata('{tmp_path}/t/*.parquet') WHERE path_in_schema = 'o_orderkey'").fetchall()
    ranges = sorted(m[3:] for m in meta)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and all(m[2] is not None for m in meta)
    # a key inside the ranges that does not occur: turned away by the Bloom filter
    gap = o.select(F.col("o_orderkey").alias("k")).distinct()
    absent = spark.range(1, int(ranges[-1][1])).join(gap, F.col("id") == F.col("k"), "left_anti").limit(5).collect()
    for a in absent:
        assert rows_scanned(lookup_by_id(t, "o_orderkey", a[0])) == ([], 0)
    hot = o.withColumn("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, 5).otherwise(F.col("o_orderkey")))
    h = cluster_for_lookup(hot, "o_orderkey", str(tmp_path / "h"), files=6)
    sizes = [r["n"] for r in h.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < n / 3  # a third of the rows under one key lie in several files


def test_topk_uses_window_group_limit(spark, sf):
    from churnlab.operators.frames import top_k_per_group
    from pyspark.sql import functions as F
    p = plan(top_k_per_group(customer360(spark, sf), "segment", [F.col("monthly_charges").desc(), F.col("customer_id")], 3))
    assert "WindowGroupLimit" in p
