"""Sources: malformed lines, SQL guard, fallback never mixes keys, overlay rules."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from churnlab.operators import lookups as LK
from churnlab.sources import files as SF


def test_csv_malformed_row_is_kept_aside(spark):
    d = tempfile.mkdtemp(prefix="churnlab-csv-")
    with open(os.path.join(d, "c.csv"), "w") as f:
        f.write(",".join(x.name for x in SF.CUSTOMER_SCHEMA.fields) + "\n")
        f.write("a,30,12,One Year,Basic,Credit Card,50,600,1,2,0.5,10,1,2,3,4,0\n")
        f.write("b,notanumber,12,One Year,Basic,Credit Card,50,600,1,2,0.5,10,1,2,3,4,0\n")
    df = SF.read_customers(spark, d)
    rows = {r.customer_id: r for r in df.collect()}
    assert rows["a"]._corrupt_record is None and rows["a"].age == 30.0
    assert rows["b"]._corrupt_record is not None


def test_jsonl_drops_bad_lines(spark):
    d = tempfile.mkdtemp(prefix="churnlab-jsonl-")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('{"event": "retrain_trigger", "feedback_count": 50, "timestamp": "2024-01-01T00:00:00Z"}\n')
        f.write('{"event": broken\n')
    df = SF.read_audit(spark, d)
    assert df.count() == 1 and df.first()["ts"] is not None


def test_sql_select_refuses_writes(spark):
    with pytest.raises(ValueError):
        SF.sql_select(spark, "DROP TABLE x")
    with pytest.raises(ValueError):
        SF.sql_select(spark, "SELECT 1; DROP TABLE x")
    assert SF.sql_select(spark, "SELECT :a AS v", {"a": 3}).first()["v"] == 3


def test_fallback_never_uses_another_key(spark):
    a = spark.createDataFrame([(1, "a1")], "k int, v string")
    b = spark.createDataFrame([(1, "b1"), (2, "b2")], "k int, v string")
    got = dict(SF.coalesce_sources(a, b, "k").collect())
    assert got == {1: "a1", 2: "b2"}


def test_overlay_null_keeps_base_and_latest_wins(spark):
    base = spark.createDataFrame([(1, 10.0, "One Year")], "customer_id int, monthly_charges double, contract_type string")
    edits = spark.createDataFrame([(1, 1, 20.0, None), (1, 2, None, "Two Year"), (1, 3, 30.0, None)],
                                  "customer_id int, updated_at int, monthly_charges double, contract_type string")
    r = LK.overlay_updates(base, edits, editable=["monthly_charges", "contract_type"]).first()
    assert r.monthly_charges == 30.0 and r.contract_type == "Two Year"
