"""Driver contract: entry runs, every query id is unique, oracle keys are a subset of queries."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == E.entry(spark).columns


def test_oracle_keys_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150
