"""Same results at 1 and 200 shuffle partitions (bucket counts follow the shuffle width)."""

import math

import pytest

import __spark_entry__ as E

NAMES = ["auc_roc", "lift_curve", "km_curve", "drift_ks", "psi", "budget_greedy", "knapsack_per_customer",
         "cohort_matrix", "st_feedback_retrain", "st_decision_timeout", "text_search", "conformal_quantile", "spearman"]


def _rows(df):
    def norm(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_partition_invariance(spark, sf, name):
    q = E.queries()[name]
    res = []
    for parts in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            res.append(_rows(q(spark, sf)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]
