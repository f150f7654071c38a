"""Sections 2.3 / 2.4 / 2.5 (profile, feedback, batch) / 2.13: validation, lookups, erasure, sorts and sets."""

from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators import frames as FR
from churnlab.operators import lookups as LK
from churnlab.operators import quality as Q
from churnlab.operators import stats as ST
from churnlab.operators.prefix import prefix_sum, rank_avg
from churnlab.plans.oracle import rnd, with_c360
from churnlab.plans.registry import out, register
from churnlab.sources.tables import customer360_by_id
from churnlab.sources.tables import customer360_table as customer360, table


def c360(spark, sf):
    return customer360(spark, sf)


def _rule_sql(rules):
    """(name, SQL predicate true when the row passes) — DuckDB text for the same rule table."""
    res = []
    for r in rules.columns:
        c = r.name
        if not r.nullable:
            res.append((f"{c}:not_null", f"{c} IS NOT NULL"))
        if r.dtype != "string":
            t = {"double": "DOUBLE", "int": "INTEGER"}[r.dtype]
            res.append((f"{c}:type_{r.dtype}", f"({c} IS NULL OR TRY_CAST({c} AS {t}) IS NOT NULL)"))
        if r.ge is not None:
            res.append((f"{c}:ge_{r.ge:g}", f"({c} IS NULL OR {c} >= {r.ge!r})"))
        if r.le is not None:
            res.append((f"{c}:le_{r.le:g}", f"({c} IS NULL OR {c} <= {r.le!r})"))
        if r.isin is not None:
            vals = ", ".join(repr(v) for v in r.isin)
            res.append((f"{c}:isin", f"({c} IS NULL OR {c} IN ({vals}))"))
    return res


def _rules_sql(rules):
    parts = [f"SELECT '{n}' AS rule, COUNT(*) FILTER (WHERE NOT ({p})) AS failing, "
             f"MIN(CASE WHEN NOT ({p}) THEN CAST(customer_id AS VARCHAR) END) AS sample FROM c360" for n, p in _rule_sql(rules)]
    parts.append("SELECT 'customer_id:unique' AS rule, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS failing, MIN(CAST(customer_id AS VARCHAR)) AS sample "
                 "FROM (SELECT customer_id, COUNT(*) AS n FROM c360 GROUP BY 1 HAVING COUNT(*) > 1) AS d")
    return with_c360(" UNION ALL ".join(parts))


def _rows_sql(rules):
    cases = ", ".join(f"CASE WHEN NOT ({p}) THEN '{n}' END" for n, p in _rule_sql(rules))
    return (f"vr AS (SELECT customer_id, concat_ws(',', {cases}, CASE WHEN COUNT(*) OVER (PARTITION BY customer_id) > 1 "
            f"THEN 'customer_id:unique' END) AS broken FROM c360)")


@register("validate_rules", _rules_sql(Q.CUSTOMER_RULES))
def q_validate_rules(spark, sf):
    return Q.validate_rules(c360(spark, sf), Q.CUSTOMER_RULES)


@register("validate_inference", _rules_sql(Q.INFERENCE_RULES))
def q_validate_inference(spark, sf):
    return Q.validate_rules(c360(spark, sf), Q.INFERENCE_RULES)


@register("validate_rows", with_c360("SELECT customer_id, broken, broken = '' AS valid FROM vr", _rows_sql(Q.CUSTOMER_RULES)))
def q_validate_rows(spark, sf):
    v = Q.validate_rows(c360(spark, sf), Q.CUSTOMER_RULES)
    return v.select("customer_id", F.array_join("broken", ",").alias("broken"), "valid")


WARN_SQL = ("concat_ws('; ', CASE WHEN tenure_months IS NULL THEN 'Missing required field: tenure_months' END, "
            "CASE WHEN monthly_charges IS NULL THEN 'Missing required field: monthly_charges' END, "
            "CASE WHEN contract_type IS NULL THEN 'Missing required field: contract_type' END, "
            "CASE WHEN COALESCE(monthly_charges, 0e0) <= 0 THEN 'monthly_charges is zero or negative' END)")


@register("quality_warnings", with_c360(f"SELECT customer_id, {WARN_SQL} AS warnings FROM c360"))
def q_warnings(spark, sf):
    return c360(spark, sf).select("customer_id", F.array_join(Q.quality_warnings(c360(spark, sf)), "; ").alias("warnings"))


NUM = fx.RAW_NUMERIC
ZS = ["la AS (SELECT feature, value FROM (SELECT " + ", ".join(NUM) + " FROM c360) UNPIVOT (value FOR feature IN (" + ", ".join(NUM) + ")) AS u)",
      "bs AS (SELECT feature, AVG(value) AS mean, STDDEV_SAMP(value) AS std FROM la GROUP BY feature)",
      "cl AS (SELECT customer_id, feature, value FROM (SELECT customer_id, " + ", ".join(NUM) + " FROM c360) UNPIVOT INCLUDE NULLS (value FOR feature IN ("
      + ", ".join(NUM) + ")) AS u)",
      """zs AS (SELECT customer_id, COUNT(*) FILTER (WHERE flag) AS n_flagged,
  COALESCE(string_agg(CASE WHEN flag THEN feature END, ',' ORDER BY feature), '') AS flagged
  FROM (SELECT cl.customer_id, cl.feature, COALESCE(cl.value IS NOT NULL AND bs.std >= 1e-9 AND ABS((cl.value - bs.mean) / bs.std) > 3, FALSE) AS flag
        FROM cl JOIN bs ON cl.feature = bs.feature) AS f GROUP BY customer_id)"""]
MISS = ("ROUND((" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in fx.RAW_NUMERIC + fx.CATEGORICAL)
        + f") / {float(len(fx.RAW_NUMERIC + fx.CATEGORICAL))}e0, 4)")


@register("quality_report", rnd(with_c360(f"""
SELECT c.customer_id, vr.broken = '' AS valid, {MISS} AS missing_pct, zs.n_flagged, zs.flagged AS anomaly_features,
  {WARN_SQL} AS warnings, vr.broken = '' AND {WARN_SQL} = '' AND zs.n_flagged / 12e0 < 0.3 AS passed
FROM c360 AS c JOIN vr ON c.customer_id = vr.customer_id JOIN zs ON c.customer_id = zs.customer_id""",
    _rows_sql(Q.CUSTOMER_RULES), *ZS), "missing_pct"))
def q_quality_report(spark, sf):
    d = c360(spark, sf)
    v = Q.validate_rows(d, Q.CUSTOMER_RULES).select(
        "customer_id", F.col("valid"), fx.missing_pct(*fx.RAW_NUMERIC, *fx.CATEGORICAL).alias("missing_pct"),
        F.array_join(Q.quality_warnings(d), "; ").alias("warnings"))
    z = ST.zscore_flags(d, ST.baseline_stats(d, NUM), NUM).select("customer_id", "n_flagged", F.col("flagged").alias("anomaly_features"),
                                                                  F.col("passed").alias("_zp"))
    r = v.join(z, "customer_id")
    return out(r.withColumn("passed", F.col("valid") & (F.col("warnings") == "") & F.col("_zp")).drop("_zp"))


@register("filter_status", rnd(with_c360("""
SELECT customer_id, churned, monthly_charges FROM c360 WHERE churned = 1 ORDER BY customer_id LIMIT 50"""), "monthly_charges"))
def q_filter_status(spark, sf):
    return out(Q.filter_status(c360(spark, sf), "churned", "churned", limit=50).select("customer_id", "churned", "monthly_charges"))


@register("select_safe_columns", rnd(with_c360("SELECT " + ", ".join(Q.SAFE_COLUMNS) + " FROM c360"),
                                     [c for c in Q.SAFE_COLUMNS if c in fx.RAW_NUMERIC] + ["churn_probability"]))
def q_safe(spark, sf):
    return out(Q.select_safe(c360(spark, sf)))


@register("filter_target_set", rnd(with_c360("SELECT customer_id, churn_probability FROM c360 WHERE churn_probability >= 0.70"),
                                   "churn_probability"))
def q_target(spark, sf):
    return out(Q.filter_target_set(c360(spark, sf)).select("customer_id", "churn_probability"))


COV = ["segment", "region", "contract_type", "plan_tier", "payment_method"]


@register("coverage_gaps", with_c360(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM c360 GROUP BY 2 HAVING COUNT(*) < 300" for c in COV)))
def q_coverage(spark, sf):
    return Q.coverage_gaps(c360(spark, sf), COV, min_n=300)


# ---- lookups, overlay, history, export, erasure ------------------------------------------------------
def edits(spark, sf):
    ev = table(spark, sf, "events")
    v, t = F.col("value"), F.col("event_type")
    return ev.select(F.col("user_id").alias("customer_id"), F.col("ts").alias("updated_at"),
                     F.when(t == "click", F.when(v > 50, "Two Year").otherwise("One Year")).alias("contract_type"),
                     F.when(t == "purchase", v).alias("monthly_charges"),
                     F.when(t == "error", v).alias("num_support_tickets_30d"),
                     F.when(t == "view", v / 100.0).alias("feature_adoption_rate"),
                     F.when(t == "signup", v).alias("nps_score"))


EDITS_SQL = """ed AS (SELECT user_id AS customer_id, ts AS updated_at,
  CASE WHEN event_type = 'click' THEN CASE WHEN value > 50 THEN 'Two Year' ELSE 'One Year' END END AS contract_type,
  CASE WHEN event_type = 'purchase' THEN value END AS monthly_charges, CASE WHEN event_type = 'error' THEN value END AS num_support_tickets_30d,
  CASE WHEN event_type = 'view' THEN value / 100e0 END AS feature_adoption_rate, CASE WHEN event_type = 'signup' THEN value END AS nps_score FROM events)"""


@register("overlay_updates", rnd(with_c360("""
SELECT c.customer_id, COALESCE(l.contract_type, c.contract_type) AS contract_type, COALESCE(l.monthly_charges, c.monthly_charges) AS monthly_charges,
  COALESCE(l.num_support_tickets_30d, c.num_support_tickets_30d) AS num_support_tickets_30d,
  COALESCE(l.feature_adoption_rate, c.feature_adoption_rate) AS feature_adoption_rate, COALESCE(l.nps_score, c.nps_score) AS nps_score
FROM c360 AS c LEFT JOIN (SELECT customer_id, arg_max(contract_type, updated_at) FILTER (WHERE contract_type IS NOT NULL) AS contract_type,
  arg_max(monthly_charges, updated_at) FILTER (WHERE monthly_charges IS NOT NULL) AS monthly_charges,
  arg_max(num_support_tickets_30d, updated_at) FILTER (WHERE num_support_tickets_30d IS NOT NULL) AS num_support_tickets_30d,
  arg_max(feature_adoption_rate, updated_at) FILTER (WHERE feature_adoption_rate IS NOT NULL) AS feature_adoption_rate,
  arg_max(nps_score, updated_at) FILTER (WHERE nps_score IS NOT NULL) AS nps_score FROM ed GROUP BY customer_id) AS l
ON c.customer_id = l.customer_id""", EDITS_SQL), "monthly_charges,num_support_tickets_30d,feature_adoption_rate,nps_score"))
def q_overlay(spark, sf):
    base = c360(spark, sf).select("customer_id", *LK.EDITABLE)
    return out(LK.overlay_updates(base, edits(spark, sf)))


@register("lookup_by_id", rnd(with_c360("SELECT customer_id, segment, monthly_charges, churned FROM c360 WHERE customer_id = 7"),
                              "monthly_charges"))
def q_lookup(spark, sf):
    return out(LK.lookup_by_id(customer360_by_id(spark, sf), "customer_id", 7).select("customer_id", "segment", "monthly_charges", "churned"))


@register("history_top20", """
SELECT user_id, event_id, event_type, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) AS a WHERE rk <= 20""")
def q_history(spark, sf):
    ev = table(spark, sf, "events")
    return LK.history_top_n(ev, "user_id", "ts", 20, tiebreak="event_id").select("user_id", "event_id", "event_type", "rank")


@register("subject_export", """
SELECT c.c_custkey, c.c_nationkey, c.c_acctbal, c.c_mktsegment, o.o_orderkey, o.o_orderstatus, o.o_totalprice
FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey""")
def q_export(spark, sf):
    cust = table(spark, sf, "customer")
    logs = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_totalprice")
    return LK.subject_export(cust, logs, "c_custkey", pii=("c_name",))


def erasures(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select("c_custkey", F.lit("subject request").alias("reason"))


ER_SQL = "er AS (SELECT c_custkey, 'subject request' AS reason FROM customer WHERE c_acctbal < 0)"


@register("erase_apply", "WITH " + ER_SQL + """
SELECT CASE WHEN er.c_custkey IS NOT NULL THEN substr(sha256(CAST(c.c_custkey AS VARCHAR)), 1, 16) ELSE CAST(c.c_custkey AS VARCHAR) END AS c_custkey,
  CASE WHEN er.c_custkey IS NOT NULL THEN NULL ELSE c.c_name END AS c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment
FROM customer AS c LEFT JOIN er ON c.c_custkey = er.c_custkey""")
def q_erase_apply(spark, sf):
    return LK.erase_apply(table(spark, sf, "customer"), erasures(spark, sf), "c_custkey", pii=("c_name",))


@register("erase_exclude", "WITH " + ER_SQL + " SELECT c.c_custkey, c.c_name FROM customer AS c WHERE c.c_custkey NOT IN (SELECT c_custkey FROM er)")
def q_erase_exclude(spark, sf):
    return LK.erase_exclude(table(spark, sf, "customer"), erasures(spark, sf), "c_custkey").select("c_custkey", "c_name")


@register("erase_status", "WITH " + ER_SQL + """
SELECT c.c_custkey, er.reason, er.reason IS NOT NULL AS erased FROM customer AS c LEFT JOIN er ON c.c_custkey = er.c_custkey""")
def q_erase_status(spark, sf):
    return LK.erase_status(table(spark, sf, "customer"), erasures(spark, sf), "c_custkey")


# ---- sorts, limits, sets, sampling ---------------------------------------------------------------
@register("watchlist", rnd(with_c360("""
SELECT customer_id, monthly_charges, segment FROM c360 WHERE churned = 1 ORDER BY monthly_charges DESC, customer_id LIMIT 20"""),
    "monthly_charges"))
def q_watchlist(spark, sf):
    return out(FR.watchlist(c360(spark, sf), n=20).select("customer_id", "monthly_charges", "segment"))


@register("recent_n", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def q_recent(spark, sf):
    return FR.recent_n(table(spark, sf, "events"), "ts", 50, tiebreak="event_id").select("event_id", "user_id", "event_type")


@register("topk_per_group", rnd(with_c360("""
SELECT segment, customer_id, monthly_charges, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY monthly_charges DESC, customer_id) AS rk FROM c360) AS a WHERE rk <= 3"""),
    "monthly_charges"))
def q_topk(spark, sf):
    r = FR.top_k_per_group(c360(spark, sf), "segment", [F.col("monthly_charges").desc(), F.col("customer_id")], 3)
    return out(r.select("segment", "customer_id", "monthly_charges", "rank"))


@register("prefix_sum", rnd("""
SELECT o_custkey, o_orderkey, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS cum_spend FROM orders""",
    "cum_spend"))
def q_prefix(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice",
                                          F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"))
    r = prefix_sum(o, "day", ["o_totalprice"], by=["o_custkey"])
    return out(r.select("o_custkey", "o_orderkey", F.col("cum_o_totalprice").alias("cum_spend")))


@register("rank_avg", rnd(with_c360("""
SELECT segment, monthly_charges, COUNT(*) AS n, MIN(rk) + (COUNT(*) - 1) / 2e0 AS rank FROM (
  SELECT segment, monthly_charges, RANK() OVER (PARTITION BY segment ORDER BY monthly_charges) AS rk FROM c360) AS a
GROUP BY segment, monthly_charges"""), "monthly_charges,rank"))
def q_rank(spark, sf):
    return out(rank_avg(c360(spark, sf), "monthly_charges", by=["segment"]))


@register("set_union_categories", """
SELECT COALESCE(a.p, b.p) AS o_orderpriority, COALESCE(a.n, 0) AS n_a, COALESCE(b.n, 0) AS n_b FROM
  (SELECT o_orderpriority AS p, COUNT(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1) AS a
  FULL OUTER JOIN (SELECT o_orderpriority AS p, COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) AS b ON a.p = b.p""")
def q_union(spark, sf):
    o = table(spark, sf, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return FR.union_categories(o.filter(early), o.filter(~early), "o_orderpriority")


@register("set_intersect_topk", with_c360("""
SELECT a.segment, COUNT(b.customer_id) AS overlap FROM
  (SELECT segment, customer_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY monthly_charges DESC, customer_id) AS r FROM c360) AS x WHERE r <= 10) AS a
  LEFT JOIN (SELECT segment, customer_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY total_charges DESC, customer_id) AS r FROM c360) AS y WHERE r <= 10) AS b
  ON a.segment = b.segment AND a.customer_id = b.customer_id GROUP BY a.segment"""))
def q_intersect(spark, sf):
    d = c360(spark, sf)

    def top(col):
        t = FR.top_k_per_group(d, "segment", [F.col(col).desc(), F.col("customer_id")], 10)
        return t.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "customer_id"))),
                                                    lambda s: s["customer_id"]).alias(col))
    j = top("monthly_charges").join(top("total_charges"), "segment")
    return j.select("segment", FR.topk_overlap(F.col("monthly_charges"), F.col("total_charges"), 10).cast("bigint").alias("overlap"))


SAMPLE_SQL = "smp AS (SELECT customer_id FROM c360 ORDER BY CAST(('0x' || substr(md5('42:' || CAST(customer_id AS VARCHAR)), 1, 12)) AS BIGINT), customer_id LIMIT 100)"


@register("sample_n", with_c360("SELECT customer_id FROM smp", SAMPLE_SQL))
def q_sample(spark, sf):
    return FR.sample_n(c360(spark, sf), "customer_id", 100, seed=42).select("customer_id")


@register("set_except_split", with_c360("SELECT customer_id FROM c360 WHERE customer_id NOT IN (SELECT customer_id FROM smp)", SAMPLE_SQL))
def q_except(spark, sf):
    d = c360(spark, sf)
    return FR.except_rows(d.select("customer_id"), FR.sample_n(d, "customer_id", 100, seed=42), "customer_id")


@register("profile_describe", rnd(with_c360("""
SELECT feature, COUNT(value) AS count, AVG(value) AS mean, STDDEV_SAMP(value) AS std, MIN(value) AS min,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, MAX(value) AS max
FROM la GROUP BY feature""", ZS[0]), "mean,std,min,q25,q50,q75,max"))
def q_describe(spark, sf):
    from churnlab.operators.metrics import describe_profile
    return out(describe_profile(c360(spark, sf), NUM))


@register("feedback_stats", with_c360("""
SELECT arm AS ab_group, COUNT(*) AS total, COUNT(*) FILTER (WHERE outcome = 'retained') AS retained,
  COUNT(*) FILTER (WHERE outcome = 'churned') AS churned, CAST(50 - COUNT(*) % 50 AS BIGINT) AS remaining_to_retrain
FROM (SELECT CASE WHEN churned = 1 THEN 'churned' ELSE 'retained' END AS outcome,
  CASE WHEN (((((((CAST(('0x' || substr(md5(h), 1, 8)) AS BIGINT) % 100) * 96 + CAST(('0x' || substr(md5(h), 9, 8)) AS BIGINT)) % 100) * 96
   + CAST(('0x' || substr(md5(h), 17, 8)) AS BIGINT)) % 100) * 96 + CAST(('0x' || substr(md5(h), 25, 8)) AS BIGINT)) % 100) / 100e0 < 0.5
   THEN 'treatment' ELSE 'control' END AS arm
  FROM (SELECT *, 'retention_v1:' || CAST(customer_id AS VARCHAR) AS h FROM c360) AS a) AS f GROUP BY arm"""))
def q_feedback_stats(spark, sf):
    from churnlab.operators.metrics import feedback_stats
    d = c360(spark, sf).select(F.when(F.col("churned") == 1, "churned").otherwise("retained").alias("outcome"),
                               fx.ab_assign(F.col("customer_id"), "retention_v1").alias("ab_group"))
    return feedback_stats(d)


@register("batch_summary", with_c360("""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE broken = '') AS processed, COUNT(*) FILTER (WHERE broken <> '') AS failed FROM vr""",
    _rows_sql(Q.CUSTOMER_RULES)))
def q_batch(spark, sf):
    v = Q.validate_rows(c360(spark, sf), Q.CUSTOMER_RULES)
    return v.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("valid")).alias("processed"), F.count_if(~F.col("valid")).alias("failed"))
