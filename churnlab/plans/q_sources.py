"""Section 2.1 sources/sinks and 2.11 retention_run: CSV, JSON lines, parameterised SQL, fallback source,
synthetic generator keyed by the customer table, and the end-to-end flow."""

from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators import decide as D
from churnlab.operators import models as MD
from churnlab.plans.oracle import rnd, with_c360
from churnlab.plans.registry import out, register
from churnlab.plans.retention import retention_run
from churnlab.sources import files as SF
from churnlab.sources.generator import synthetic_customers
from churnlab.sources.tables import customer360_table as customer360, table
from churnlab.streaming.jobs import scratch_path

CSV_COLS = [f.name for f in SF.CUSTOMER_SCHEMA.fields]


def c360(spark, sf):
    return customer360(spark, sf)


@register("src_csv", rnd(with_c360("SELECT CAST(customer_id AS VARCHAR) AS customer_id, " + ", ".join(
    c for c in CSV_COLS if c not in ("customer_id", "churn")) + ", CAST(churned AS INTEGER) AS churn, CAST(NULL AS VARCHAR) AS _corrupt_record FROM c360"),
    [c for c in fx.RAW_NUMERIC]))
def q_csv(spark, sf):
    path = scratch_path(spark, "customers-csv")
    d = c360(spark, sf).select(F.col("customer_id").cast("string").alias("customer_id"),
                               *[c for c in CSV_COLS if c not in ("customer_id", "churn")], F.col("churned").alias("churn"))
    d.write.option("header", "true").csv(path)
    return out(SF.read_customers(spark, path))


def _audit_records(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.lit("crm_action").alias("event"), F.col("event_id").cast("string").alias("action_id"),
                     F.col("user_id").cast("string").alias("customer_id"), F.col("event_type").alias("action_type"),
                     F.lit("scheduled").alias("status"), fx.ab_assign(F.col("user_id"), "retention_v1").alias("ab_group"),
                     F.round("value", 2).alias("cost_usd"), F.col("ts").alias("timestamp"))


AUDIT_SQL = """au AS (SELECT 'crm_action' AS event, CAST(event_id AS VARCHAR) AS action_id, CAST(user_id AS VARCHAR) AS customer_id,
  event_type AS action_type, 'scheduled' AS status, ROUND(value, 2) AS cost_usd, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", ts, event_id FROM events)"""


@register("snk_jsonl", rnd("WITH " + AUDIT_SQL + " SELECT event, action_id, customer_id, action_type, status, cost_usd, \"timestamp\" FROM au",
                           "cost_usd"))
def q_sink(spark, sf):
    path = scratch_path(spark, "audit")
    SF.append_audit(_audit_records(spark, sf), path)
    return out(SF.read_audit(spark, path).select("event", "action_id", "customer_id", "action_type", "status", "cost_usd", "timestamp"))


@register("src_jsonl", rnd("WITH " + AUDIT_SQL + """ SELECT event, action_id, customer_id, action_type, cost_usd, "timestamp" FROM au
ORDER BY strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ') DESC, event, action_id DESC LIMIT 50""", "cost_usd"))
def q_src_jsonl(spark, sf):
    path = scratch_path(spark, "audit")
    SF.append_audit(_audit_records(spark, sf), path)
    a = SF.read_audit(spark, path)
    recent = a.orderBy(F.col("ts").desc_nulls_last(), F.col("event"), F.col("action_id").cast("bigint").desc()).limit(50)
    return out(recent.select("event", "action_id", "customer_id", "action_type", "cost_usd", "timestamp"))


@register("src_sql_params", rnd(with_c360("""
SELECT customer_id, churn_probability, segment FROM c360 WHERE churn_probability >= 0.7 AND segment = 'BUILDING'"""), "churn_probability"))
def q_sql_params(spark, sf):
    c360(spark, sf).createOrReplaceTempView("c360")
    return out(SF.sql_select(spark, "SELECT customer_id, churn_probability, segment FROM c360 WHERE churn_probability >= :min_p AND segment = :seg",
                             {"min_p": 0.7, "seg": "BUILDING"}))


@register("src_fallback", rnd(with_c360("""
SELECT customer_id, login_frequency_30d, 'events' AS source FROM c360 WHERE login_frequency_30d IS NOT NULL
UNION ALL SELECT customer_id, 0e0 AS login_frequency_30d, 'default' AS source FROM c360 WHERE login_frequency_30d IS NULL"""), "login_frequency_30d"))
def q_fallback(spark, sf):
    d = c360(spark, sf)
    a = d.filter(F.col("login_frequency_30d").isNotNull()).select("customer_id", "login_frequency_30d", F.lit("events").alias("source"))
    b = d.select("customer_id", F.lit(0.0).alias("login_frequency_30d"), F.lit("default").alias("source"))
    return out(SF.coalesce_sources(a, b, "customer_id"))


@register("gen_customers")
def q_gen(spark, sf):
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return out(synthetic_customers(keys, "key", seed=42, churn_rate=0.27))


@register("retention_run", headline=True)
def q_run(spark, sf):
    from churnlab.operators import explain as X
    from churnlab.plans.q_ml import sc_terms
    d = c360(spark, sf)
    sc = MD.Scorecard.fit(d)
    r = retention_run(d, sc, lambda act: X.attrib_rows(act, sc_terms(sc)), D.CATALOGUE_A, budget=300.0)
    return out(r)
