"""Section 2.14 batch forms: windows, error rate, histograms, counters, decision timeout, feedback trigger."""

from pyspark.sql import functions as F

from churnlab.operators import events as EV
from churnlab.plans.oracle import rnd
from churnlab.plans.registry import out, register
from churnlab.sources.tables import table

LAT_BOUNDS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
NOW = "2024-01-15 12:00:00"


def events(spark, sf):
    return table(spark, sf, "events")


@register("win_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, "
          "strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, COUNT(*) AS n "
          "FROM events GROUP BY 1, 2, 3", headline=True)
def q_tumbling(spark, sf):
    return out(EV.window_rate(events(spark, sf), "ts", "1 hour", by=["event_type"]))


@register("win_sliding", rnd("""
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
  event_type, COUNT(*) AS n, AVG(value) AS avg_value
FROM (SELECT event_type, value, make_timestamp(CAST(FLOOR(epoch_us(ts) / 900e6) * 900e6 AS BIGINT) - CAST(k AS BIGINT) * 900000000) AS ws
      FROM events CROSS JOIN (SELECT UNNEST([0, 1, 2, 3]) AS k) AS kk) AS a GROUP BY 1, 2, 3""", "avg_value"))
def q_sliding(spark, sf):
    return out(EV.window_rate(events(spark, sf), "ts", "1 hour", "15 minutes", by=["event_type"], value="value"))


@register("win_error_rate", rnd("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(*) AS requests,
  COUNT(*) FILTER (WHERE event_type = 'error' AND value >= 50) AS errors_5xx, COUNT(*) FILTER (WHERE event_type = 'error' AND NOT value >= 50) AS errors_4xx,
  COUNT(*) FILTER (WHERE event_type = 'error' AND value >= 50) * 100e0 / COUNT(*) AS rate_5xx_pct,
  COUNT(*) FILTER (WHERE event_type = 'error' AND NOT value >= 50) * 100e0 / COUNT(*) AS rate_4xx_pct FROM events GROUP BY 1""",
    "rate_5xx_pct,rate_4xx_pct"))
def q_error_rate(spark, sf):
    e = events(spark, sf)
    return out(EV.error_rate(e, "ts", "1 hour", F.col("event_type") == "error", F.col("value") >= 50))


HB = "hb AS (" + " UNION ALL ".join(
    [f"SELECT event_type, {b}e0 AS le, COUNT(*) FILTER (WHERE value / 100e0 <= {b}) AS count FROM events GROUP BY 1" for b in LAT_BOUNDS]
    + ["SELECT event_type, 'infinity'::DOUBLE AS le, COUNT(value) AS count FROM events GROUP BY 1"]) + ")"


def buckets(spark, sf):
    e = events(spark, sf).withColumn("latency_s", F.col("value") / 100.0)
    return EV.hist_buckets(e, "latency_s", LAT_BOUNDS, by=["event_type"])


@register("hist_buckets", "WITH " + HB + " SELECT * FROM hb")
def q_hist(spark, sf):
    return buckets(spark, sf)


@register("hist_quantile", rnd("WITH " + HB + """,
hq AS (SELECT *, COALESCE(LAG(le) OVER w, 0e0) AS ple, COALESCE(LAG(count) OVER w, 0) AS pc, MAX(count) OVER (PARTITION BY event_type) AS tot
       FROM hb WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, q, CASE WHEN le = 'infinity'::DOUBLE THEN ple WHEN count = pc THEN le
  ELSE ple + (le - ple) * (q * tot - pc) / (count - pc) END AS value FROM (
  SELECT hq.*, qs.q, ROW_NUMBER() OVER (PARTITION BY event_type, qs.q ORDER BY le) AS r FROM hq CROSS JOIN (SELECT UNNEST([0.5e0, 0.95e0, 0.99e0]) AS q) AS qs
  WHERE count >= qs.q * tot) AS x WHERE r = 1""", "q,value"))
def q_hist_q(spark, sf):
    b = buckets(spark, sf)
    res = None
    for q in (0.5, 0.95, 0.99):
        r = EV.hist_quantile(b, q, by=["event_type"])
        res = r if res is None else res.unionByName(r)
    return out(res)


@register("counter_by_label", """
SELECT event_type, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 50 THEN 'low' ELSE 'high' END AS k_band, COUNT(*) AS count
FROM events GROUP BY 1, 2""")
def q_counter(spark, sf):
    e = events(spark, sf).withColumn("k_band", F.when(F.get_json_object("props", "$.k").cast("int") < 50, "low").otherwise("high"))
    return EV.counter_by_label(e, ["event_type", "k_band"])


@register("endpoint_normalise", r"""
SELECT page_id, p AS path, CASE WHEN bad IS NULL THEN p ELSE substr(p, 1, strpos(p, bad) - 1) || '{id}' || substr(p, strpos(p, bad) + length(bad)) END AS endpoint
FROM (SELECT page_id, p, list_filter(string_split(p, '/'), lambda s: s <> '' AND NOT regexp_matches(replace(replace(s, '-', ''), '_', ''), '^\p{L}+$'))[1] AS bad
      FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS p FROM pages) AS a) AS b""")
def q_endpoint(spark, sf):
    pg = table(spark, sf, "pages").select("page_id", EV.url_path("url").alias("path"))
    return pg.withColumn("endpoint", EV.endpoint_normalise("path"))


REQ = """req AS (SELECT event_id AS request_id, user_id, ts AS request_ts,
  CASE WHEN LEAST(value / 100e0, 1e0) >= 0.85 THEN 'CRITICAL' WHEN LEAST(value / 100e0, 1e0) >= 0.70 THEN 'HIGH'
       WHEN LEAST(value / 100e0, 1e0) >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier FROM events WHERE event_type = 'view')""", \
    """dec AS (SELECT user_id, ts AS decision_ts, event_id AS decision_id, CASE WHEN event_type = 'click' THEN 'approved' ELSE 'rejected' END AS decision
  FROM events WHERE event_type IN ('click', 'error'))""", \
    """dt AS (SELECT req.request_id, req.user_id, req.risk_tier, req.request_ts, dec.decision, dec.decision_id,
  (epoch_us(dec.decision_ts) - epoch_us(req.request_ts)) / 1e6 AS wait FROM req ASOF LEFT JOIN dec ON req.user_id = dec.user_id AND dec.decision_ts > req.request_ts)""", \
    """res AS (SELECT request_id, user_id, risk_tier, request_ts,
  CASE WHEN risk_tier = 'CRITICAL' THEN CASE WHEN wait IS NOT NULL AND wait <= 1800 THEN decision ELSE 'auto_approved' END
       WHEN risk_tier = 'HIGH' THEN 'auto_approved_alert' ELSE 'auto_approved' END AS status,
  CASE WHEN risk_tier = 'CRITICAL' AND wait <= 1800 THEN decision_id END AS decision_id,
  CASE WHEN risk_tier = 'CRITICAL' AND wait <= 1800 THEN wait END AS wait_seconds FROM dt)"""


@register("st_decision_timeout", rnd("WITH " + ", ".join(REQ) + " SELECT request_id, user_id, risk_tier, status, decision_id, wait_seconds FROM res",
                                     "wait_seconds"))
def q_decision_timeout(spark, sf):
    req, dec = EV.requests_and_decisions(events(spark, sf))
    return out(EV.decision_timeout(req, dec))


@register("gauge_pending", "WITH " + ", ".join(REQ) + f"""
SELECT COUNT(*) AS pending FROM res WHERE risk_tier = 'CRITICAL' AND epoch(request_ts) <= epoch(TIMESTAMP '{NOW}')
  AND epoch(request_ts) + 1800 > epoch(TIMESTAMP '{NOW}') AND (decision_id IS NULL OR epoch(request_ts) + wait_seconds > epoch(TIMESTAMP '{NOW}'))""")
def q_gauge(spark, sf):
    req, dec = EV.requests_and_decisions(events(spark, sf))
    now = spark.sql(f"SELECT unix_micros(TIMESTAMP '{NOW}') / 1e6 AS t").first()["t"]
    return EV.gauge_pending(req, dec, now)


@register("st_feedback_retrain", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, n AS feedback_count FROM (
  SELECT event_id, ts, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') AS a WHERE n % 50 = 0""")
def q_feedback(spark, sf):
    return out(EV.feedback_retrain(events(spark, sf).filter(F.col("event_type") == "purchase")))


@register("st_progress_latest", rnd("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, MAX_BY(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY user_id""", "value"))
def q_progress(spark, sf):
    return out(EV.progress_latest(events(spark, sf), "user_id", "ts", ["event_type", "value", "event_id"]))


@register("st_dedupe_feedback", rnd("""
SELECT user_id, event_type, event_id, value, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, n_writes FROM (
  SELECT *, MAX(life) OVER (PARTITION BY user_id, event_type) AS newest FROM (
    SELECT user_id, event_type, life, MIN(ts) AS since, MAX(ts) AS until, COUNT(*) AS n_writes, arg_max(event_id, (ts, event_id)) AS event_id,
      arg_max(value, (ts, event_id)) AS value
    FROM (SELECT *, SUM(CASE WHEN gap IS NULL OR gap >= INTERVAL 90 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS life
      FROM (SELECT *, ts - LAG(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events) AS a) AS b
    GROUP BY user_id, event_type, life) AS c) AS d
WHERE life = newest AND (SELECT MAX(ts) FROM events) - until < INTERVAL 90 DAY""", "value"))
def q_dedupe(spark, sf):
    return out(EV.latest_feedback(events(spark, sf), ["user_id", "event_type"], "ts", "event_id", ["value"]))
