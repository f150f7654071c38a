"""DuckDB text of the shared views, written independently of the Spark code.

The driver runs these against the same parquet files; results are compared
by row count, schema and value hash.  Every double that comes out of an
aggregation is rounded to 6 dp in both engines (summation order differs).
"""

C360_SELECT = """
WITH o AS (
  SELECT o_custkey AS k, COUNT(*) AS n_orders, MIN(o_orderdate) AS first_dt, MAX(o_orderdate) AS last_dt, SUM(o_totalprice) AS spend
  FROM orders GROUP BY o_custkey),
m AS (SELECT MAX(o_orderdate) AS ref_dt FROM orders),
em AS (SELECT MAX(ts) AS ref_ts FROM events),
e AS (
  SELECT user_id AS k, COUNT(*) AS logins,
    SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS tickets,
    SUM(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) * CAST(1 AS DOUBLE) / COUNT(*) AS adoption, MAX(ts) AS last_ts, MAX(ref_ts) AS ref_ts,
    SUM(CASE WHEN ts > ref_ts - INTERVAL 10 DAY THEN value ELSE 0e0 END) / 10e0 AS u10,
    SUM(CASE WHEN ts > ref_ts - INTERVAL 20 DAY THEN value ELSE 0e0 END) / 20e0 AS u20,
    SUM(value) / 30e0 AS u30
  FROM events CROSS JOIN em GROUP BY user_id)
SELECT CAST(c.c_custkey AS BIGINT) AS customer_id,
  CAST(18 + c.c_custkey % 58 AS DOUBLE) AS age,
  CAST(o.first_dt AS TIMESTAMP) AS signup_date,
  CAST(FLOOR(date_diff('day', o.first_dt, o.last_dt) / 30e0) AS DOUBLE) AS tenure_months,
  CASE WHEN c.c_custkey % 20 < 11 THEN 'Month-to-Month' WHEN c.c_custkey % 20 < 16 THEN 'One Year' ELSE 'Two Year' END AS contract_type,
  CASE WHEN c.c_custkey % 37 < 15 THEN 'Basic' WHEN c.c_custkey % 37 < 28 THEN 'Standard' ELSE 'Premium' END AS plan_tier,
  CASE c.c_custkey % 4 WHEN 0 THEN 'Credit Card' WHEN 1 THEN 'Bank Transfer' WHEN 2 THEN 'Electronic Check' ELSE 'Mailed Check' END AS payment_method,
  c.c_mktsegment AS segment, r.r_name AS region,
  o.spend / 1000e0 / (FLOOR(date_diff('day', o.first_dt, o.last_dt) / 30e0) + 1) AS monthly_charges, o.spend / 1000e0 AS total_charges,
  CAST(e.tickets AS DOUBLE) AS num_support_tickets_30d, CAST(e.logins AS DOUBLE) AS login_frequency_30d,
  CAST(e.adoption AS DOUBLE) AS feature_adoption_rate, c.c_acctbal / 100e0 AS nps_score,
  e.u10 AS usage_30d, e.u20 AS usage_60d, e.u30 AS usage_90d,
  CAST(date_diff('day', e.last_ts, e.ref_ts) AS DOUBLE) AS days_since_last_login,
  CASE WHEN date_diff('day', o.last_dt, m.ref_dt) > 180 THEN 1 ELSE 0 END AS churned,
  1e0 / (1e0 + EXP((o.n_orders - 10) / 3e0)) AS churn_probability,
  1e0 / (1e0 + EXP((FLOOR(date_diff('day', o.first_dt, o.last_dt) / 30e0) - 60) / 10e0)) AS challenger_probability
FROM customer c JOIN o ON c.c_custkey = o.k JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN e ON e.k = c.c_custkey CROSS JOIN m
"""

C360 = f"c360 AS ({C360_SELECT})"


def with_c360(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {C360}{extra}\n{body}"


def rnd(inner: str, cols, dp: int = 6) -> str:
    """Round the named double columns of ``inner`` (Spark side rounds all doubles)."""
    if isinstance(cols, str):
        cols = [c.strip() for c in cols.split(",") if c.strip()]
    if not cols:
        return inner
    rep = ", ".join(f"ROUND({c}, {dp}) + 0e0 AS {c}" for c in cols)  # + 0.0 turns -0.0 into 0.0
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) AS _q"
