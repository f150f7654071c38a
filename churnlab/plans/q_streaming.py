"""Streaming forms, held against the SQL of their batch forms; many shuffled files are tested in tests/."""

from churnlab.plans import q_events  # noqa: F401 - its oracles are the batch forms'
from churnlab.plans.oracle import rnd, with_c360
from churnlab.plans.registry import ORACLE, out, register
from churnlab.sources.tables import customer360_table as customer360
from churnlab.streaming import jobs as S
from churnlab.operators import lookups as LK




def _sql(name):
    """The batch form's oracle: with one file in event-time order nothing is late."""
    return ORACLE[name]


@register("st_window_counts_stream", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2, 3""")
def q_win_stream(spark, sf):
    return out(S.windowed_counts_stream(spark, sf))


@register("st_progress_latest_stream", _sql("st_progress_latest"))
def q_progress_stream(spark, sf):
    return out(S.progress_latest_stream(spark, sf))


@register("st_decision_timeout_stream", _sql("st_decision_timeout"))
def q_decision_stream(spark, sf):
    return out(S.decision_timeout_stream(spark, sf))


@register("st_feedback_retrain_stream", _sql("st_feedback_retrain"))
def q_feedback_stream(spark, sf):
    return out(S.feedback_retrain_stream(spark, sf))


@register("st_dedupe_feedback_stream", _sql("st_dedupe_feedback"))
def q_dedupe_stream(spark, sf):
    return out(S.dedupe_stream(spark, sf))


# runs: a new one begins after a terminal event or after more than 300 s of silence
@register("st_run_complete", """
WITH o AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, MAX(epoch_us(ts)) OVER () AS m,
    LAG(epoch_us(ts)) OVER w AS pt, LAG(event_type) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, SUM(CASE WHEN pt IS NULL OR pe = 'purchase' OR t - pt > 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run,
    LEAD(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nt FROM o),
g AS (SELECT user_id, run, COUNT(*) AS steps, arg_max(event_id, (t, event_id)) AS last_event_id, arg_max(event_type, (t, event_id)) AS le, MAX(t) AS lt,
    MAX(m) AS m, MAX(CASE WHEN nt IS NULL THEN 1 ELSE 0 END) AS open FROM r GROUP BY user_id, run)
SELECT user_id, steps, last_event_id, CASE WHEN le = 'purchase' THEN 'complete' WHEN open = 1 AND lt + 300000000 >= (m // 1000) * 1000 THEN 'pending' ELSE 'timeout' END AS status
FROM g""")
def q_run_complete(spark, sf):
    return S.run_complete_stream(spark, sf)


_EDITS = {"contract_type": ("CASE WHEN event_type = 'click' THEN CASE WHEN value > 50 THEN 'Two Year' ELSE 'One Year' END END", "contract_type"),
          "monthly_charges": ("CASE WHEN event_type = 'purchase' THEN value END", "monthly_charges"),
          "num_support_tickets_30d": ("CASE WHEN event_type = 'error' THEN value END", "num_support_tickets_30d"),
          "feature_adoption_rate": ("CASE WHEN event_type = 'view' THEN value / 100e0 END", "feature_adoption_rate"),
          "nps_score": ("CASE WHEN event_type = 'signup' THEN value END", "nps_score")}
_ED = "ed AS (SELECT user_id AS customer_id, ts, " + ", ".join(f"{e} AS {c}" for c, (e, _) in _EDITS.items()) + " FROM events)"


@register("st_upsert_customers", rnd(with_c360(
    "SELECT c.customer_id, " + ", ".join(f"COALESCE(l.{c}, c.{c}) AS {c}" for c in _EDITS) + " FROM c360 AS c LEFT JOIN l ON l.customer_id = c.customer_id",
    _ED, "l AS (SELECT customer_id, " + ", ".join(f"arg_max({c}, ts) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _EDITS) + " FROM ed GROUP BY customer_id)"),
    ",".join(c for c in _EDITS if c != "contract_type")))
def q_upsert_stream(spark, sf):
    base = customer360(spark, sf).select("customer_id", *LK.EDITABLE)
    return out(S.upsert_customers_stream(spark, sf, base))


_LONG = ("le AS (SELECT user_id AS customer_id, ts, event_id, CASE event_type WHEN 'click' THEN 'contract_type' WHEN 'purchase' THEN 'monthly_charges' "
         "WHEN 'error' THEN 'num_support_tickets_30d' WHEN 'view' THEN 'feature_adoption_rate' WHEN 'signup' THEN 'nps_score' END AS field, "
         "CASE WHEN event_type = 'view' THEN value / 100e0 WHEN event_type <> 'click' THEN value END AS num, "
         "CASE WHEN event_type = 'click' THEN CASE WHEN value > 50 THEN 'Two Year' ELSE 'One Year' END END AS text FROM events)")
_BASE = "bv AS (" + " UNION ALL ".join(
    f"SELECT customer_id, '{c}' AS field, {'NULL' if c == 'contract_type' else c} AS num, {c if c == 'contract_type' else 'NULL'} AS text FROM c360" for c in _EDITS) + ")"
_WIN = "(PARTITION BY le.customer_id, le.field ORDER BY ts, event_id)"


@register("st_change_feed", rnd(with_c360(
    "SELECT customer_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, field, old_num, new_num, old_text, new_text FROM ch "
    "WHERE old_num IS DISTINCT FROM new_num OR old_text IS DISTINCT FROM new_text", _LONG, _BASE,
    "ch AS (SELECT le.customer_id, ts, le.field, le.num AS new_num, le.text AS new_text, "
    f"CASE WHEN ROW_NUMBER() OVER {_WIN} = 1 THEN bv.num ELSE LAG(le.num) OVER {_WIN} END AS old_num, "
    f"CASE WHEN ROW_NUMBER() OVER {_WIN} = 1 THEN bv.text ELSE LAG(le.text) OVER {_WIN} END AS old_text "
    "FROM le JOIN bv ON bv.customer_id = le.customer_id AND bv.field = le.field WHERE le.num IS NOT NULL OR le.text IS NOT NULL)"), "old_num,new_num"))
def q_change_feed(spark, sf):
    base = customer360(spark, sf).select("customer_id", *LK.EDITABLE)
    return out(S.change_feed_stream(spark, sf, base))
