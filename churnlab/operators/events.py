"""Event-log analytics in batch form: windows, histograms, counters, decision timeouts and
feedback triggers.  The streaming forms in :mod:`churnlab.streaming` must agree with these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.functions.features import risk_tier
from churnlab.operators.prefix import prefix_sum
from churnlab.session import cut_lineage

DECISION_SECONDS = 1800


def epoch_seconds(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def epoch_micros(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def window_rate(df: DataFrame, ts: str, size: str, slide: str | None = None, by=(), value: str | None = None) -> DataFrame:
    """Counts (and mean value) per event-time window, tumbling or sliding."""
    w = F.window(F.col(ts).cast("timestamp"), size, slide) if slide else F.window(F.col(ts).cast("timestamp"), size)
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.avg(value).alias("avg_value"))
    g = df.groupBy(w.alias("w"), *by).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[a for a in ("n", "avg_value") if a in g.columns])


def error_rate(df: DataFrame, ts: str, size: str, is_error: Column, is_5xx: Column) -> DataFrame:
    """5xx and 4xx share of requests in % per window."""
    g = df.groupBy(F.window(F.col(ts).cast("timestamp"), size).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(is_error & is_5xx).alias("errors_5xx"), F.count_if(is_error & ~is_5xx).alias("errors_4xx"))
    return g.select(F.col("w.start").alias("window_start"), "requests", "errors_5xx", "errors_4xx",
                    (F.col("errors_5xx") * 100.0 / F.col("requests")).alias("rate_5xx_pct"),
                    (F.col("errors_4xx") * 100.0 / F.col("requests")).alias("rate_4xx_pct"))


def hist_buckets(df: DataFrame, v: str, bounds: list[float], by=()) -> DataFrame:
    """Cumulative ``le`` buckets (Prometheus style) incl. +Inf, one aggregate pass."""
    aggs = [F.count_if(F.col(v) <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs.append(F.count(F.col(v)).alias("binf"))
    g = df.groupBy(*by).agg(*aggs)
    arr = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)]
    arr.append(F.struct(F.lit(float("inf")).alias("le"), F.col("binf").alias("count")))
    return g.select(*by, F.explode(F.array(*arr)).alias("_b")).select(*by, "_b.le", "_b.count")


def hist_quantile(buckets: DataFrame, q: float, by=()) -> DataFrame:
    """Quantile from cumulative buckets by linear interpolation inside the bucket (first lower edge 0);
    a quantile in the +Inf bucket returns the highest finite bound."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("le")
    b = buckets.withColumns({"_prev_le": F.coalesce(F.lag("le").over(w), F.lit(0.0)),
                             "_prev_c": F.coalesce(F.lag("count").over(w), F.lit(0)),
                             "_total": F.max("count").over(Window.partitionBy(*by))})
    rank = F.lit(q) * F.col("_total")
    hit = b.filter(F.col("count") >= rank).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    val = (F.when(F.col("le") == float("inf"), F.col("_prev_le"))
           .when(F.col("count") == F.col("_prev_c"), F.col("le"))
           .otherwise(F.col("_prev_le") + (F.col("le") - F.col("_prev_le")) * (rank - F.col("_prev_c")) / (F.col("count") - F.col("_prev_c"))))
    return hit.select(*by, F.lit(q).alias("q"), val.alias("value"))


def counter_by_label(df: DataFrame, labels) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("count"))


def endpoint_normalise(path) -> Column:
    """Replace the first path segment that is not purely letters (after dropping - and _) by {id}."""
    p = F.col(path) if isinstance(path, str) else path
    segs = F.filter(F.split(p, "/"), lambda s: (s != "") & ~F.translate(s, "-_", "").rlike(r"^\p{L}+$"))
    bad = F.get(segs, 0)
    pos = F.instr(p, bad)
    return F.when(bad.isNull(), p).otherwise(F.concat(F.substring(p, F.lit(1), pos - 1), F.lit("{id}"), F.substr(p, pos + F.length(bad))))


def url_path(url) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def requests_and_decisions(events: DataFrame):
    """Requests: 'view' events (tier from value / 100); decisions: 'click' approves, 'error' rejects."""
    ev = events.select("event_id", "user_id", "ts", "event_type", "value")
    req = ev.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("request_ts"),
        risk_tier(F.least(F.col("value") / 100.0, F.lit(1.0))).alias("risk_tier"))
    dec = ev.filter(F.col("event_type").isin("click", "error")).select(
        "user_id", F.col("ts").alias("decision_ts"), F.col("event_id").alias("decision_id"),
        F.when(F.col("event_type") == "click", "approved").otherwise("rejected").alias("decision"))
    return req, dec


def decision_timeout(requests: DataFrame, decisions: DataFrame, seconds: int = DECISION_SECONDS,
                     bucket_seconds: int = 4 * DECISION_SECONDS) -> DataFrame:
    """Outcome of each approval request: the first decision of the same key after the request counts
    if it comes within ``seconds`` (a reply exactly at the limit counts); otherwise ``auto_approved``.
    Only CRITICAL requests wait; HIGH is auto-approved with an alert, lower tiers pass.

    No per-key pair join: requests and decisions share one window per (key, time bucket); a decision in
    the first ``seconds`` of a bucket is also copied to the previous bucket, so a hot key is split by time.
    """
    lim, bk = int(seconds) * 1_000_000, int(bucket_seconds) * 1_000_000
    r = requests.select("request_id", "user_id", "risk_tier", "request_ts", epoch_micros("request_ts").alias("_t"), F.lit(0).alias("_kind"),
                        F.lit(None).cast("string").alias("decision"), F.lit(None).cast("long").alias("decision_id"))
    d0 = decisions.select(F.lit(None).cast("long").alias("request_id"), "user_id", F.lit(None).cast("string").alias("risk_tier"),
                          F.lit(None).cast(requests.schema["request_ts"].dataType).alias("request_ts"), epoch_micros("decision_ts").alias("_t"),
                          F.lit(1).alias("_kind"), "decision", "decision_id")
    b = F.floor(F.col("_t") / bk)
    u = r.withColumn("_bk", b).unionByName(d0.withColumn("_bk", b))
    spill = d0.filter(F.pmod(F.col("_t"), F.lit(bk)) <= lim).withColumn("_bk", F.floor(F.col("_t") / bk) - 1)
    u = u.unionByName(spill)
    w = Window.partitionBy("user_id", "_bk").orderBy("_t", F.col("_kind").desc(), "decision_id").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("_kind") == 1, F.struct(F.col("_t").alias("t"), F.col("decision").alias("d"),
                                                     F.col("decision_id").alias("id"))), ignorenulls=True).over(w)
    x = u.withColumn("_next", nxt).filter(F.col("_kind") == 0)
    wait = F.col("_next.t") - F.col("_t")
    in_time = F.col("_next").isNotNull() & (wait <= lim)
    status = (F.when(F.col("risk_tier") == "CRITICAL", F.when(in_time, F.col("_next.d")).otherwise("auto_approved"))
              .when(F.col("risk_tier") == "HIGH", "auto_approved_alert").otherwise("auto_approved"))
    crit = (F.col("risk_tier") == "CRITICAL") & in_time
    return x.select("request_id", "user_id", "risk_tier", status.alias("status"),
                    F.when(crit, F.col("_next.id")).alias("decision_id"), F.when(crit, wait / 1e6).alias("wait_seconds"))


def gauge_pending(requests: DataFrame, decisions: DataFrame, now, seconds: int = DECISION_SECONDS) -> DataFrame:
    """CRITICAL requests still open at ``now``: not decided yet and not yet past the limit."""
    res = decision_timeout(requests, decisions, seconds)
    open_ = (res.join(requests.select("request_id", "request_ts"), "request_id")
             .filter((F.col("risk_tier") == "CRITICAL") & (epoch_seconds("request_ts") <= F.lit(now))
                     & (epoch_seconds("request_ts") + seconds > F.lit(now))
                     & (F.col("decision_id").isNull() | (epoch_seconds("request_ts") + F.col("wait_seconds") > F.lit(now)))))
    return open_.agg(F.count(F.lit(1)).alias("pending"))


def feedback_retrain(feedback: DataFrame, every: int = 50, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Running count of feedback in time order; a retrain trigger at every multiple of ``every``."""
    f = feedback.select(key, ts, epoch_seconds(ts).alias("_t"), F.lit(1).alias("_one"))
    c = prefix_sum(f, "_t", ["_one"], tiebreak=[F.col(key).asc()])
    return c.filter(F.col("cum__one") % every == 0).select(key, ts, F.col("cum__one").alias("feedback_count"))


def progress_latest(df: DataFrame, key: str, ts: str, cols, keep_seconds: int | None = None) -> DataFrame:
    """Latest record per key (ties broken by the last column); with ``keep_seconds``, keys that are not older than that at
    the latest time of the table (older ones have expired)."""
    g = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(ts), F.col(cols[-1]))).alias("_l"), F.max(ts).alias("_at"))
    return unexpired(g, "_at", keep_seconds).select(key, "_l.*")


def unexpired(df: DataFrame, at: str, keep_seconds: int | None) -> DataFrame:
    """Rows whose ``at`` lies less than ``keep_seconds`` before the latest one."""
    if keep_seconds is None:
        return df
    now = df.agg(F.max(at).alias("_now"))  # one row
    return df.crossJoin(F.broadcast(now)).filter(F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) < keep_seconds * 1_000_000).drop("_now")


def lives(pieces: DataFrame, keys, keep_seconds: int) -> DataFrame:
    """Keyed records with a time to live: each write replaces the value and starts its time anew; after it the key is gone
    and a further write begins a new life.

    ``pieces``: keys, start and end (times of a piece's first and last write), n (its writes), last (its last record, a
    struct that begins with its time and a tiebreak).  Pieces in any order merge to the same lives.  Returns keys, since, n,
    last of each key's latest life, where that has not expired at the latest time of the table."""
    us = {c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("start", "end")}
    w = Window.partitionBy(*keys).orderBy(us["start"], us["end"])
    before = F.max(us["end"]).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (us["start"] - before >= keep_seconds * 1_000_000), 1).otherwise(0)
    numbered = pieces.withColumn("_fresh", fresh).withColumn("_life", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = numbered.groupBy(*keys, "_life").agg(F.min("start").alias("since"), F.sum("n").alias("n"), F.max("last").alias("last"), F.max("end").alias("end"))
    latest = each.groupBy(*keys).agg(F.max_by(F.struct("since", "n", "last", "end"), "_life").alias("_r")).select(*keys, "_r.*")
    return unexpired(latest, "end", keep_seconds).drop("end")


def write_pieces(df: DataFrame, keys, ts: str, tiebreak: str, cols, keep_seconds: int) -> DataFrame:
    """``df`` as pieces for :func:`lives`: writes of a key less than ``keep_seconds`` apart in one piece."""
    last = F.max(F.struct(F.col(ts), F.col(tiebreak), *[F.col(c) for c in cols])).alias("last")
    return df.groupBy(*keys, F.session_window(F.col(ts).cast("timestamp"), f"{keep_seconds} seconds")).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"), last).drop("session_window")


def latest_feedback(df: DataFrame, keys, ts: str, tiebreak: str, cols, keep_seconds: int = 90 * 86_400) -> DataFrame:
    """Feedback per key: the last one wins and is kept for 90 days; repeats are counted."""
    got = lives(write_pieces(df, keys, ts, tiebreak, cols, keep_seconds), keys, keep_seconds)
    return got.select(*keys, f"last.{tiebreak}", *[f"last.{c}" for c in cols], "since", F.col("n").alias("n_writes"))


def changes(edits: DataFrame, known: DataFrame) -> DataFrame:
    """Change capture: edits (customer_id, field, num, text, at, tie) against the value each field has by then.

    ``known`` (customer_id, field, num, text): the values before all of these edits; other customers' edits are left out.
    One record per real change with old and new value: an equal edit is none, a change back is one."""
    w = Window.partitionBy("customer_id", "field").orderBy("at", "tie")
    j = edits.join(known.select("customer_id", "field", F.struct("num", "text").alias("_known")), ["customer_id", "field"])
    j = j.withColumn("_new", F.struct("num", "text")).withColumn("_old", F.when(F.row_number().over(w) == 1, F.col("_known")).otherwise(F.lag("_new").over(w)))
    return j.filter(~F.col("_new").eqNullSafe(F.col("_old"))).select(
        "customer_id", "at", "field", F.col("_old.num").alias("old_num"), F.col("num").alias("new_num"), F.col("_old.text").alias("old_text"), F.col("text").alias("new_text"))


def dedupe_first(df: DataFrame, keys, ts: str, tiebreak: str) -> DataFrame:
    """First record per key (what ``dropDuplicatesWithinWatermark`` keeps in a stream)."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).asc(), F.col(tiebreak).asc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def run_pieces(events: DataFrame) -> DataFrame:
    """Each event as a run of one step, for :func:`merge_runs`."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select("user_id", F.lit(1).cast("long").alias("steps"), t.alias("first_t"), t.alias("t"), "event_id", "event_type")


def merge_runs(pieces: DataFrame, limit_seconds: int = 300, terminal: str = "purchase", bucket_seconds: int = 3600) -> DataFrame:
    """Runs of a user: a new one begins after a ``terminal`` event or after more than ``limit_seconds`` of silence.

    ``pieces``: user_id, steps, first_t, and t, event_id, event_type of the piece's last event; events and runs that have
    begun alike, ordered by (t, event_id).  Returns the same columns per run and ``is_last``: no run of the user follows.
    Pieces are put together within (user, time bucket); only the first and the last run of a bucket can reach into others,
    so a user's window sees two rows per bucket at most, however many events the user has."""
    limit, bucket = int(limit_seconds) * 1_000_000, int(bucket_seconds) * 1_000_000
    cols = ["user_id", "steps", "first_t", "t", "event_id", "event_type"]
    order, last = ["t", "event_id"], F.max(F.struct("t", "event_id", "event_type")).alias("_l")

    def begins(w):
        ended = F.coalesce(F.lag("event_type").over(w) == terminal, F.lit(False))
        return F.when(ended | (F.col("first_t") - F.lag("t").over(w) > limit), 1).otherwise(0)

    def runs(df, keys, fresh):
        w = Window.partitionBy(*keys).orderBy(*order)
        d = df.withColumn("_new", fresh(w)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        g = d.groupBy(*keys, "_run").agg(F.sum("steps").alias("steps"), F.min("first_t").alias("first_t"), last)
        return g.select(*keys, "_run", "steps", "first_t", "_l.*")

    local = runs(pieces.select(*cols, F.floor(F.col("t") / bucket).alias("_b")), ["user_id", "_b"], begins)
    local = cut_lineage(local.withColumn("_top", F.max("_run").over(Window.partitionBy("user_id", "_b"))))
    edge = (F.col("_run") == 0) | (F.col("_run") == F.col("_top"))
    inner = local.filter(~edge).select(*cols, F.lit(False).alias("is_last"))
    # the last run of a bucket is no continuation of its first
    joined = runs(local.filter(edge).select(*cols, "_b", F.col("_run").alias("_r")), ["user_id"],
                  lambda w: F.when((F.lag("_b").over(w) == F.col("_b")) & (F.col("_r") > 0), 1).otherwise(begins(w)))
    top = F.max("_run").over(Window.partitionBy("user_id"))
    return inner.unionByName(joined.select(*cols, (F.col("_run") == top).alias("is_last")))
