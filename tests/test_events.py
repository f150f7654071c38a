"""Decision timeout border, feedback trigger, and stream == batch on the same files."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from churnlab.operators import events as EV
from churnlab.streaming import jobs as S


def _req_dec(spark, wait):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    req = spark.createDataFrame([(1, 7, t0, "CRITICAL")], "request_id long, user_id long, request_ts timestamp, risk_tier string")
    dec = spark.createDataFrame([(7, t0 + dt.timedelta(seconds=wait), 99, "rejected")],
                                "user_id long, decision_ts timestamp, decision_id long, decision string")
    return req, dec


def test_decision_border(spark):
    assert EV.decision_timeout(*_req_dec(spark, 1800)).first()["status"] == "rejected"
    assert EV.decision_timeout(*_req_dec(spark, 1801)).first()["status"] == "auto_approved"


def test_decision_across_bucket_boundary(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 50, 0)
    req = spark.createDataFrame([(1, 7, t0, "CRITICAL")], "request_id long, user_id long, request_ts timestamp, risk_tier string")
    dec = spark.createDataFrame([(7, t0 + dt.timedelta(seconds=1200), 99, "approved")],
                                "user_id long, decision_ts timestamp, decision_id long, decision string")
    assert EV.decision_timeout(req, dec).first()["status"] == "approved"


def _shuffled(spark, sf, tmp_path, files=4):
    """The events as several files in random order: as many micro-batches, rows late by up to the whole range."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    folder = f"{tmp_path}/shuffled"
    ev.repartition(files, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return folder, ev


def _same(a, b, cols):
    assert sorted(map(tuple, a.select(*cols).collect()), key=repr) == sorted(map(tuple, b.select(*cols).collect()), key=repr)


def test_streams_over_many_shuffled_batches(spark, sf, tmp_path):
    folder, ev = _shuffled(spark, sf, tmp_path)
    req, dec = EV.requests_and_decisions(ev)
    cols = ["request_id", "status", "decision_id", "wait_seconds"]
    stream, late = S.decision_timeout_run(spark, folder, watermark="60 days", max_files=1)
    assert late == 0
    _same(EV.decision_timeout(req, dec), stream, cols)
    _same(EV.decision_timeout(req, dec), S.decision_timeout_stream(spark, sf), cols)  # one file in order

    runs, late = S.run_complete_run(spark, folder, watermark="60 days", max_files=1)
    one = S.run_complete_stream(spark, sf)
    assert late == 0 and runs.agg(F.sum("steps")).first()[0] == ev.count() == one.agg(F.sum("steps")).first()[0]
    _same(runs, one, ["user_id", "steps", "last_event_id"])
    assert {r.status for r in one.collect()} <= {"complete", "timeout", "pending"}

    latest = EV.progress_latest(ev, "user_id", "ts", ["event_type", "value", "event_id"])
    _same(latest, S.progress_latest_stream(spark, folder, max_files=1), latest.columns)
    for keep in (90 * 86_400, 3 * 86_400, 6 * 3600):  # never expired, some, many lives
        last = EV.latest_feedback(ev, ["user_id", "event_type"], "ts", "event_id", ["value"], keep)
        _same(last, S.dedupe_stream(spark, folder, max_files=1, keep_seconds=keep), ["user_id", "event_type", "event_id", "value", "n_writes"])
    day = EV.progress_latest(ev, "user_id", "ts", ["event_type", "value", "event_id"], keep_seconds=86_400)
    assert day.count() < latest.count()
    _same(day, S.progress_latest_stream(spark, folder, max_files=1, keep_seconds=86_400), day.columns)
    windows = EV.window_rate(ev, "ts", "1 hour", by=["event_type"])
    counts, late = S.windowed_counts_run(spark, folder, watermark="60 days", max_files=1)
    assert late == 0
    _same(windows, counts, ["window_start", "event_type", "n"])
    n = ev.filter("event_type = 'purchase'").count()
    got = S.feedback_retrain_stream(spark, folder, max_files=1).collect()
    assert sorted(r.feedback_count for r in got) == list(range(50, n + 1, 50))


def test_late_rows_are_counted_not_fatal(spark, sf, tmp_path):
    folder, ev = _shuffled(spark, sf, tmp_path)
    counts, late = S.windowed_counts_run(spark, folder, watermark="1 hour", max_files=1)
    assert late > 0 and counts.agg(F.sum("n")).first()[0] < ev.count()  # late: partial counts per window, not rows
    stream, late = S.decision_timeout_run(spark, folder, watermark="1 hour", max_files=1)
    asked = ev.filter("event_type IN ('view', 'click', 'error')").count()
    assert 0 < late < asked and stream.groupBy("request_id").count().filter("count > 1").isEmpty()
    runs, late = S.run_complete_run(spark, folder, watermark="1 hour", max_files=1)
    assert runs.agg(F.sum("steps")).first()[0] + late == ev.count()


def test_feedback_trigger_every_50(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").filter(F.col("event_type") == "purchase")
    n = ev.count()
    t = EV.feedback_retrain(ev).collect()
    assert [r.feedback_count for r in t] == list(range(50, n + 1, 50))
    st = S.feedback_retrain_stream(spark, sf).collect()
    assert sorted(r.feedback_count for r in st) == [r.feedback_count for r in t]


def test_last_feedback_wins_and_expires(spark):
    rows = [("a", 1, 0, 1.0), ("a", 2, 10, 2.0), ("a", 3, 100, 3.0), ("a", 4, 105, 4.0), ("b", 5, 0, 5.0), ("c", 6, 90, 6.0), ("c", 7, 90, 7.0), ("d", 8, 110, 8.0)]
    d = spark.createDataFrame(rows, "k string, id long, s long, v double").withColumn("t", F.timestamp_seconds("s"))
    got = {r["k"]: (r["id"], r["v"], r["since"].second + 60 * r["since"].minute, r["n_writes"]) for r in EV.latest_feedback(d, ["k"], "t", "id", ["v"], 50).collect()}
    assert got == {"a": (4, 4.0, 100, 2), "c": (7, 7.0, 90, 2), "d": (8, 8.0, 110, 1)}  # a begins anew at 100, b has expired


def test_change_feed_follows_current_values(spark, sf, tmp_path):
    """Equal edits are no change, a change back is one, whatever the number of micro-batches."""
    base = spark.createDataFrame([(1, "One Year", 10.0, None, None, 5.0)], "customer_id long, " + ", ".join(
        f"{c} {'string' if c == 'contract_type' else 'double'}" for c in S.EDITABLE))
    kinds = [(1, "purchase", 20.0), (2, "purchase", 20.0), (3, "purchase", 10.0), (4, "click", 1.0), (5, "click", 60.0), (6, "signup", 5.0), (7, "purchase", 10.0), (8, "error", 2.0), (9, "login", 1.0)]
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    want = [("contract_type", None, None, "One Year", "Two Year"), ("monthly_charges", 10.0, 20.0, None, None), ("monthly_charges", 20.0, 10.0, None, None), ("num_support_tickets_30d", None, 2.0, None, None)]
    for n, parts in (("one", [kinds]), ("many", [[k] for k in kinds])):
        folder = tmp_path / n
        for i, part in enumerate(parts):
            d = spark.createDataFrame([(e, 1, t, v, e) for e, t, v in part], "event_id long, user_id long, event_type string, value double, s long")
            d = d.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).withColumn("props", F.lit("{}")).select([f.name for f in schema.fields])
            d.coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
        feed = S.change_feed_stream(spark, str(folder), base, max_files=1)
        assert sorted((tuple(r[c] for c in ("field", "old_num", "new_num", "old_text", "new_text")) for r in feed.collect()), key=repr) == sorted(want, key=repr)


def test_late_rows_of_all_micro_batches_are_counted(spark, sf, tmp_path):
    """12 micro-batches, most with one late row, where the query keeps 4 progress records."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "4")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    folder = tmp_path / "late"
    rows = [(0, 1, "click", 1.0, 10_000_000)] + [(k, 1, "click", 1.0, 1000 * k) for k in range(1, 12)]
    for part in ([rows[0]], *[[r] for r in rows[1:]]):
        d = spark.createDataFrame(part, "event_id long, user_id long, event_type string, value double, s long")
        d = d.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).withColumn("props", F.lit("{}")).select([f.name for f in schema.fields])
        d.coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
    try:
        counts, late = S.windowed_counts_run(spark, str(folder), watermark="1 hour", max_files=1)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert late + counts.agg(F.sum("n")).first()[0] == 12 and late > 4


def _runs_by_hand(rows, limit, terminal):
    """(user, steps, last event, last of its user) per run, row by row."""
    got, by_user = [], {}
    for u, t, e, k in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by_user.setdefault(u, []).append((t, e, k))
    for u, ev in by_user.items():
        runs, before = [], None
        for t, e, k in ev:
            if before is None or before[2] == terminal or t - before[0] > limit:
                runs.append([0, None])
            runs[-1] = [runs[-1][0] + 1, e]
            before = (t, e, k)
        got += [(u, n, e, i == len(runs) - 1) for i, (n, e) in enumerate(runs)]
    return sorted(got)


def test_runs_across_buckets_and_hot_user(spark):
    """A user with a third of all events: runs that span many buckets, ties, no event type; windows over rows go by bucket."""
    rng = random.Random(3)
    rows = [(0, rng.randrange(0, 40_000), e, rng.choice(["view", "click", None, "purchase"] + ["view"] * 40)) for e in range(1500)]
    rows += [(rng.randrange(1, 60), rng.randrange(0, 40_000), e, rng.choice(["view", "click", "purchase"])) for e in range(1500, 4500)]
    rows += [(99, 100 * i, 5000 + i, "view") for i in range(400)]  # one run over eleven buckets
    d = spark.createDataFrame(rows, "user_id long, s long, event_id long, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    runs = EV.merge_runs(EV.run_pieces(d), 300)
    assert sorted(tuple(r) for r in runs.select("user_id", "steps", "event_id", "is_last").collect()) == _runs_by_hand(rows, 300, "purchase")
    # runs of a part, merged with the rest, are the runs of the whole
    early = EV.merge_runs(EV.run_pieces(d.filter("s < 17000")), 300).drop("is_last")
    both = EV.merge_runs(early.unionByName(EV.run_pieces(d.filter("s >= 17000"))), 300)
    _same(runs.filter("user_id = 99"), both.filter("user_id = 99"), ["user_id", "steps", "event_id", "is_last"])
    assert EV.merge_runs(EV.run_pieces(d.filter("s < 0")), 300).isEmpty()


def test_hot_user_streams(spark, sf, tmp_path):
    """A third of the events belong to one user: the streams give the batch result over shuffled micro-batches."""
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 7).otherwise(F.col("user_id")))
    ev.repartition(3, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/hot/events.parquet")
    stream, late = S.decision_timeout_run(spark, f"{tmp_path}/hot", watermark="60 days", max_files=1)
    assert late == 0
    _same(EV.decision_timeout(*EV.requests_and_decisions(ev)), stream, ["request_id", "status", "decision_id", "wait_seconds"])
    runs, late = S.run_complete_run(spark, f"{tmp_path}/hot", watermark="60 days", max_files=1)
    assert late == 0
    want = EV.merge_runs(EV.run_pieces(ev), 300).select("user_id", "steps", F.col("event_id").alias("last_event_id"))
    _same(want, runs, ["user_id", "steps", "last_event_id"])


def test_streams_settle_as_the_watermark_moves(spark, sf, tmp_path):
    """In-order micro-batches without delay: same results as one batch, and little is held; rows without a time are dropped and counted."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    ev.repartitionByRange(5, "ts").write.parquet(f"{tmp_path}/order/events.parquet")
    req, dec = EV.requests_and_decisions(ev)
    files = sorted((tmp_path / "order" / "events.parquet").glob("*.parquet"))
    for i, f in enumerate(files):  # a file stream takes the oldest file first
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream, late = S.decision_timeout_run(spark, f"{tmp_path}/order", max_files=1)
    assert late == 0
    _same(EV.decision_timeout(req, dec), stream, ["request_id", "status", "decision_id", "wait_seconds"])
    runs, late = S.run_complete_run(spark, f"{tmp_path}/order", max_files=1)
    assert late == 0
    _same(S.run_complete_stream(spark, sf), runs, ["user_id", "steps", "last_event_id", "status"])
    ev.limit(0).write.parquet(f"{tmp_path}/empty/events.parquet")
    assert S.run_complete_run(spark, f"{tmp_path}/empty", max_files=1)[0].isEmpty() and S.decision_timeout_run(spark, f"{tmp_path}/empty", max_files=1)[0].isEmpty()
    nulls = ev.limit(5).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    nulls.write.parquet(f"{tmp_path}/null/events.parquet")
    assert S.run_complete_run(spark, f"{tmp_path}/null", max_files=1)[1] == 5


def test_progress_queries_keep_users_of_long_ago(spark, tmp_path):
    """The registered queries return every user, also one whose last event lies days before the newest."""
    from churnlab.plans import q_events, q_streaming

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0, 7, "view", 1.0, "{}"), (2, t0 + dt.timedelta(hours=1), 7, "click", 2.0, "{}"), (3, t0 + dt.timedelta(days=9), 8, "error", 3.0, "{}")]
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    pq.write_table(pa.Table.from_pylist([dict(zip(names, r)) for r in rows]), f"{tmp_path}/events.parquet")
    for query in (q_events.q_progress, q_streaming.q_progress_stream):
        assert sorted((r.user_id, r.event_id) for r in query(spark, str(tmp_path)).collect()) == [(7, 2), (8, 3)]
