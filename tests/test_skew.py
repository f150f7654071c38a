"""A key holding a third of all rows: results stay exact and its work is split."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from churnlab.operators import events as EV
from churnlab.operators.prefix import prefix_sum


def _events(n=6000, hot_share=1 / 3, seed=3):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        user = 1 if rnd.random() < hot_share else rnd.randint(2, 60)
        ts = t0 + dt.timedelta(seconds=rnd.randint(0, 10 * 86400))
        et = rnd.choice(["view", "click", "error", "purchase"])
        rows.append((i, user, ts, et, float(rnd.randint(80, 100))))  # value/100 >= .85 -> CRITICAL
    return rows


def test_decision_timeout_hot_user_exact_and_split(spark):
    rows = _events()
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double")
    req, dec = EV.requests_and_decisions(ev)
    got = {r.request_id: r.status for r in EV.decision_timeout(req, dec).collect()}
    pdf = pd.DataFrame(rows, columns=["event_id", "user_id", "ts", "event_type", "value"]).sort_values(["ts", "event_id"])
    expect = {}
    for u, g in pdf.groupby("user_id"):
        g = g.reset_index(drop=True)
        for i, r in g[g.event_type == "view"].iterrows():
            later = g[(g.ts > r.ts) & g.event_type.isin(["click", "error"])]
            if r.value / 100 >= 0.85:
                if len(later) and (later.iloc[0].ts - r.ts).total_seconds() <= 1800:
                    expect[r.event_id] = "approved" if later.iloc[0].event_type == "click" else "rejected"
                else:
                    expect[r.event_id] = "auto_approved"
    assert {k: v for k, v in got.items() if k in expect} == expect
    # the hot user's rows are spread over many (user, time bucket) windows
    per = ev.filter(F.col("user_id") == 1).groupBy(F.floor(F.unix_micros(F.col("ts")) / (4 * 1800 * 1_000_000))).count()
    hot_rows = ev.filter(F.col("user_id") == 1).count()
    assert per.agg(F.max("count")).first()[0] < hot_rows / 10


def test_prefix_sum_hot_key_is_one_row(spark):
    rows = [(0.5 if i % 3 == 0 else i / 1000.0, 1) for i in range(3000)]  # a third of the rows share one score
    df = spark.createDataFrame(rows, "score double, one int").groupBy("score").agg(F.sum("one").alias("n"))
    r = {x.score: x.cum_n for x in prefix_sum(df, "score", ["n"]).collect()}
    assert r[0.5] == sum(1 for s, _ in rows if s <= 0.5)
