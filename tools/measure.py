"""Time the headline queries and sum their shuffle bytes from Spark's event log.

Usage: python tools/measure.py <sf_dir> [<sf_dir> ...]   -> markdown table rows on stdout.
The event log goes to a fresh scratch folder; no UI or REST endpoint is used.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from churnlab.plans.registry import HEADLINE, load_all  # noqa: E402
from churnlab.session import DEFAULT_CONF  # noqa: E402
from churnlab.sources.tables import customer360_table  # noqa: E402


def run(sf_dir: str):
    logdir = tempfile.mkdtemp(prefix="run-eventlog-")
    b = SparkSession.builder.master("local[8]").appName("churnlab-measure")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = (b.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false")
             .config("spark.eventLog.dir", logdir).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from churnlab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    qs, _ = load_all()
    qs["customer360"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    spark.sparkContext.setJobGroup("customer360_materialize", "m")
    t0 = time.perf_counter()
    customer360_table(spark, sf_dir)
    times["customer360_materialize"] = time.perf_counter() - t0
    for n in HEADLINE:
        spark.sparkContext.setJobGroup(n, n)
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = time.perf_counter() - t0
    spark.stop()
    stage_group, shuffle = {}, {}
    for path in glob.glob(os.path.join(logdir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                e = json.loads(line)
                if e.get("Event") == "SparkListenerJobStart":
                    g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in e.get("Stage IDs", []):
                        stage_group[sid] = g
                elif e.get("Event") == "SparkListenerTaskEnd":
                    m = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    sid = e.get("Stage ID")
                    shuffle[sid] = shuffle.get(sid, 0) + int(m.get("Shuffle Bytes Written", 0))
    per = {}
    for sid, by in shuffle.items():
        g = stage_group.get(sid)
        if g:
            per[g] = per.get(g, 0) + by
    return times, per


def main():
    results = [run(d) for d in sys.argv[1:]]
    names = list(results[0][0])
    for n in names:
        cells = []
        for t, s in results:
            cells += [f"{t[n]:.2f}", f"{s.get(n, 0) / 1e6:.1f}"]
        ratio = results[-1][0][n] / results[0][0][n] if len(results) > 1 and results[0][0][n] else float("nan")
        print(f"| {n} | " + " | ".join(cells) + f" | {ratio:.1f} |")


if __name__ == "__main__":
    main()
