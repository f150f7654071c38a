"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is forced to completion with the ``noop`` writer (full evaluation,
no collection to the driver).  A warm-up run of the first query pays the JVM
start-up so it is not charged to any query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from churnlab.plans.registry import HEADLINE, load_all  # noqa: E402
from churnlab.session import local_session  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "8")), app="churnlab-bench")
    qs, _ = load_all()
    names = names or list(HEADLINE)
    qs[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up (JVM, code paths)
    times = {}
    # the operators read customer360 as a table written once per session; its build is timed here
    from churnlab.sources.tables import customer360_table
    t0 = time.perf_counter()
    customer360_table(spark, sf_dir)
    times["customer360_materialize"] = round(time.perf_counter() - t0, 3)
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
