"""Print the shape of executed plans (exchanges, joins, window limits, scans) of registered queries.

Usage: python tools/plans.py <sf_dir> name [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from churnlab.plans.registry import load_all  # noqa: E402
from churnlab.session import local_session  # noqa: E402

KEEP = ("Exchange", "Join", "WindowGroupLimit", "Window [", "FileScan", "TakeOrdered", "Generate", "HashAggregate(keys=[")


def main():
    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    qs, _ = load_all()
    for n in names:
        df = qs[n](spark, sf)
        p = df._jdf.queryExecution().executedPlan().toString()
        print(f"== {n}")
        for line in p.splitlines():
            if any(k in line for k in KEEP):
                line = re.sub(r"#\d+L?", "", line)
                line = re.sub(r", \[plan_id=\d+\]", "", line)
                print("  " + line[:150])
    spark.stop()


if __name__ == "__main__":
    main()
