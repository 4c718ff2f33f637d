"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the
cores; BENCH_RUNS (default 3) the timed runs per query, of which the median counts; a query is not run again after 30 s. One query runs
first to warm the session up.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from beatloom.plans import catalog  # noqa: E402
from beatloom.session import local_session  # noqa: E402

HEADLINE = {
    "lane_usage": "a03_lane_usage",
    "beat_grid": "g02_beat_grid",
    "nearest_anchor": "j02_nearest_anchor",
    "shape_events": "g04_shape_events",
    "chart_metrics": "a01_a11_chart_metrics",
    "evaluate": "g09_evaluate",
    "match_onsets": "j08_match_onsets",
    "hit_extraction": "p06_p24_project_hits",
}


MOST = 30  # seconds after which a query is not run again


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "beatloom-bench")
    times = {}
    catalog.QUERIES["a03_lane_usage"](spark, sf).write.format("noop").mode("overwrite").save()
    for name, key in HEADLINE.items():
        seen = []
        while len(seen) < runs and sum(seen) < MOST:
            t = time.time()
            catalog.QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
            seen.append(time.time() - t)
        times[name] = round(statistics.median(seen), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
