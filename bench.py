"""Benchmark the headline analyses.

Runs each headline query from the registry on the tables in $BENCH_SF_DIR
(default /root/testdata/sf0.1) on local[$BENCH_CPUS], forcing full
evaluation with the ``noop`` sink (nothing is collected to the driver).
One warm-up pass, then the median of $BENCH_RUNS timed passes per query.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.plans.registry import BENCH_SET, load_all  # noqa: E402
from ledgerline.session import build_session  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    queries, _ = load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(BENCH_SET)).split(",") if n]
    results = {}
    for name in names:
        fn = queries[name]

        def once():
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()  # warm-up: JIT, file listing, Python workers
        results[name] = round(statistics.median(once() for _ in range(runs)), 3)
    total = round(sum(results.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec",
                      "queries": results, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
                      "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
