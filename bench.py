"""Headline-query benchmark.

Runs the bench-flagged queries of the catalog at $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": "total_wall_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed fully with the ``noop`` sink (no collect to the driver);
its time includes plan building (fitted quantiles/bounds are small Spark jobs)
and the stage-boundary writes; the best of $BENCH_REPEATS (default 2) runs is kept.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from claimlens.session import get_session
    spark = get_session(master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2))})
    from claimlens.plans import catalog
    from claimlens.plans import queries_ml

    qs = catalog.queries()
    keys = catalog.bench_keys()
    # Warm-up (not timed): JVM JIT, parquet footers and the stage-table write paths.
    for k in ("claim_rollup", "dashboard_metrics"):
        qs[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for k in keys:
        best = None
        for _ in range(REPEATS):  # best of REPEATS: JIT and file-cache effects vary run to run
            t0 = time.time()
            qs[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.time() - t0
            best = dt if best is None else min(best, dt)
        times[k] = round(best, 3)
    # Batch scoring throughput (R9): fitted model applied to the whole feature table.
    rows, secs = queries_ml.scoring_throughput(spark, sf_dir)
    times["score_batch"] = round(secs, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_wall_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": float(m.group(1)) if m else sf_dir, "score_rows_per_sec": round(rows / secs, 1) if secs else None,
           "cpus": int(cpus)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
