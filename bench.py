"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with seconds per query and their sum.

Each query is executed in full through the no-op sink (all rows produced,
nothing collected to the driver). Warm runs are timed: every query first runs
once, untimed, on the smallest test tables ($BENCH_WARMUP_DIR, default
/root/testdata/sf0.001) so JVM JIT and Spark's code-generation cache are warm;
set BENCH_WARMUP_DIR="" to time cold runs instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:] if not a.startswith("-")]

    from sparkprep.session import local_session
    from sparkprep.plans.registry import all_queries

    spark = local_session(cpus, shuffle_partitions=max(2 * cpus, 8), app="sparkprep-bench",
                          extra={"spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024)})
    qs = all_queries()
    names = [n for n in qs if not only or any(n.startswith(o) for o in only)]

    # warm-up (JVM JIT, generated-code cache, Python workers); not timed
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001").rstrip("/")
    for n in (names if warm_dir else ["pj1_hg_train"]):
        try:
            qs[n].build(spark, warm_dir or sf_dir).write.format("noop").mode("overwrite").save()
        except Exception:
            pass  # reported by the timed run

    times: dict[str, float] = {}
    jobs: dict[str, int] = {}
    failed: dict[str, str] = {}
    sc = spark.sparkContext
    for n in names:
        sc.setJobGroup(n, n)
        t0 = time.perf_counter()
        try:
            qs[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.perf_counter() - t0, 3)
            jobs[n] = len(sc.statusTracker().getJobIdsForGroup(n))
        except Exception as e:  # keep going; report which failed
            failed[n] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": cpus, "n_queries": len(times), "spark_jobs": jobs,
           "warmup": f"each query once at {warm_dir}" if warm_dir else "cold"}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
