"""Benchmark the headline analyses; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3). Each query is run once to warm the JVM, then
BENCH_REPEAT times; the median wall time of building and fully evaluating the
ordered result (written to Spark's noop sink) is reported per query, and
their sum as the metric.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [a for a in sys.argv[1:] if not a.startswith("-")]

    from ledgerline.plans.catalog import HEADLINE, registry
    from ledgerline.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(2, cpus), app="ledgerline-bench")
    reg = registry()
    names = only or HEADLINE
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        build = reg[name].build
        rows[name] = build(spark, sf_dir).count()  # warm-up
        samples = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 4)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_median_query_sec",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
