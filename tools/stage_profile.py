"""Run one registered query with Spark's event log in a scratch folder and
print per-stage task counts, wall time and summed task run time.

Usage: python tools/stage_profile.py <query> [sf_dir]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    ev = tempfile.mkdtemp(prefix="ll-events-")
    from pyspark.sql import SparkSession

    from ledgerline.session import REQUIRED_CONF
    b = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", ev)
         .config("spark.eventLog.compress", "false")
         .config("spark.sql.shuffle.partitions", "8"))
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from ledgerline.plans.catalog import registry
    build = registry()[name].build
    build(spark, sf_dir).collect()  # warm-up
    t0 = time.time()
    df = build(spark, sf_dir)
    t1 = time.time()
    df.collect()
    t2 = time.time()
    print(f"build {t1 - t0:.2f}s exec {t2 - t1:.2f}s")
    spark.stop()
    stages, jobs_t = {}, {}
    for f in glob.glob(os.path.join(ev, "*", "events_*")) + glob.glob(os.path.join(ev, "local-*")):
        for line in io.open(f, encoding="utf-8"):
            e = json.loads(line)
            if e["Event"] == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                run = sum(a.get("Value", 0) for a in si.get("Accumulables", []) if a.get("Name") == "internal.metrics.executorRunTime")
                stages[si["Stage ID"]] = (si["Number of Tasks"], (si["Completion Time"] - si["Submission Time"]) / 1000, run / 1000,
                                          si["Submission Time"])
    first = min(v[3] for v in stages.values())
    for k, (n, wall, run, sub) in sorted(stages.items()):
        print(f"stage {k:4d} start {(sub - first) / 1000:7.2f}s tasks {n:3d} wall {wall:6.2f}s task-run {run:6.2f}s")


if __name__ == "__main__":
    main()
