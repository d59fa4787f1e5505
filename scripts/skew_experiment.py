"""Hot-key experiment: one key holds a third of all rows. Runs the as-of engine
and a naive key-partitioned window on the same input with Spark's event log
written to a fresh scratch folder, then reports, per shuffle stage, the records
read by the busiest task against the median task (AQE off, so the exchanges
are exactly as planned).

usage: python scripts/skew_experiment.py [rows] [partitions]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from funnelkit.operators.lookup import asof_join  # noqa: E402
from funnelkit.session import build_session  # noqa: E402


def data(spark, n):
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000 + 1).alias("k"),
        (F.lit("2024-01-01").cast("timestamp_ntz") +
         F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 7919) % (90 * 86400))).alias("t"),
        F.col("id").alias("rid"))
    left = df.where(F.col("rid") % 4 == 0).select("k", "t", "rid")
    right = df.where(F.col("rid") % 4 != 0).select("k", F.col("t").alias("rt"), F.col("rid").alias("r"))
    return left, right


def naive(left, right):
    u = left.select("k", "t", "rid", F.lit(None).cast("long").alias("r"), F.lit(0).alias("s")) \
        .unionByName(right.select("k", F.col("rt").alias("t"), F.lit(None).cast("long").alias("rid"),
                                  "r", F.lit(1).alias("s")))
    w = Window.partitionBy("k").orderBy("t", "s").rowsBetween(Window.unboundedPreceding, -1)
    return u.withColumn("prev", F.last("r", ignorenulls=True).over(w)).where(F.col("s") == 0)


def stage_stats(log_dir):
    path = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
            if os.path.isfile(p) and not os.path.basename(p).startswith(".")
            and os.path.getsize(p) > 0][0]
    per_stage, names = {}, {}
    with open(path) as f:
        for line in f:
            e = json.loads(line)
            if e.get("Event") == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                recs = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                per_stage.setdefault(e["Stage ID"], []).append(recs)
            elif e.get("Event") == "SparkListenerStageCompleted":
                names[e["Stage Info"]["Stage ID"]] = e["Stage Info"]["Stage Name"]
    out = []
    for sid, recs in per_stage.items():
        if sum(recs) == 0:
            continue
        out.append((sid, max(recs), statistics.median(recs), sum(recs)))
    return sorted(out, key=lambda x: -x[1])


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 1_200_000
    parts = int(sys.argv[2]) if len(sys.argv) > 2 else 64
    results = {}
    # each variant runs twice, alternating; the second (warm JVM) run is kept
    for variant in ("engine", "naive", "engine", "naive"):
        log_dir = tempfile.mkdtemp(prefix="run-skew-")
        spark = build_session(cpus=8, shuffle_partitions=parts, extra={
            "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + log_dir,
            "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
            "spark.sql.adaptive.enabled": "false", "spark.driver.memory": "8g"})
        left, right = data(spark, n)
        t0 = time.perf_counter()      # the engine counts its keys when it is built
        df = asof_join(left, right, "k", "t", "rt", ["r"], tiebreak=["r"]) \
            if variant == "engine" else naive(left, right)
        df.write.format("noop").mode("overwrite").save()
        secs = time.perf_counter() - t0
        spark.stop()
        stats = stage_stats(log_dir)
        results[variant] = (secs, stats[0] if stats else None)
    print(json.dumps({v: {"seconds": round(s, 2), "busiest_stage_max_task_records": st[1],
                          "median_task_records": st[2], "stage_records": st[3]}
                      for v, (s, st) in results.items()}))


if __name__ == "__main__":
    main()
