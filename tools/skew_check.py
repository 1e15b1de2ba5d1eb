"""Measure how a hot key lands on reduce tasks for the latest-row operators.

Usage: python tools/skew_check.py <scratch_dir> [rows]

Builds a frame where key 0 holds a third of all rows (and, in the "ties"
case, all of its rows share the latest instant, so no top-k pruning can
apply), runs each strategy with the ``noop`` sink, and reads per-task shuffle
records and task times from Spark's event log in ``scratch_dir``.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _events(log_dir: str):
    import zstandard
    for f in sorted(glob.glob(f"{log_dir}/*/events_*") + glob.glob(f"{log_dir}/*")):
        if os.path.isdir(f):
            continue
        raw = open(f, "rb")
        stream = zstandard.ZstdDecompressor().stream_reader(raw) if f.endswith(".zstd") else raw
        for line in io.TextIOWrapper(stream, encoding="utf-8"):
            yield json.loads(line)


def main() -> None:
    log_dir = sys.argv[1]
    rows = int(sys.argv[2]) if len(sys.argv) > 2 else 3_000_000
    from pyspark.sql import functions as F

    from medwright.operators.aggs import string_agg
    from medwright.operators.windows import latest, latest_any
    from medwright.session import get_session
    # Coalescing is off so each reduce task's input reflects the key layout.
    spark = get_session("local[8]", app_name="skew-check", shuffle_partitions=16,
                        **{"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                           "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    base = spark.range(0, rows, 1, 16)  # 16 input partitions, no shuffle
    hot = (F.col("id") % 3 == 0)
    df = base.select(F.when(hot, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("k"),
                     (F.col("id") * 7919 % 100000).alias("t"), F.col("id").alias("v"))
    ties = base.select(F.when(hot, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("k"),
                       F.when(hot, F.lit(100000)).otherwise(F.col("id") * 7919 % 100000).alias("t"),
                       F.col("id").alias("v"))
    cases = {
        "latest one: window row_number": lambda: latest(df, "k", ["t", "v"], method="window"),
        "latest one: max(struct) aggregate": lambda: latest(df, "k", ["t", "v"]),
        "ties kept: window dense_rank": lambda: latest(ties, "k", "t", ties="all", method="window"),
        "ties kept: max + join back": lambda: latest(ties, "k", "t", ties="all"),
        "any at latest: max(struct(t, flag))": lambda: latest_any(ties, "k", "t", F.col("v") % 7 == 0),
        "list per key: rows joined, then aggregated": lambda: (
            df.join(keys, "k").groupBy("k").agg(string_agg(F.col("v"), ";").alias("l"))),
        "list per key: aggregated, then joined 1:1": lambda: (
            df.groupBy("k").agg(string_agg(F.col("v"), ";").alias("l")).join(keys, "k")),
    }
    keys = base.select((F.col("id") % 1000 + 1).alias("k")).union(spark.range(1).select(F.lit(0).alias("k"))) \
        .distinct().withColumn("label", F.concat(F.lit("key "), F.col("k").cast("string")))
    for name, build in cases.items():
        spark.sparkContext.setJobGroup(name, name)
        # the joined variants model a large other side: no broadcast allowed
        joined = name.startswith("list per key")
        for conf in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(conf, "-1" if joined else "10MB")
        build().write.format("noop").mode("overwrite").save()
    spark.stop()

    job_group, stage_group, tasks = {}, {}, {}
    for e in _events(log_dir):
        if e["Event"] == "SparkListenerJobStart":
            g = e.get("Properties", {}).get("spark.jobGroup.id")
            for s in e.get("Stage IDs", []):
                stage_group[s] = g
        elif e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            m = e["Task Metrics"]
            read = m.get("Shuffle Read Metrics", {})
            recs = read.get("Total Records Read", 0) or (read.get("Local Records Read", 0) + read.get("Remote Records Read", 0))
            g = stage_group.get(e["Stage ID"])
            info = e["Task Info"]
            tasks.setdefault(g, []).append((recs, info["Finish Time"] - info["Launch Time"]))
    print(f"| strategy ({rows:,} rows, key 0 = 1/3) | max shuffle records read by one task | "
          "total shuffle records | slowest task ms |")
    print("|---|---|---|---|")
    for name in cases:
        ts = tasks.get(name, [])
        print(f"| {name} | {max((r for r, _ in ts), default=0):,} | {sum(r for r, _ in ts):,} | "
              f"{max((d for _, d in ts), default=0):,} |")


if __name__ == "__main__":
    main()
