"""Session construction and shared-storage helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every pipeline relies on: deterministic wall-clock handling and
# runtime re-planning (AQE coalesces small shuffles, splits skewed partitions
# and turns joins into broadcasts only when the measured side is small).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Size post-shuffle partitions by bytes (advisory size), not by keeping as
    # many tasks as the default parallelism: fewer tiny tasks on small
    # reports, right-sized partitions on large ones.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "medwright",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh directory on the storage the cluster shares for checkpoints.

    Uses ``spark.checkpoint.dir`` (or the checkpoint directory already set on
    the context). Where neither is set, a ``local`` master gets a temporary
    folder of its own, because driver and executors are one process; on any
    other master a folder of this machine would be invisible to the executors,
    so the call raises instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"set spark.checkpoint.dir to a directory that driver and executors of {master} share")
        base = tempfile.mkdtemp(prefix="medwright-checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return "/".join([base.rstrip("/"), *parts, uuid.uuid4().hex])


def holds(report: DataFrame, *tables) -> DataFrame:
    """``report`` with a handle on the temp tables it reads."""
    report.temp_tables = list(tables)
    return report


def release(report: DataFrame) -> None:
    """Drop the temp tables of ``report``, and nothing else; it can't be read afterwards."""
    for table in getattr(report, "temp_tables", []):
        table.drop()
    report.temp_tables = []
