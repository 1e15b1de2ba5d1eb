"""Snapshots of a keyed table in hash buckets (IO7, IO8).

A target that is upserted every day is far larger than the day's slice. Stored
in buckets of its key, it meets the slice bucket by bucket: Spark shuffles the
slice into as many partitions as the target has buckets and reads each bucket
where it lies, so the target is never shuffled. The result of the upsert comes
out in those same partitions, so writing the next snapshot moves no rows either.

The pointer of a bucketed table (see ``sinks``) names, besides the snapshot's
directory, its key, bucket count and schema: any session can attach the
directory with its buckets, no metastore has to remember it. A snapshot is
attached under a throw-away table name that is dropped again at once; the
DataFrame keeps the bucket layout and the files stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import sinks


def write_bucketed(df: DataFrame, table_root: str, key: str, buckets: int) -> dict:
    """Write ``df`` as a new snapshot in ``buckets`` hash buckets of ``key``, rows of a bucket
    sorted by it; the entry for :func:`publish`. No reader sees the snapshot yet.

    Bucket files hold what their task had of a bucket: rows that already lie in
    ``buckets`` partitions of the key (an upsert into this layout) give a file a bucket.
    """
    spark = df.sparkSession
    path = f"{table_root.rstrip('/')}/snap-{uuid.uuid4().hex}"
    name = f"bucketed_{uuid.uuid4().hex}"
    try:
        df.write.mode("errorifexists").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the table is external: its files stay
    return {"path": path, "key": key, "buckets": buckets, "schema": df.schema.jsonValue()}


def publish(spark: SparkSession, table_root: str, entry: dict) -> None:
    """Make a written snapshot the live one."""
    sinks.switch_pointer(spark, table_root, entry)


def attach(spark: SparkSession, entry: dict) -> DataFrame:
    """The snapshot as a DataFrame whose scan Spark knows to be bucketed and sorted."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(entry["schema"]))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{entry['key']}`) SORTED BY (`{entry['key']}`) "
              f"INTO {entry['buckets']} BUCKETS LOCATION '{entry['path']}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def read_bucketed(spark: SparkSession, table_root: str) -> DataFrame | None:
    """The live snapshot, or None if nothing was published."""
    entry = sinks.pointer(spark, table_root)
    return attach(spark, entry) if entry else None
