"""Writers: flat vendor extracts, atomic snapshot publishing, audit logs.

Nothing here overwrites data in place. A failed in-place ``overwrite``
leaves an empty or partial directory, so every publish writes a *new*
snapshot directory and only then moves a small pointer file to it (U3);
readers resolve the pointer. The previous snapshot stays intact on error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_extract(df: DataFrame, path: str, header: bool = True, single_file: bool = False) -> str:
    """Daily flat-file extract for a vendor (IO14): CSV with a header row.

    ``single_file`` coalesces to one output file; use it only for extracts
    whose size is bounded by the report (e.g. one day of orders).
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("errorifexists").option("header", header).csv(path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    reader = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(stream))
    lines, line = [], reader.readLine()
    while line is not None:
        lines.append(line)
        line = reader.readLine()
    reader.close()
    return "\n".join(lines)


def _replace(spark: SparkSession, src: str, dst: str) -> None:
    """Move ``src`` over ``dst`` in one step (``Rename.OVERWRITE``): readers see
    the old pointer or the new one, never none."""
    jvm = spark.sparkContext._jvm
    fs_pkg = jvm.org.apache.hadoop.fs
    target = fs_pkg.Path(dst)
    ctx = fs_pkg.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(fs_pkg.Options.Rename, 1)
    options[0] = fs_pkg.Options.Rename.OVERWRITE
    ctx.rename(fs_pkg.Path(src), target, options)


def pointer(spark: SparkSession, table_root: str) -> dict | None:
    """What the pointer of a table says of its published snapshot, or None if never published."""
    text = _read_text(spark, f"{table_root.rstrip('/')}/_CURRENT")
    return json.loads(text) if text else None


def current_snapshot(spark: SparkSession, table_root: str) -> str | None:
    """Path of the published snapshot of a table, or None if never published."""
    live = pointer(spark, table_root)
    return live["path"] if live else None


def read_table(spark: SparkSession, table_root: str) -> DataFrame | None:
    path = current_snapshot(spark, table_root)
    return spark.read.parquet(path) if path else None


def write_snapshot(df: DataFrame, table_root: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new immutable snapshot that no reader sees yet; its path."""
    path = f"{table_root.rstrip('/')}/snap-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def switch_pointer(spark: SparkSession, table_root: str, snapshot: str | dict) -> None:
    """Make a written snapshot, given by its path or by its entry, the live one.

    The pointer is written to a temporary name and renamed over the old one
    in a single overwrite-rename, so readers see either the old or the new
    snapshot, never a partial one and never a missing pointer.
    """
    root = table_root.rstrip("/")
    tmp = f"{root}/_CURRENT.{uuid.uuid4().hex}.tmp"
    _write_text(spark, tmp, json.dumps({"path": snapshot} if isinstance(snapshot, str) else snapshot))
    _replace(spark, tmp, f"{root}/_CURRENT")


def publish_snapshot(df: DataFrame, table_root: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new immutable snapshot, then switch the pointer (U3, IO4)."""
    path = write_snapshot(df, table_root, partition_by)
    switch_pointer(df.sparkSession, table_root, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a directory this package wrote, if it is there."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a directory deleted when the session's file system closes, if it is still there then."""
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)


def prune_snapshots(spark: SparkSession, table_root: str, keep: int) -> list[str]:
    """Remove all but the live snapshot and the ``keep`` - 1 latest others; the removed paths.

    Readers that still hold an older snapshot open need ``keep`` to cover them.
    """
    live = current_snapshot(spark, table_root)
    fs, root = _fs(spark, table_root)
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(root) if s.getPath().getName().startswith("snap-")]
    name = live.rsplit("/", 1)[-1] if live else None
    older = [path for _, path in sorted(found, reverse=True) if path.rsplit("/", 1)[-1] != name]
    gone = older[max(keep - 1, 0):]
    for path in gone:
        remove(spark, path)
    return gone


def append_rows(df: DataFrame, path: str) -> None:
    """Append-only log table (IO9): each call adds files, never rewrites."""
    df.write.mode("append").parquet(path)
