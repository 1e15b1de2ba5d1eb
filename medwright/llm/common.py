"""Helpers shared by the operators: tables, written intermediates, Arrow text batches, hashed words."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medwright.session import shared_dir

#: Texts are handed to numpy in slices of about this many UTF-8 bytes.
SLICE_BYTES = 1 << 20
#: Rows to a file of an intermediate whose rows are known, unless that leaves cores idle.
FILE_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; executors that are lost cannot take it with them."""
    return shared_dir(spark, f"llm-{label}")


def shared_uri(path: str) -> str:
    """The folder as a URI that pyarrow's file systems open on any executor."""
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:")


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows at most, in no more partitions than those need, however many its last shuffle has.

    Each file that is written costs an executor some processes (on a local disk Hadoop runs chmod, and the process that
    is to become chmod counts as large as the executor for a moment), and its reader a task.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and fixes the rows.

    The folder belongs to the caller's checkpoint directory; ``release`` deletes it. ``rows``: how many ``df`` has at most,
    about, for as few files.
    """
    path = scratch_dir(df.sparkSession, label)
    if rows is not None:
        df = in_few(df, rows)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(spark: SparkSession, *paths: str | DataFrame | None) -> None:
    """Delete folders made by ``written`` or ``scratch_dir`` that no later read needs."""
    for path in paths:
        path = getattr(path, "scratch_path", None) if isinstance(path, DataFrame) else path
        if path:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text falls on ``remainder``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def crc_held_out(value, modulus: int, remainder: int) -> bool:
    """``held_out`` for one id on the Python side."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus == remainder


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """_id and label of each id that is not held out; of labels that repeat the larger holds."""
    return (labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))
            .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label)).cast("int").alias("label")))


def training_sample(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """doc_id, label and text of the ``n`` rows of ``known`` (_id, label) with the least hash of the id.

    Ids without a document don't count.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    picked = known.join(ids, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(n)
    return texts_of(docs, picked)


def texts_of(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """doc_id, label and text of the rows a bounded sample names; the list of a few thousand ids is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id").cast("long") == F.col("_id")).select(F.col("_id").alias("doc_id"), "label", "text")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets of its rows; nulls have length 0."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes of text (one row at least), with their bytes and offsets."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


#: Functions that empty what an operator keeps in a worker process from task to task.
KEPT: list[Callable[[], None]] = []


def unburden() -> None:
    """Begin a task that uses nothing which earlier tasks of the worker have kept: drop that, and give free memory back to the system.

    Spark hands a worker from stage to stage; without this it would hold the largest memory of any of them.
    """
    for drop in KEPT:
        drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, one per byte of a slice."""
    inverse = pow(_BASE, -1, 1 << 64)
    n = SLICE_BYTES + 1
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes wherever they stand.

    Long inputs are taken in pieces that break before a span's start; a span longer than a
    piece is hashed on its own, so that working memory follows the piece.
    """
    out = np.zeros(len(starts), np.uint64)
    up, down = _powers()
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo <= SLICE_BYTES:
            prefix = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:hi - lo], out=prefix[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (prefix[e] - prefix[s]) * down[s]
        else:
            h = 0
            for k in range(lo, hi, SLICE_BYTES):
                piece = data[k:min(k + SLICE_BYTES, hi)]
                h = (h * int(up[len(piece)]) + int(((piece.astype(np.uint64) + np.uint64(1)) * up[:len(piece)]).sum())) % (1 << 64)
            out[i] = h
        i = j
    return mix(out + mix((ends - starts).astype(np.uint64)))


#: Bytes \x20 and \x09-\x0D divide words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z become a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Letters, digits and all bytes of non-ASCII characters, after lower-casing.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower-case the Basic Latin and Latin-1 letters of UTF-8 bytes."""
    out = LOWER[data]
    if len(out) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word in a slice. No word crosses a row.

    ``inside`` says of each byte value whether it belongs to words; by default all but white space.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    in_word = (~_SPACE if inside is None else inside)[data]
    starts, ends = spans(in_word)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[in_word[cuts] & in_word[cuts - 1]]  # words that two rows would share
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def with_columns(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The batch with further columns behind its own."""
    names = batch.schema.names + list(columns)
    return pa.RecordBatch.from_arrays(list(batch.columns) + [pa.array(c) if not isinstance(c, pa.Array) else c for c in columns.values()], names=names)
