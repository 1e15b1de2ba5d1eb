"""Token-id output: whole texts as ids in plane-shuffled files, in order of doc_id, and back.

Documents are dealt to tasks by ranges of doc_id and sorted within; each task writes one file to the
shared folder as it encodes (see ``planes`` for the format) and reports a line of the manifest. Reading
starts from the manifest: a running sum over its files gives each file's first position in the corpus,
and a task per file decodes chunk by chunk. A lost task writes a new file under a new name, and only
files of the manifest count.

Defined cases: a null or empty text holds the end id only; a null doc_id comes first and keeps its null;
rows that share a doc_id follow each other in order of their text; extra columns are ignored; an empty
table writes no file and gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medwright.llm.common import scratch_dir, shared_uri, slices, table, written
from medwright.llm.encoding import encoder
from medwright.llm.planes import CHUNK_IDS, Reader, Writer

END_ID = 2
#: Words of either half of a worker's memory: half as many again as beside other operators; 1,000,000 took an executor over 3000 MB.
REMEMBERED = 600_000


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, planes: int = 4, chunk_ids: int = CHUNK_IDS, files: int | None = None,
              remembered: int = REMEMBERED) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) below ``folder``; the manifest: path, first_id, rows, tokens."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = shared_uri(folder)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = writer = None
        for batch in batches:
            for part, _, _ in slices(batch):
                if writer is None:
                    store, path = pafs.FileSystem.from_uri(uri)
                    store.create_dir(path)
                    name = f"{path}/{uuid.uuid4().hex}.bps"
                    out = store.open_output_stream(name)
                    writer = Writer(out, planes, chunk_ids)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(vocabulary, remembered).encode(part.column(1).to_pylist())):
                    writer.add(doc_id, ids + end)
        if writer is None:
            return
        writer.close()
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.docs[0][0] if writer.docs[0][1] else None], pa.int64()),
                                          pa.array([len(writer.docs)], pa.int64()), pa.array([writer.total], pa.int64())], names=["path", "first_id", "rows", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(write, "path string, first_id long, rows long, tokens long"), "ids-manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian uint32) from the files."""
    return _read(manifest, folder, True)


def _read(manifest: DataFrame, folder: str, with_ids: bool) -> DataFrame:
    uri = shared_uri(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as source:
                    rows, size = [], 0
                    for doc_id, start, ids in Reader(source).documents():
                        rows.append((doc_id, base + start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                        size += len(ids)
                        if len(rows) >= 10_000 or (with_ids and size >= 1 << 24):
                            yield _batch(rows, with_ids)
                            rows, size = [], 0
                    yield _batch(rows, with_ids)

    # One line per file of the manifest: the running sum is over files, not over documents.
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    placed = placed.repartition(max(1, min(manifest.count(), 4096)))
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=names)


def op6_token_output(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = scratch_dir(spark, "token-ids")
    manifest = write_ids(table(spark, sf_dir, "documents"), folder, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return _read(manifest, folder, False)
