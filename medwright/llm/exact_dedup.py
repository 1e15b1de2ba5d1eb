"""Exact de-duplication through an extendible-hash index on shared files.

Texts are equal when identical after each run of white space has become one space. Map tasks reduce
their rows to one row per text; the rows are dealt to owner tasks by ranges of the 64-bit key, so each
owner holds a contiguous part of the key space. An owner reads its rows in key order, compares the
bytes of texts whose keys collide (different texts under one key form a chain), and enters every text in
an extendible-hash index: a directory addressed by the low key bits, doubled when a full bucket
already uses all of them, whose buckets split when they overflow. Each owner's directory and buckets are
one file in the shared folder. The kept ids and group sizes are read back from those files.

Defined cases: a null text counts as empty; all empty texts are one group; extra columns are ignored; a
``doc_id`` that repeats is one document (its rows stay or go together); a null ``doc_id`` is never the
kept id of a group that has another id, and a group of null ids only keeps them; an empty table gives an
empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medwright.llm.common import scratch_dir, shared_uri, table, unburden, written

#: Entries of a bucket before it splits.
BUCKET_ENTRIES = 128
#: The directory stops doubling here; a bucket of texts with equal leading bits then grows a chain.
MAX_DEPTH = 24

_ENTRY = np.dtype([("key", "<u8"), ("sha", "S64"), ("keep_id", "<i8"), ("has_id", "?"), ("size", "<i8")])


class ExtendibleHash:
    """Directory and buckets of one owner; the address is the key's low bits."""

    def __init__(self, capacity: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH):
        self.capacity, self.max_depth = capacity, max_depth
        self.depth = 0
        self.directory = [0]
        self.buckets: list[list[tuple]] = [[]]
        self.local_depth = [0]

    def find(self, key: int) -> list[tuple]:
        """The chain of entries under one key."""
        return [e for e in self.buckets[self.directory[key & ((1 << self.depth) - 1)]] if e[0] == key]

    def add(self, entry: tuple) -> None:
        key = entry[0]
        while True:
            b = self.directory[key & ((1 << self.depth) - 1)]
            if len(self.buckets[b]) < self.capacity or self.local_depth[b] >= self.max_depth:
                self.buckets[b].append(entry)
                return
            if self.local_depth[b] == self.depth:  # every bit is in use: the directory doubles
                self.directory += self.directory
                self.depth += 1
            self._split(b, key)

    def _split(self, b: int, key: int) -> None:
        bit = 1 << self.local_depth[b]
        new = len(self.buckets)
        self.buckets.append([e for e in self.buckets[b] if e[0] & bit])
        self.buckets[b] = [e for e in self.buckets[b] if not e[0] & bit]
        self.local_depth[b] += 1
        self.local_depth.append(self.local_depth[b])
        for i in range((key & (bit - 1)) | bit, len(self.directory), 2 * bit):
            self.directory[i] = new

    def dump(self) -> bytes:
        """Header, directory, bucket ends, then the buckets' entries."""
        flat = np.array([e for bucket in self.buckets for e in bucket], _ENTRY)
        ends = np.cumsum([len(b) for b in self.buckets]).astype("<u4")
        return (struct.pack("<4sII", b"XHI1", self.depth, len(self.buckets))
                + np.array(self.directory, "<u4").tobytes() + ends.tobytes() + flat.tobytes())


def load_index(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, directory, bucket ends and entries of one owner's file."""
    magic, depth, n = struct.unpack_from("<4sII", data)
    if magic != b"XHI1":
        raise ValueError("not an extendible-hash index file")
    directory = np.frombuffer(data, "<u4", 1 << depth, 12)
    ends = np.frombuffer(data, "<u4", n, 12 + 4 * len(directory))
    return depth, directory, ends, np.frombuffer(data, _ENTRY, int(ends[-1]), 12 + 4 * (len(directory) + n))


def lookup(index: tuple, key: int, sha: str) -> tuple | None:
    """(keep_id or None, size) of one text, or None."""
    depth, directory, ends, entries = index
    b = int(directory[key & ((1 << depth) - 1)])
    for e in entries[int(ends[b - 1]) if b else 0:int(ends[b])]:
        if int(e["key"]) == key and e["sha"] == sha.encode():
            return (int(e["keep_id"]) if e["has_id"] else None), int(e["size"])
    return None


_COMBINED = "key long, text_sha256 string, text string, doc_id long, n long"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct text of this task, without holding texts.

    A text goes out when it is first met; further copies are counted and go out at the end without it.
    """
    unburden()
    seen: dict[str, list] = {}
    types = pa.schema([("key", pa.int64()), ("text_sha256", pa.string()), ("text", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def rest() -> pa.RecordBatch:
        rows = [(k, s, None, i, n) for s, (k, i, n) in seen.items() if n]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], schema=types)

    for batch in batches:
        fresh = []
        ids, keys, shas = (batch.column(i).to_pylist() for i in (0, 1, 2))
        for row, (i, k, s) in enumerate(zip(ids, keys, shas)):
            if (e := seen.get(s)) is None:
                seen[s] = [k, None, 0]
                fresh.append(row)
            else:
                e[1] = i if e[1] is None else e[1] if i is None else min(e[1], i)
                e[2] += 1
        if fresh:
            t = batch.take(pa.array(fresh))
            yield pa.RecordBatch.from_arrays([t.column(1), t.column(2), t.column(3).cast(pa.string()), t.column(0), pa.array([1] * len(fresh), pa.int64())], schema=types)
        if len(seen) >= 200_000:  # memory stays bounded; a text met again later goes out again
            yield rest()
            seen = {}
    yield rest()


def _owner(folder: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden()
        index = ExtendibleHash()
        key, chain = None, {}  # the chain under the current key: sha -> [text bytes, least id, rows]

        def close() -> None:
            for sha, (_, least, n) in chain.items():
                index.add((key, sha.encode(), least or 0, least is not None, n))

        for batch in batches:
            keys, shas, texts, ids, ns = (batch.column(i) for i in range(5))
            for row, (k, s, i, n) in enumerate(zip(keys.to_pylist(), shas.to_pylist(), ids.to_pylist(), ns.to_pylist())):
                k &= 0xFFFFFFFFFFFFFFFF
                if k != key:
                    close()
                    key, chain = k, {}
                text = texts[row].as_buffer() if texts[row].is_valid else None
                e = chain.get(s)
                if e is None:
                    chain[s] = [text, i, n]
                    continue
                if text is not None and e[0] is not None and not text.equals(e[0]):
                    raise ValueError(f"different texts share the SHA-256 {s}")
                e[0] = e[0] if e[0] is not None else text
                e[1] = i if e[1] is None else e[1] if i is None else min(e[1], i)
                e[2] += n
        close()
        if key is None:
            return
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path)
        name = f"{path}/{uuid.uuid4().hex}.xhi"
        with store.open_output_stream(name) as out:
            out.write(index.dump())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(map(len, index.buckets))], pa.int64()), pa.array([index.depth], pa.int32())],
                                         names=["path", "entries", "depth"])
    return build


def _read_entries(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path) as f:
                    entries = load_index(f.read())[3]
                for k in range(0, len(entries), 50_000):
                    e = entries[k:k + 50_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s.decode() for s in e["sha"].tolist()], pa.string()),
                        pa.array(e["keep_id"], pa.int64(), mask=~e["has_id"]),
                        pa.array(e["size"], pa.int64())], names=["text_sha256", "keep_id", "group_size"])
    return read


def build_index(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """Write the index of ``normalised`` documents; one row per file: path, entries, depth.

    The leading key bits make 16 ranges and more for each owner, so hashing the range number deals
    the key space evenly; the low bits stay free for the directory.
    """
    spark = docs.sparkSession
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = owners.bit_length() + 4
    folder = shared_uri(scratch_dir(spark, "xhash"))
    rows = docs.select("doc_id", "key", "text_sha256", "norm").mapInArrow(_combine, _COMBINED)
    dealt = (rows.withColumn("key_range", F.shiftrightunsigned("key", 64 - bits))
             .repartition(owners, "key_range").sortWithinPartitions("key").drop("key_range"))
    # A row for each owner: one file holds many of them.
    manifest = written(dealt.mapInArrow(_owner(folder), "path string, entries long, depth int").repartition(-(-owners // 1000)), "xhash-manifest")
    manifest.index_uri = folder
    return manifest


def normalised_text() -> Column:
    """A run of white space becomes one space; single spaces already are, so the pattern leaves them out."""
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x09-\x0D\x20]{2,}|[\x09-\x0D]", " ")


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, normalised text, its SHA-256 and 64-bit key."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised_text().alias("norm"))
            .withColumn("key", F.xxhash64("norm")).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)))


def exact_dedup(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row per row of ``docs``.

    The rows of a group meet its entry in a sort-merge join of slim rows, whose large partitions
    adaptive execution splits: an entry stands once, the rows of a hot group may stand anywhere. The
    hint keeps the entries, which grow with the input, from being broadcast (Spark only knows the size
    of the list of files they are read from).
    """
    source = normalised(docs)
    manifest = build_index(source, owners)
    files = manifest.select("path").repartition(max(1, min(manifest.count(), 1024)))
    entries = files.mapInArrow(_read_entries(manifest.index_uri), "text_sha256 string, keep_id long, group_size long")
    return (source.select("doc_id", "text_sha256").join(entries.hint("merge"), "text_sha256")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
