"""Line de-duplication over a sharded minimal perfect hash of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased; keys under ``MIN_LENGTH`` code
points never count. Map tasks hash every document's distinct keys to 128 bits, and Spark counts the documents
of each hash and finds its largest doc_id, aggregating in the map tasks first, so that a line that every
document holds is one row a task. The hashes that enough documents hold are dealt to shards by their leading bits. A
shard of about ``SHARD_KEYS`` hashes becomes one file: a minimal perfect hash (levels of bit arrays, about three
bits a key) that maps each of its n hashes to its own slot 0..n-1, and arrays of 64-bit fingerprints, counts
and largest doc_ids in slot order. Lines are never joined: tasks that read the documents again look each
line's hash up in the arrays of its shard, which they load as needed and of which they keep the last few.

A slot is found with the first 64 bits of the hash and confirmed by the other 64, the fingerprint, so a
line that is not in the index is taken for one that is with probability 2^-64. Only hashes that
decide something (found in ``MIN_DOCS`` documents) are indexed: their number, not the number of distinct lines, sets the index size.

Defined cases: a null text counts as empty; an empty text is one empty line; each row is a document when
documents are counted, and rows that share the largest doc_id of a key all keep its lines; a null doc_id
ranks below all others (where only such rows hold a key, they all keep it); a key that repeats inside a
document counts once and goes, or stays, with all its lines; extra columns are ignored; an empty table
gives an empty result. Texts of any length are taken whole, one at a time.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medwright.llm.common import mix, release, scratch_dir, shared_uri, slices, table, written

MIN_LENGTH = 40
MIN_DOCS = 5
#: Hashes a shard holds on average; its file has about 20 bytes for each.
SHARD_KEYS = 1 << 16
#: Shards that a probing task keeps in memory (about 1.4 MB each).
CACHED_SHARDS = 48
#: Bytes of text whose lines a task looks up together, shard by shard.
PROBE_BYTES = 8 << 20
#: Bits a level has for each key that reaches it, and levels before the rest is listed.
GAMMA, MAX_LEVELS = 2, 40

#: White space taken off both ends of a line (fixed values: \x20 and \x09-\x0D).
_BLANK = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id: below all others.
NO_ID = -(1 << 63)


def line_digest(line: bytes, min_length: int) -> bytes | None:
    """The 128-bit hash of a line's key, or None where the key is too short to count."""
    key = line.strip(_BLANK)
    if len(key) < min_length or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_length):
        return None
    return xxhash.xxh3_128_digest(key.lower())  # bytes.lower() changes A-Z only


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class PerfectHash:
    """Maps n distinct pairs of 64-bit hashes to 0..n-1.

    A level is a bit array addressed by the first hash. Keys that are alone at their place set its bit, the
    others go on to the next level; a key's slot is the number of set bits before its own. Keys still left
    after the last level (such as two with equal first hashes) are listed one by one.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest_hi: np.ndarray, rest_lo: np.ndarray):
        self.sizes, self.words, self.rest_hi, self.rest_lo = sizes, words, rest_hi, rest_lo
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.rest = {(int(h), int(x)): int(self.before[-1]) + i for i, (h, x) in enumerate(zip(rest_hi, rest_lo))}

    @staticmethod
    def _place(hi: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hi ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> "PerfectHash":
        left, sizes, words = np.arange(len(hi)), [], []
        while len(left) and len(sizes) < MAX_LEVELS:
            size = 64 * -(-GAMMA * len(left) // 64)
            place = cls._place(hi[left], len(sizes), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            flags = np.zeros(size, np.uint8)
            flags[place[alone]] = 1
            sizes.append(size)
            words.append(np.packbits(flags, bitorder="little").view("<u8"))
            left = left[~alone]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"), hi[left], lo[left])

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.rest)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """A slot for each pair; pairs that were not given to ``build`` get any slot or -1."""
        out = np.full(len(hi), -1, np.int64)
        todo = np.arange(len(hi))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            bit = self.starts[level] + self._place(hi[todo], level, size)
            word, offset = bit >> 6, (bit & 63).astype(np.uint64)
            found = (self.words[word] >> offset & np.uint64(1)).astype(bool)
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << offset) - np.uint64(1)))
            out[todo[found]] = (self.before[word] + below)[found]
            todo = todo[~found]
        if self.rest:
            out[todo] = [self.rest.get((int(h), int(x)), -1) for h, x in zip(hi[todo], lo[todo])]
        return out


class Shard:
    """A perfect hash with the fingerprint, count and largest doc_id of each slot."""

    def __init__(self, hashes: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.hashes, self.fingerprints, self.counts, self.keepers = hashes, fingerprints, counts, keepers

    @classmethod
    def build(cls, hi, lo, counts, keepers) -> "Shard":
        hashes = PerfectHash.build(hi, lo)
        slot = hashes.slots(hi, lo)
        placed = [np.empty(len(hi), kind) for kind in ("<u8", "<u4", "<i8")]
        for array, values in zip(placed, (lo, np.minimum(counts, 0xFFFFFFFF), keepers)):
            array[slot] = values
        return cls(hashes, *placed)

    def dump(self) -> bytes:
        out = io.BytesIO()
        h = self.hashes
        np.savez(out, sizes=h.sizes, words=h.words, rest_hi=h.rest_hi, rest_lo=h.rest_lo,
                 fingerprints=self.fingerprints, counts=self.counts, keepers=self.keepers)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Shard":
        a = np.load(io.BytesIO(data))
        return cls(PerfectHash(a["sizes"], a["words"], a["rest_hi"], a["rest_lo"]), a["fingerprints"], a["counts"], a["keepers"])

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and largest doc_id of each hash; 0 documents where the index does not hold it."""
        if not len(self.counts):
            return np.zeros(len(hi), np.int64), np.full(len(hi), NO_ID)
        slot = self.hashes.slots(hi, lo)
        held = (slot >= 0) & (self.fingerprints[slot] == lo)
        return np.where(held, self.counts[slot], 0), np.where(held, self.keepers[slot], NO_ID)


class LineIndex:
    """The shards in a shared folder, for the tasks that look lines up. Only the folder's name and two numbers travel."""

    def __init__(self, uri: str, bits: int, min_length: int):
        self.uri, self.bits, self.min_length = uri, bits, min_length

    def shard_of(self, hi: np.ndarray) -> np.ndarray:
        return (hi >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hi), np.int64)

    def reader(self):
        """A function that loads a shard, or returns one of the last ``CACHED_SHARDS`` it loaded."""
        store, path = pafs.FileSystem.from_uri(self.uri)
        held: OrderedDict[int, Shard] = OrderedDict()

        def shard(s: int) -> Shard:
            if s in held:
                held.move_to_end(s)
            else:
                if len(held) >= CACHED_SHARDS:
                    held.popitem(last=False)
                with store.open_input_stream(f"{path}/shard-{s}.npz") as f:
                    held[s] = Shard.load(f.read())
            return held[s]
        return shard

    def probe(self, shard, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Documents and largest doc_id of each digest, looked up shard by shard."""
        hi, lo = _halves(digests)
        counts, keepers = np.zeros(len(hi), np.int64), np.full(len(hi), NO_ID)
        shards = self.shard_of(hi)
        order = np.argsort(shards, kind="stable")
        names, starts = np.unique(shards[order], return_index=True)
        for s, at in zip(names.tolist(), np.split(order, starts[1:])):
            counts[at], keepers[at] = shard(s).probe(hi[at], lo[at])
        return counts, keepers


_PAIR = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc", pa.int64())])


def _texts(batch: pa.RecordBatch, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """(doc, text) of the batch's rows in runs of about ``limit`` bytes."""
    for rows, data, offsets in slices(batch, limit=limit):
        yield [(i, data[a:b].tobytes()) for i, a, b in zip(rows.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())]


def _line_hashes(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _texts(batch, PROBE_BYTES):
                digests, ids = [], []
                for doc, text in texts:
                    own = {d for line in text.split(b"\n") if (d := line_digest(line, min_length))}
                    digests += own
                    ids += [doc] * len(own)
                if digests:
                    hi, lo = _halves(digests)
                    yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(ids, pa.int64())], schema=_PAIR)
    return run


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")


def line_counts(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """hi, lo, docs and keeper: the documents of each distinct line hash and the largest doc_id among them."""
    return (_source(docs).mapInArrow(_line_hashes(min_length), "hi long, lo long, doc long")
            .groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper")))


def _write_shard(uri: str):
    def write(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.filter(pa.compute.greater(rows["docs"], 0)).sort_by([("hi", "ascending"), ("lo", "ascending")])
        hi, lo = (rows[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("hi", "lo"))
        data = Shard.build(hi, lo, rows["docs"].to_numpy(), rows["keeper"].to_numpy()).dump()
        store, path = pafs.FileSystem.from_uri(uri)
        store.create_dir(path)
        s = key[0].as_py()
        with store.open_output_stream(part := f"{path}/{uuid.uuid4().hex}.part") as out:
            out.write(data)
        store.move(part, f"{path}/shard-{s}.npz")  # a repeated attempt puts equal bytes in its place
        return pa.table({"shard": pa.array([s], pa.int64()), "keys": pa.array([rows.num_rows], pa.int64())})
    return write


def build_index(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """Count the lines of ``docs`` and write the shards of those that ``min_docs`` documents hold."""
    spark = docs.sparkSession
    held = written(line_counts(docs, min_length).filter(F.col("docs") >= min_docs), "line-counts")
    bits = max(0, (held.count() // shard_keys).bit_length())
    shard = F.shiftrightunsigned("hi", 64 - bits) if bits else F.lit(0).cast("long")
    every = spark.range(1 << bits).select(F.col("id").alias("shard"), *[F.lit(0).cast("long").alias(c) for c in ("hi", "lo", "docs", "keeper")])
    rows = held.withColumn("shard", shard).unionByName(every)  # so that a shard without hashes has its file too
    index = LineIndex(shared_uri(scratch_dir(spark, "line-index")), bits, min_length)
    made = written(rows.groupBy("shard").applyInArrow(_write_shard(index.uri), "shard long, keys long"), "line-shards")
    release(spark, held, made)
    return index


def _probe(index: LineIndex, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = index.reader()
        for batch in batches:
            for texts in _texts(batch, PROBE_BYTES):
                lines = [text.split(b"\n") for _, text in texts]
                found = [(row, k, d) for row, own in enumerate(lines) for k, line in enumerate(own) if (d := line_digest(line, index.min_length))]
                gone: dict[int, set[int]] = {}
                if found:
                    counts, keepers = index.probe(shard, [d for _, _, d in found])
                    docs = np.array([texts[row][0] for row, _, _ in found], np.int64)
                    for i in np.flatnonzero((counts >= min_docs) & (keepers != docs)).tolist():
                        gone.setdefault(found[i][0], set()).add(found[i][1])
                kept = [b"\n".join([x for k, x in enumerate(own) if k not in gone[row]] if row in gone else own) for row, own in enumerate(lines)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc if doc != NO_ID else None for doc, _ in texts], pa.int64()), pa.array([len(own) for own in lines], pa.int64()),
                    pa.array([len(gone.get(row, ())) for row in range(len(lines))], pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.binary())],
                    names=["doc_id", "n_lines", "n_dropped", "kept"])
    return run


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and kept_text, a row per row of ``docs``."""
    index = build_index(docs, min_docs, min_length, shard_keys)
    probed = _source(docs).mapInArrow(_probe(index, min_docs), "doc_id long, n_lines long, n_dropped long, kept binary")
    return probed.select("doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept_text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
f AS (SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.r, k.doc_id, k.pos, k.line, f.key IS NOT NULL AND f.keeper <> coalesce(k.doc_id, -9223372036854775808) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
