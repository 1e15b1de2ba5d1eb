"""WARC archives of pages, normalised to one gzip member per record with a sidecar offset index.

``write_archives`` writes a record per page into archives that are one gzip stream from end to end, as
careless crawlers leave them: nothing in such a file can be reached without inflating all before it.
``normalise`` inflates each archive once, as a stream, writes every record again as a gzip member of
its own, and a sidecar index with each record's offset, length, type and ids. ``read_records`` then reads
records by seeking to the offsets of the index.

Of pages whose payloads are equal and of at least ``LEAST_PAYLOAD`` bytes, that with the smallest page_id
is the response; the others are revisit records without the payload. The digests that decide this are
aggregated before they are joined, and the rows that meet them hold ids only.

Defined cases: a null html is the empty payload, a null url becomes ``urn:page:<id>``; control characters and spaces in
a url are percent-encoded; a null page_id is always a response and reads back as null; rows that repeat
a page_id with its payload are responses alike; an empty table writes nothing and gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medwright.llm.common import release, scratch_dir, shared_uri, table, written

LEAST_PAYLOAD = 100
#: Bytes of records after which a task begins the next archive.
ARCHIVE_BYTES = 64 << 20
_BLOCK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit's block ends with its HTTP header; its digest and length are those of the whole payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'' if page_id is None else page_id}"
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and whole bytes of every record of a stream, holding one record at a time."""
    held, done = bytearray(), False

    def more() -> bool:
        nonlocal done
        chunk = next(chunks, None)
        done = chunk is None
        held.extend(chunk or b"")
        return not done

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        head = parse_header(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(held[:size])
        del held[:size]


def inflate(source) -> Iterator[bytes]:
    """The inflated bytes of a gzip file, member after member, block by block."""
    state, begun = zlib.decompressobj(31), False
    while block := source.read(_BLOCK):
        while block:
            begun = True
            out = state.decompress(block, _BLOCK)
            if out:
                yield out
            block = state.unconsumed_tail
            if state.eof:
                block, state, begun = state.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the gzip stream is cut off")


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of ``pages`` (page_id, url, html), each one gzip stream; the manifest: path, records."""
    uri = shared_uri(folder)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    slim = own.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("size"))
    first = slim.filter(F.col("size") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    revisits = (slim.join(first.select("digest", "refers_to").hint("merge"), "digest").filter(F.col("page_id") > F.col("refers_to"))
                .groupBy("page_id", "digest").agg(F.first("refers_to").alias("refers_to")))
    own = own.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).join(revisits.hint("merge"), ["page_id", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(uri)
        store.create_dir(path)
        made, out, zip_, size = [], None, None, 0
        for batch in batches:
            for page_id, digest, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    made.append([f"{path}/{uuid.uuid4().hex}.warc.gz", 0])
                    out, zip_, size = store.open_output_stream(made[-1][0], compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                data = record("response" if refers_to is None else "revisit", page_id, url, html.encode(), digest, refers_to, date)
                out.write(zip_.compress(data))
                made[-1][1] += 1
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.write(zip_.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(zip_.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "records"])

    return written(own.select("page_id", "digest", "url", "html", "refers_to").mapInArrow(write, "path string, records long"), "warc-written")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``archives`` (path) below ``folder``, a member per record; the manifest: path, index_path, records."""
    uri = shared_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(uri)
        store.create_dir(top)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name, at, n = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(name, compression=None) as out, \
                        store.open_output_stream(name + ".idx", compression=None) as index:
                    for head, data in split_records(inflate(source)):
                        zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = zip_.compress(data) + zip_.flush()
                        out.write(member)
                        index.write(f"{at}\t{len(member)}\t{head['warc-type']}\t{head.get('page-id', '')}\t{head['warc-record-id']}\n".encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([name + ".idx"]), pa.array([n], pa.int64())], names=["path", "index_path", "records"])

    dealt = archives.select("path").repartition(max(1, min(archives.count(), 4096)))
    return written(dealt.mapInArrow(run, "path string, index_path string, records long"), "warc-normal")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url: each record by its place in the index."""
    uri = shared_uri(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, index_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as source, store.open_input_stream(index_path, compression=None) as index:
                    rows = []
                    for line in index.read().decode().splitlines():
                        at, size, *_ = line.split("\t")
                        source.seek(int(at))
                        rows.append(_row(zlib.decompress(source.read(int(size)), 31)))
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    dealt = manifest.select("path", "index_path").repartition(max(1, min(manifest.count(), 4096)))
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def _row(data: bytes) -> tuple:
    end = data.index(b"\r\n\r\n")
    head = parse_header(data[:end])
    block = data[end + 4:end + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    number = lambda key: int(head[key]) if key in head else None
    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{head['warc-record-id']}: the payload isn't that of its digest")
    return number("page-id"), size, digest, head["warc-type"], number("refers-to-page-id"), head["warc-target-uri"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) if rows else [[]] * 6, kinds)], names=names)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, folder = scratch_dir(spark, "warc-raw"), scratch_dir(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), raw)
    manifest = normalise(archives, folder)
    release(spark, raw, archives)
    return read_records(manifest, folder).drop("url")


OP9_SQL = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN p.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
