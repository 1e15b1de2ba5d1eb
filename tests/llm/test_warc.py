import gzip
import hashlib
import io
import zlib

import pytest

from medwright.llm import warc as W
from medwright.llm.common import scratch_dir


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "d") for i, u, h in rows], "page_id long, url string, html string, path string, digest string")


LONG = "<p>" + "x" * 200 + "</p>"
ROWS = [(5, "http://a/1", LONG), (3, "http://a/2 b\r\nEvil: 1", LONG), (9, None, LONG), (9, None, LONG), (None, "http://n", LONG), (1, "http://s", "short"),
        (2, "http://s", "short"), (4, "http://e", ""), (6, "http://e", None), (7, "http://u", "é日\r\n\r\nWARC/1.1\r\n" + "y" * 120), (8, "http://b", "z" * 300_000)]


def brute(rows):
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = h in first and i is not None and i > first[h]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    return sorted(out, key=str)


def run(spark, rows):
    raw, folder = scratch_dir(spark, "warc-test"), scratch_dir(spark, "warc-test")
    archives = W.write_archives(pages(spark, rows), raw)
    manifest = W.normalise(archives, folder)
    return archives.collect(), manifest.collect(), W.read_records(manifest, folder).collect()


def test_archives_equal_brute_force(spark):
    archives, manifest, got = run(spark, ROWS)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
    assert {r.page_id: r.url for r in got}[3] == "http://a/2%20b%0D%0AEvil:%201" and {r.page_id: r.url for r in got}[9] == "urn:page:9"
    for a in archives:  # one member from end to end
        state = zlib.decompressobj(31)
        state.decompress(open(a.path, "rb").read())
        assert state.eof and not state.unused_data
    for m in manifest:  # a member per record, where the index says
        data, at = open(m.path, "rb").read(), 0
        for line in open(m.index_path).read().splitlines():
            begin, size, kind, *_ = line.split("\t")
            assert int(begin) == at and gzip.decompress(data[at:at + int(size)]).startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode())
            at += int(size)
        assert at == len(data)


def test_empty_table(spark):
    assert run(spark, []) == ([], [], [])


def test_streams_are_inflated_whatever_their_members_and_cuts():
    records = [W.record("response", i, f"http://x/{i}", b"p" * (i * 1000), "0" * 64, None, "2020-01-01T00:00:00Z") for i in range(40)]
    whole = b"".join(records)
    several = b"".join(gzip.compress(r) for r in records)
    for data in (gzip.compress(whole), several):
        assert [d for _, d in W.split_records(W.inflate(io.BytesIO(data)))] == records
    for data in (gzip.compress(whole)[:-20], gzip.compress(whole[:-30])):
        with pytest.raises(ValueError):
            list(W.split_records(W.inflate(io.BytesIO(data))))
    with pytest.raises(ValueError):
        list(W.split_records(iter([b"HTTP/1.1 200 OK\r\n\r\n"])))


def test_single_bytes_at_a_time():
    data = W.record("response", 1, None, b"ab", "0" * 64, None, "d") * 2
    assert len(list(W.split_records(iter([bytes([b]) for b in data])))) == 2
