"""Line de-duplication against a plain loop, and the perfect hash on its own."""
from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from medwright.llm import line_dedup as L
from medwright.llm.common import table

from .helpers import SF, awkward, empty, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=5, min_length=40):
    """(doc_id, n_lines, n_dropped, kept) of each row, by the definition."""
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(LOWER)
    ids = [i if i is not None else L.NO_ID for i, _ in rows]
    held: dict[str, list[int]] = {}
    for i, (_, text) in zip(ids, rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_length:
                held.setdefault(k, []).append(i)
    out = []
    for i, (doc, text) in zip(ids, rows):
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != i)]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = sorted([(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows)], key=str)
    assert sum(d for _, _, d, _ in want) > 0
    assert result(L.op11_line_dedup(spark, SF)) == want


def test_many_shards_give_the_same_lines(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert L.build_index(docs, 2, 1, shard_keys=5).bits >= 4
    assert result(L.dedup_lines(docs, 2, 1, shard_keys=5)) == brute(rows, 2, 1)


LINE = "This line is long enough to count, and it stands in many documents"


def test_awkward_rows(spark):
    wide = "Ünïcödé " * 5  # 39 code points once stripped, 59 bytes
    texts = [(i, f"{LINE}\nown line number {i} which no other document in this table has\n") for i in range(1, 6)]
    texts += [(6, f"\x0b \t{LINE.upper()}\r\n{LINE}\n{LINE}\x0c"), (6, LINE), (None, LINE), (None, None), (7, None), (8, ""), (9, "\n\n"),
              (10, LINE + " "), (11, "x" * 2_500_000 + "\n" + LINE)]
    texts += [(20 + i, wide) for i in range(6)] + [(40 + i, wide + "Ñ") for i in range(6)] + [(60 + i, (wide + "ñ").lower()) for i in range(4)]
    got = result(L.dedup_lines(awkward(spark, texts)))
    assert got == brute(texts)
    by = {}
    for i, n, d, kept in got:
        by.setdefault(i, []).append((n, d, kept))
    assert by[1][0][1] == 1 and by[11][0][1] == 0      # the largest doc_id keeps the line
    assert sorted(x[1] for x in by[6]) == [1, 3]        # every line of a repeated key goes
    assert by[10][0][1] == 0                            # a no-break space belongs to the key
    assert by[20][0][1] == 0 and by[40][0][1] == 1      # 39 and 41 code points
    assert by[7] == by[8] == [(1, 0, "")]


def test_rows_that_share_an_id_or_have_none_keep_their_lines(spark):
    texts = [(3, LINE), (3, LINE), (1, LINE), (1, LINE), (2, LINE)]
    assert result(L.dedup_lines(awkward(spark, texts))) == brute(texts)
    texts = [(None, LINE)] * 6
    assert result(L.dedup_lines(awkward(spark, texts))) == [(None, 1, 0, LINE)] * 6


def test_very_long_text_and_empty_table(spark):
    long = "\n".join(prose(i, 200) for i in range(1000)) + "\n" + prose(99, 1_000_000)
    texts = [(i, long) for i in range(5)]
    assert result(L.dedup_lines(awkward(spark, texts))) == brute(texts)
    assert L.dedup_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal_and_fingerprints_reject_others(n):
    rng = np.random.default_rng(n)
    hi, lo = (rng.integers(0, 1 << 64, n, np.uint64) for _ in range(2))
    shard = L.Shard.load(L.Shard.build(hi, lo, np.arange(n) + 5, np.arange(n) * 3).dump())
    assert sorted(shard.hashes.slots(hi, lo).tolist()) == list(range(n)) and len(shard.hashes) == n
    counts, keepers = shard.probe(hi, lo)
    assert counts.tolist() == list(range(5, n + 5)) and keepers.tolist() == [3 * i for i in range(n)]
    other = rng.integers(0, 1 << 64, 1000, np.uint64)
    assert not shard.probe(other, other)[0].any()
    assert not shard.probe(hi, lo + np.uint64(1))[0].any()
    assert shard.hashes.words.nbytes * 8 <= 6 * n + 64 * L.MAX_LEVELS


def test_equal_first_hashes_are_told_apart():
    hi = np.array([7, 7, 7, 9], np.uint64)
    lo = np.array([1, 2, 3, 1], np.uint64)
    shard = L.Shard.load(L.Shard.build(hi, lo, np.array([5, 6, 7, 8]), np.array([1, 2, 3, 4])).dump())
    assert len(shard.hashes.rest) == 3
    assert shard.probe(hi, lo)[0].tolist() == [5, 6, 7, 8]
    assert shard.probe(np.array([7], np.uint64), np.array([4], np.uint64))[0].tolist() == [0]


def test_line_keys():
    random.seed(1)
    assert L.line_digest(b" \t" + b"A" * 40 + b"\r\x0b\x0c", 40) == L.line_digest(b"a" * 40, 40) != None  # noqa: E711
    assert L.line_digest(b"a" * 39 + b" ", 40) is None
    assert L.line_digest("Ä".encode() * 40, 40) != L.line_digest("ä".encode() * 40, 40)
