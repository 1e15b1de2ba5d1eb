import io
import random
import re
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from medwright.llm import common
from medwright.llm import near_dedup as N
from medwright.llm import packing as P
from medwright.llm import token_output as O
from medwright.llm.common import scratch_dir
from medwright.llm.encoding import _WORDS, Encoder, encoder
from medwright.llm.planes import Reader, Writer, from_planes, to_planes

from .helpers import awkward, empty

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def whole(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cut_texts_encode_as_whole_ones(path):
    rng = random.Random(3)
    bits = ["a", "Word", "'s", "'T", " ", "  ", "\n", "\t", ".", "!!", "é", "é", "1", "½", "<|endoftext|>", " ", "\x1c", "\x01", "_", "日", "ß", "İ", "Σ", "|", " "]
    texts = ["", " ", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 16))) for _ in range(4000))]
    encoder, tokenizer = Encoder(path, remembered=500), Tokenizer.from_file(path)
    for i in range(0, len(texts), 100):
        got = encoder.encode(texts[i:i + 100])
        assert got == [whole(tokenizer, t, 0)[:-1].tobytes() for t in texts[i:i + 100]]


def test_a_worker_that_goes_on_to_other_work_drops_the_encoder():
    """On check_h an executor's two workers held 696 MB in decontamination, most of it from the packing of earlier inputs."""
    kept = weakref.ref(encoder(WORD))
    ids = kept().encode(["a word"])
    assert encoder(WORD) is kept()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a word or two"])], names=["doc_id", "text"])
    assert len(list(N._documents(iter([batch])))) == 1
    assert kept() is None
    assert encoder(WORD).encode(["a word"]) == ids


def test_the_first_choice_of_a_word_is_that_of_the_others():
    choice, rest = _WORDS.pattern[:_WORDS.pattern.index("|")], _WORDS.pattern[_WORDS.pattern.index("|") + 1:]
    assert choice.startswith(" [A-Z")
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(" aZéßİıɏ  \n\t\x1c.,:;!?\"'()-_0日\u0301\u00a0") for _ in range(30))
        assert _WORDS.findall(text) == re.findall(rest, text)


def test_token_files_are_written_with_a_memory_of_their_own(spark, monkeypatch):
    """Words met again after as many others as a small memory holds are not learnt anew."""
    assert O.REMEMBERED > 400_000
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"), O.REMEMBERED)
    learnt = []
    monkeypatch.setattr(e, "_learn", lambda w: learnt.append(w) or b"")
    e.words.learn = e._learn
    texts = [" ".join(f"{c}{i}x" for i in range(9000)) for c in "abcdefghij" * 5] + [" ".join(f"w{j}y{i}" for i in range(9000)) for j in range(40)]
    e.encode(texts + texts)
    assert len(learnt) == len(set(learnt))


@pytest.mark.parametrize("planes", [4, 32])
def test_planes_round_trip(planes):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1001):
        ids = rng.integers(0, 2 ** 32, n, dtype=np.uint64).astype("<u4")
        assert (from_planes(to_planes(ids, planes), n) == ids).all()
    out, docs = io.BytesIO(), [(i if i else None, rng.integers(0, 50000, n).astype("<u4").tobytes()) for i, n in enumerate([3, 0, 64, 1, 500, 10])]
    writer = Writer(out, planes, chunk_ids=64)
    for doc in docs:
        writer.add(*doc)
    writer.close()
    reader = Reader(io.BytesIO(out.getvalue()))
    got = list(reader.documents())
    assert [(d, ids) for d, _, ids in got] == docs and len(reader.index) == 10
    assert [s for _, s, _ in got] == np.cumsum([0] + [len(b) // 4 for _, b in docs])[:-1].tolist()


def test_chunks_are_reached_by_the_index():
    out = io.BytesIO()
    writer = Writer(out, 4, chunk_ids=10)
    writer.add(1, np.arange(35, dtype="<u4").tobytes())
    writer.close()
    assert Reader(io.BytesIO(out.getvalue())).chunk(2).tolist() == list(range(20, 30))


def test_a_worker_is_emptied_before_an_encoder_is_made(monkeypatch):
    """What a worker has left from decontamination and the encoder's memory do not add up."""
    dropped = []
    monkeypatch.setattr(common, "KEPT", [*common.KEPT, lambda: dropped.append(1)])
    encoder.cache_clear()
    assert encoder(WORD, 500) is encoder(WORD, 500)
    assert dropped == [1]


def test_packing_with_little_memory_equals_brute_force(spark):
    docs = awkward(spark)
    check_packing(P.pack(docs, WORD, 2048, 0, remembered=3).collect(), docs.collect(), 2048, 0, WORD)


def test_token_files_equal_brute_force(spark):
    docs = awkward(spark)
    folder = scratch_dir(spark, "ids-test")
    got = O.read_ids(O.write_ids(docs, folder, BYTE, files=3, chunk_ids=1000), folder).orderBy("start").collect()
    tokenizer, at, want = Tokenizer.from_file(BYTE), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        ids = whole(tokenizer, r.text, O.END_ID)
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == want
    folder = scratch_dir(spark, "ids-test")
    assert O.read_ids(O.write_ids(empty(spark), folder, BYTE), folder).count() == 0


def check_packing(rows, docs, capacity, end, path):
    tokenizer = Tokenizer.from_file(path)
    want = []
    for r in docs:
        ids = whole(tokenizer, r.text, end)
        want += [(r.doc_id, i // capacity, i, len(ids[i:i + capacity]), zlib.crc32(ids[i:i + capacity].tobytes())) for i in range(0, len(ids), capacity)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values(), default=0) <= capacity
    return len(at)


def test_best_fit_takes_the_tightest_place():
    bins, offsets, fill = P.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8] and fill.tolist() == [10, 10]


def test_packing_equals_brute_force(spark):
    docs = awkward(spark)
    check_packing(P.pack(docs, WORD, 2048, 0).collect(), docs.collect(), 2048, 0, WORD)
    assert P.pack(empty(spark), WORD).count() == 0


def test_rounds_merge_what_partitions_leave(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ITEMS", 20)
    docs = awkward(spark, [(i, "word " * (3 + i % 9)) for i in range(240)]).repartition(12)
    n = check_packing(P.pack(docs, WORD, 64, 0).collect(), docs.collect(), 64, 0, WORD)
    total = sum(4 + i % 9 for i in range(240))
    assert n <= -(-total // 64) + 3
