import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from medwright.llm import exact_dedup as E
from medwright.llm import near_dedup as N

from .helpers import SF, awkward, by_id, empty, prose


def test_extendible_hash_splits_doubles_and_chains():
    index = E.ExtendibleHash(capacity=4, max_depth=10)
    keys = [int(k) for k in np.random.default_rng(1).integers(0, 2 ** 63, 500)] + [5] * 20  # one key of many texts
    for i, k in enumerate(keys):
        index.add((k, hashlib.sha256(str(i).encode()).hexdigest().encode(), i, True, 1))
    assert index.depth > 5 and len(index.find(5)) == 20
    loaded = E.load_index(index.dump())
    for i, k in enumerate(keys):
        assert E.lookup(loaded, k, hashlib.sha256(str(i).encode()).hexdigest()) == (i, 1)
    assert E.lookup(loaded, 6, "0" * 64) is None


def test_owner_compares_bytes_under_one_key(tmp_path):
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()])],
                                          names=["key", "text_sha256", "text", "doc_id", "n"])
    rows = [(7, "a" * 64, "one", 3, 1), (7, "b" * 64, "two", 4, 1), (7, "a" * 64, "one", 2, 1), (7, "a" * 64, None, 9, 5), (8, "c" * 64, "x", None, 1)]
    out = list(E._owner(f"file://{tmp_path}")(iter([batch(rows)])))
    index = E.load_index(open(out[0].column(0)[0].as_py(), "rb").read())
    assert E.lookup(index, 7, "a" * 64) == (2, 7) and E.lookup(index, 7, "b" * 64) == (4, 1) and E.lookup(index, 8, "c" * 64) == (None, 1)
    with pytest.raises(ValueError):
        list(E._owner(f"file://{tmp_path}")(iter([batch([(7, "a" * 64, "one", 3, 1), (7, "a" * 64, "other", 4, 1)])])))


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_exact_dedup_equals_brute_force(spark):
    docs = awkward(spark)
    assert sorted(map(tuple, E.exact_dedup(docs, 3).collect()), key=str) == brute_exact(docs.collect())
    assert E.exact_dedup(empty(spark), 2).count() == 0


def weighted_jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


@pytest.mark.parametrize("weighted", [False, True])
def test_dart_signatures_agree_as_often_as_sets_are_similar(weighted):
    rng = np.random.default_rng(5)
    elements = N.mix(np.arange(1, 400, dtype=np.uint64))
    wa, wb = rng.integers(1, 9, 399) / 2.0, rng.integers(1, 9, 399) / 2.0
    a, b = dict(zip(range(0, 300), wa)), dict(zip(range(60, 360), wb))
    if not weighted:
        a, b = dict.fromkeys(a, 1.0), dict.fromkeys(b, 1.0)
    sig = lambda x: N.dart_signature(elements[list(x)], np.array(list(x.values())) if weighted else None, 2000)
    got = float((sig(a) == sig(b)).mean())
    assert abs(got - weighted_jaccard(a, b)) < 0.05
    assert (sig(a) == sig(dict(reversed(a.items())))).all()  # order doesn't matter


def test_small_sets_fill_every_coordinate():
    for n in (1, 2, 7):
        assert (N.dart_signature(N.mix(np.arange(n, dtype=np.uint64)), None, 80) != 0).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.id: r.component for r in N.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    assert N.components(links.limit(0)).count() == 0


def brute_near(rows, similarity=0.8):
    sets = {}
    for r in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        if r["doc_id"] is not None:
            sets[r["doc_id"]] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def family(n, size, noise):
    """A text and copies of it with ever more words replaced: links chain through the middle ones."""
    base = prose(n, size).split()
    out = []
    for k in range(12):
        words = list(base)
        for j in range(k * noise):
            words[(j * 37 + k * 11) % size] = f"new{k}x{j}"
        out.append(" ".join(words))
    return out


def test_near_classes_equal_brute_force(spark):
    texts = [t for n in range(4) for t in family(n, 150, 1)] + [prose(50 + i, 120) for i in range(30)]
    docs = awkward(spark, list(enumerate(texts)))
    got = N.near_duplicates(docs).collect()
    assert by_id(got, "class_id") == brute_near(docs.collect())


def strayed(n, size, copies, most):
    """A text and copies with up to ``most`` words replaced, some by words that many copies share."""
    base, rng = prose(n, size).split(), np.random.default_rng(n)
    out = [" ".join(base)]
    for k in range(copies):
        words = list(base)
        for j in rng.choice(size, int(rng.integers(1, most)), replace=False):
            words[j] = f"new{k}x{j}" if rng.random() < 0.7 else f"often{rng.integers(3)}"
        out.append(" ".join(words))
    return out


def test_strayed_copies_are_not_all_compared(spark, monkeypatch):
    texts = strayed(3, 150, 240, 14) + [prose(50 + i, 120) for i in range(20)]
    texts = texts[1:150] + texts[:1] + texts[150:]  # the least doc_id is not the original's
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared = []
    one = N._compared

    def counted(pairs, sets):
        out = N.written(one(pairs, sets), "test-pairs")
        compared.append(out.count())
        return out
    monkeypatch.setattr(N, "_compared", counted)
    for rare in (4, 32):
        compared.clear()
        monkeypatch.setattr(N._rare, "__defaults__", (rare,))
        got = N.near_duplicates(docs).collect()
        assert by_id(got, "class_id") == brute_near(docs.collect())
        assert len({r.class_id for r in got}) > 100 and sum(compared) < 20 * len(texts)


def test_rare_shingles_name_every_pair_that_common_ones_do_not(spark):
    """Similar pairs share a rare shingle, or have common ones enough."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(20, 50))).astype("<u4")) for _ in range(60)]
    sets += [np.unique(np.append(s[rng.random(len(s)) < 0.95], np.uint32(100 + i))) for i, s in enumerate(sets)]
    table = spark.createDataFrame([(i % 110, s.tobytes()) for i, s in enumerate(sets)], "id long, shingles binary")
    common, pairs = N._rare(table, 0.8, 52)
    common, pairs = {r.id: r for r in common.collect()}, {(r.x, r.y) for r in pairs.collect()}
    assert len(common) == 110 and pairs
    similar = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            x, y = sorted((i % 110, j % 110))
            if x != y and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                similar += 1
                assert (x, y) in pairs or min(common[x].c, common[y].c) >= N._overlap(common[x].m, common[y].m, 0.8)
    assert similar > 20


def test_near_dedup_of_awkward_rows(spark):
    docs = awkward(spark)
    got = N.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert by_id(got, "class_id") == brute_near(docs.collect())
    assert all(r.class_id is None for r in got if r.doc_id is None)
    assert N.near_duplicates(empty(spark)).count() == 0


def test_op1_on_whole_table_equals_brute_force(spark):
    got = N.op1_near_dedup(spark, SF).collect()
    assert by_id(got, "class_id") == brute_near(spark.read.parquet(f"{SF}/documents.parquet").collect())
