import itertools
import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from medwright.llm import hmm as H
from medwright.llm.common import crc_held_out

from .helpers import awkward, empty, prose


def small_model(classes=5, states=3):
    return H.Model.random(np.full(classes, 1 / classes), states, np.random.default_rng(3))


def test_forward_sums_over_all_paths():
    m = small_model()
    lengths, classes = np.array([4, 2, 1]), np.array([0, 3, 1, 4, 2, 2, 0])
    stream, begin = H._steps(classes, np.array([0, 4, 6]), lengths)
    got = H.log10_likelihood(H.forward(m, stream, begin)[1], begin, 3)
    for d, text in enumerate(([0, 3, 1, 4], [2, 2], [0])):
        p = 0.0
        for path in itertools.product(range(3), repeat=len(text)):
            q = m.start[path[0]] * m.emit[text[0], path[0]]
            for t in range(1, len(text)):
                q *= m.move[path[t - 1], path[t]] * m.emit[text[t], path[t]]
            p += q
        assert abs(got[d] - math.log10(p)) < 1e-9


def test_expected_counts_equal_enumeration_and_raise_the_likelihood():
    m, text = small_model(), [0, 3, 1]
    start, move, emit, _ = H.expected_counts(m, np.array(text), np.array([3]))
    s, a, e, total = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
    for p in itertools.product(range(3), repeat=3):
        q = m.start[p[0]] * m.emit[text[0], p[0]] * m.move[p[0], p[1]] * m.emit[text[1], p[1]] * m.move[p[1], p[2]] * m.emit[text[2], p[2]]
        total += q
        s[p[0]] += q
        for i in (0, 1):
            a[p[i], p[i + 1]] += q
        for i in range(3):
            e[text[i], p[i]] += q
    assert np.allclose(start, s / total) and np.allclose(move, a / total) and np.allclose(emit, e / total)
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 30, 50)
    classes = rng.integers(0, 5, lengths.sum())
    before = -np.inf
    for _ in range(5):
        start, move, emit, now = H.expected_counts(m, classes, lengths)
        assert now > before - 1.0  # the prior may cost a little
        before, m = now, H.Model.from_counts(start, move, emit, np.full(5, 0.2))


def brute_base(rows):
    tokens = {i: [*(r.text or "").encode().lower().split(), b""] for i, r in enumerate(rows)}
    held = {i: r.doc_id is not None and crc_held_out(r.doc_id, 7, 2) for i, r in enumerate(rows)}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((r.doc_id, held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i]), 6))
                   for i, r in enumerate(rows)), key=str)


def test_scores_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(H, "OWN", 64)
    docs = awkward(spark)
    got = H.score_documents(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute_base(docs.collect())
    assert all(r.score < 0 for r in got)
    assert H.score_documents(empty(spark)).count() == 0


def test_states_beat_the_base_on_held_out_texts(spark):
    """Two manners of writing in one corpus: states tell them apart, a unigram cannot."""
    rows = [(i, prose(i, 80) if i % 2 else " ".join(f"{w}x" for w in prose(i, 80).split())) for i in range(160)]
    got = [r for r in H.score_documents(awkward(spark, rows), rounds=2).collect() if r.held_out]
    assert len(got) > 10 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_word_probabilities_sum_to_one():
    """Classes' emissions and the shares within classes, with the unknown word's place, leave nothing over."""
    m = small_model(6)
    counts = {0: [9], 1: [5, 2, 1], 2: [3], 3: [], 4: [1, 1], 5: [2]}  # class 0 is a word of its own
    for s in range(3):
        total = 0.0
        for k, cs in counts.items():
            inside = 1.0 if k == 0 else sum((c + 1) / (sum(cs) + len(cs) + 1) for c in cs) + 1 / (sum(cs) + len(cs) + 1)
            total += m.emit[k, s] * inside
        assert abs(total - 1) < 1e-9


def test_scores_of_whole_texts_equal_a_plain_forward_recursion(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK_BYTES", 20_000)
    docs = awkward(spark, [(i, prose(i, 3 + 40 * (i % 9))) for i in range(60)] + [(100, ""), (101, None), (102, prose(5, 3000)), (102, prose(5, 3000))])
    corpus = H.code(docs, 7, 2)
    model = H.baum_welch(corpus, H.first_model(corpus))
    got = sorted((r.doc_id, r.n_tokens, round(r.score, 6)) for r in H.score(corpus, model).collect())
    want = []
    for row in corpus.coded.collect():
        classes, at = np.frombuffer(row.classes, "<u2"), 0
        for doc_id, n, within in zip(row.doc_ids, row.lengths, row.within):
            total, alpha = within, None
            for c in classes[at:at + n].tolist():
                alpha = (model.start if alpha is None else [sum(alpha[i] * model.move[i, j] for i in range(len(alpha))) for j in range(len(alpha))]) * model.emit[c]
                total += math.log10(sum(alpha))
                alpha = alpha / sum(alpha)
            at += n
            want.append((doc_id, n, round(total, 6)))
    assert len(want) == 64 and got == sorted(want)


@pytest.mark.parametrize("distinct", [1, 300, 1 << 24, (1 << 24) + 9])
def test_codes_come_back_from_their_planes(distinct):
    codes = np.random.default_rng(1).integers(0, distinct, 5000).astype(np.uint32)
    codes[0] = distinct - 1
    packed = H.pack_codes(codes, distinct)
    assert len(packed) == 5000 * (3 if distinct <= 1 << 24 else 4)
    assert (H.unpack_codes(pa.py_buffer(packed), 5000) == codes).all()


def test_training_holds_few_tokens_at_a_time():
    rng = np.random.default_rng(2)
    lengths = rng.integers(100, 900, 1200)
    classes = rng.integers(0, H.OWN + H.SHARED, int(lengths.sum())).astype(np.uint16)
    model = H.Model.random(np.full(H.OWN + H.SHARED, 1 / (H.OWN + H.SHARED)), H.STATES, rng)
    tracemalloc.start()
    start, move, emit, _ = H.expected_counts(model, classes, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # some 600,000 tokens; two matrices of all of them would be 73 MB
    assert np.isclose(emit.sum(), lengths.sum()) and np.isclose(start.sum(), len(lengths)) and np.isclose(move.sum(), lengths.sum() - len(lengths))
