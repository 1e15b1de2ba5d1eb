import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from medwright.llm import bytecnn, langid, quality, toxicity
from medwright.llm.common import crc_held_out, held_out, lowered, utf8

from .helpers import awkward, empty

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled():
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    labels = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    return [d | labels.get(d["doc_id"], {}) | {"held": crc_held_out(d["doc_id"], 3, 1)} for d in docs]


def raw(text):
    return np.frombuffer(text.encode(), np.uint8)


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    label = np.asarray(label, bool)
    return (order[label].sum() - label.sum() * (label.sum() + 1) / 2) / (label.sum() * (~label).sum())


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(50).select("id", held_out("id", 3, 1).alias("h"), held_out("id", 7, 2).alias("g")).collect()
    assert all(r.h == crc_held_out(r.id, 3, 1) and r.g == crc_held_out(r.id, 7, 2) for r in rows)


def test_lowered_reaches_latin_1():
    assert lowered(raw("ÀÉÎÕÜ×ß Abc")).tobytes().decode() == "àéîõü×ß abc"


def test_pooling_equals_direct_convolution():
    rng = np.random.default_rng(2)
    filters = bytecnn.Filters.random({2: 3, 3: 2}, rng)
    data = rng.integers(0, 255, 1500).astype(np.uint8)
    laid, first = bytecnn.lay_out(data, np.array([0, 700, 700, 1500]))
    fast, (slow, places) = bytecnn.pooled(filters.pair_tables(), laid), bytecnn.pooled_at(filters, laid)
    assert np.allclose(fast, slow, atol=1e-5) and list(first) == [0, 3, 4, 8]
    w = filters.weights[3]
    direct = max(sum(w[j, laid[i + j], 1] for j in range(3)) for i in range(256, 512))
    assert abs(direct - fast[1, 4]) < 1e-5


def test_quality_held_out(labelled):
    known = [d for d in labelled if "quality" in d]
    train = [d for d in known if not d["held"]]
    net = quality.fit([raw(d["text"]) for d in train], [d["quality"] for d in train], epochs=20)
    test = [d for d in known if d["held"]]
    p = net.probabilities(net.filters.pair_tables(), *bytecnn.join_rows([raw(d["text"]) for d in test]))
    assert auc(p, [d["quality"] for d in test]) > 0.9 and ((p >= 0) & (p <= 1)).all()


def test_chunks_overlap_and_cover_the_document():
    blocks = np.arange(12, dtype=np.float32).reshape(6, 2)[::-1].copy()
    out, whole, starts = quality.describe(blocks, np.array([0, 1, 4, 6]))
    assert whole.tolist() == [True, True, True, False, True, False] and starts.tolist() == [0, 1, 3]
    assert out[1].tolist() == [8, 9, 7, 8]  # maximum and mean of the two overlapping chunks


def test_language_held_out(labelled):
    train = [d for d in labelled if not d["held"] and d["lang"]]
    net = langid.fit([raw(d["text"]) for d in train], [d["lang"] for d in train])
    test = [d for d in labelled if d["held"]]
    best, p = net.predict(net.filters.pair_tables(), *bytecnn.join_rows([raw(d["text"]) for d in test]))
    assert np.mean([net.languages[b] == d["lang"] for b, d in zip(best, test)]) > 0.95


def test_toxicity_learns_sentences_from_document_labels():
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(6)]
        if i % 4 == 0:
            sentences[int(rng.integers(6))] += " vile slur"
        texts.append(". ".join(sentences) + ".")
        labels.append(int(i % 4 == 0))
    parts = [toxicity.sentence_words(raw(t), np.array([0, len(t.encode())])) for t in texts]
    model = toxicity.fit([p[0] for p in parts], [p[4] for p in parts], np.array(labels))
    for t, y, (h, starts, ends, rows, sentence) in zip(texts, labels, parts):
        z = model.logits(h, sentence, int(sentence[-1]) + 1)
        assert (1 - np.exp(-np.logaddexp(0, z).sum()) >= 0.7) == bool(y)
        if y:
            inside = sentence == int(z.argmax())
            assert "vile" in t[starts[inside][0]:ends[inside][-1]]


def test_long_runs_without_breaks_are_cut():
    data = raw("a " * 100)
    sentence = toxicity.sentence_words(data, np.array([0, len(data)]))[4]
    assert np.bincount(sentence).tolist() == [32, 32, 32, 4]


def test_awkward_rows_and_missing_labels(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        net = quality.train(docs, lab)
        out = quality.score(docs, net, "q").collect()
        assert len(out) == docs.count() and all(0 <= r.q <= 1 for r in out) and out[0].score == "x"
        model = toxicity.train(docs, lab)
        out = toxicity.score(docs, model, "t").collect()
        assert len(out) == docs.count() and all(r.t == 0 for r in out if not (r.text or "").strip())
    langs = docs.withColumn("lang", docs.score)
    net = langid.train(langs)
    out = langid.identify(docs, net, "l", "s").collect()
    assert {r.l for r in out if not (r.text or "").strip()} == {"und"} and all(0 <= r.s <= 1 for r in out)
    nothing = langid.train(langs.filter("lang is null"))
    assert {r.l for r in langid.identify(docs, nothing, "l", "s").collect()} == {"und"}
    for out in (quality.score(empty(spark), quality.fit([], []), "q"), toxicity.score(empty(spark), toxicity.fit([], [], np.zeros(0)), "t"),
                langid.identify(empty(spark), nothing, "l", "s")):
        assert out.count() == 0


def test_offending_spans_point_into_the_text(spark):
    h = toxicity.sentence_words(raw("slur"), np.array([0, 4]))[0]
    model = toxicity.Model(h, np.array([20.0]), -10.0)
    docs = awkward(spark, [(1, "Clean words here. Ünd a SLUR there! More."), (2, "clean")])
    a, b = toxicity.score(docs, model, "t").orderBy("doc_id").collect()
    span = a.offending[0]
    assert a.text.encode()[span.start:span.stop].decode() == "Ünd a SLUR there" and b.offending == [] and a.t > 0.99 > 0.01 > b.t


def test_long_clean_texts_stay_clean_and_one_toxic_sentence_is_caught(labelled, spark):
    known = [d for d in labelled if "toxic" in d and not d["held"] and d["text"]]
    parts = [toxicity.sentence_words(raw(d["text"]), np.array([0, len(d["text"].encode())])) for d in known]
    model = toxicity.fit([p[0] for p in parts], [p[4] for p in parts], np.array([d["toxic"] for d in known]))
    scored = toxicity.score(awkward(spark, [(d["doc_id"], d["text"]) for d in labelled]), model, "t").collect()
    clean = [r.text for r in scored if r.text and r.t < 0.1]
    worst = max((s.score, r.text.encode()[s.start:s.stop].decode()) for r in scored for s in r.offending)
    assert worst[0] > 0.9
    rows, words, n, i = [], [], 0, 0
    for limit in (100_000, 1_000_000):
        while n < limit:
            words.append(clean[i % len(clean)])
            n, i = n + len(words[-1].split()), i + 1
        text = "\n".join(words)
        rows += [(limit, text), (limit + 1, "\n".join(words[:i // 2] + [worst[1]] + words[i // 2:])), (limit + 2, text + "\n" + worst[1])]
    out = {r.doc_id: r for r in toxicity.score(awkward(spark, rows), model, "t").collect()}
    for limit in (100_000, 1_000_000):
        assert out[limit].t < 0.7 and not out[limit].offending, (limit, out[limit].t)
        assert out[limit + 1].t >= 0.7 and out[limit + 2].t >= 0.7 and len(out[limit + 1].offending) == 1


def test_up_to_the_trained_length_the_score_is_the_noisy_or():
    rng = np.random.default_rng(6)
    for words in (1, 2047, 2048, 4096):
        first = np.unique(np.append(rng.integers(0, words, words // 9 + 1), 0))
        hazard = rng.random(len(first))
        rows = np.repeat([1, 3], words)
        both = np.concatenate([first, first + words])
        got = toxicity.document_hazard(np.tile(hazard, 2), np.tile(hazard > 0.7, 2), both, rows, 5)
        assert np.allclose(got, [0, hazard.sum(), 0, hazard.sum(), 0])
    far = np.array([0, 3000, 9000])
    assert np.allclose(toxicity.document_hazard(np.array([0.5, 0.3, 0.4]), np.zeros(3, bool), far, np.zeros(9001, np.int64), 1), 0.8)
    assert np.allclose(toxicity.document_hazard(np.array([0.8, 0.3, 0.9]), np.array([True, False, True]), far, np.zeros(9001, np.int64), 1), 2.0)
    assert toxicity.document_hazard(np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), 2).tolist() == [0, 0]


def test_utf8_of_slices():
    data, offsets = utf8(pa.array(["ab", None, "é", ""]).slice(1, 3))
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 2, 2]


# ---------------------------------------------------------------- queries against one document at a time

SMALL = "/root/testdata/sf0.001"


def block_maxima(filters, text):
    """Of one document laid out alone: each block's maximum of each filter, window by window, and the bytes it holds."""
    data = [0xFF] * 8 + list(text.encode())
    data += [0xFF] * (-(-(len(data) + 8) // 256) * 256 - len(data))
    held = [sum(b != 0xFF for b in data[i:i + 256]) for i in range(0, len(data), 256)]
    padded = np.array(data + [0xFF] * 8)
    columns = []
    for w, x in filters.weights.items():
        values = sum(x[j, padded[j:j + len(data)]] for j in range(w))
        columns.append(np.stack([values[i:i + 256].max(0) for i in range(0, len(data), 256)]))
    return np.concatenate(columns, axis=1), np.array(held)


def plain_quality(net, text):
    blocks, _ = block_maxima(net.filters, text or "")
    chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:])] or [blocks[0]]
    x = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)])
    h = np.tanh((x - net.layers["mean"]) / net.layers["scale"] @ net.layers["w1"] + net.layers["b1"])
    return 1 / (1 + np.exp(-float((h @ net.layers["w2"] + net.layers["b2"])[0])))


def plain_language(net, text):
    blocks, held = block_maxima(net.filters, text)
    z = sum(n * ((b - net.layers["mean"]) / net.layers["scale"] @ net.layers["w"] + net.layers["b"]) for b, n in zip(blocks, held)) / held.sum()
    p = np.exp(z - z.max())
    return net.languages[int(p.argmax())], float(p.max() / p.sum())


def test_quality_query_equals_one_document_at_a_time(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    net = quality.train(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in quality.op2_quality(spark, SMALL).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert net.prior is None and len(got) == len(rows)
    for r in rows:
        want = plain_quality(net, r.text)
        assert abs(got[r.doc_id].score - want) < 1e-4, r.doc_id
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5) and got[r.doc_id].held_out == crc_held_out(r.doc_id, 3, 1)


def test_language_query_equals_one_document_at_a_time(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = langid.train(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in langid.op7_language(spark, SMALL).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        lang, p = plain_language(net, r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - p) < 1e-4, r.doc_id


def test_a_score_does_not_depend_on_the_neighbours(labelled):
    texts = [raw(d["text"]) for d in labelled[:120]]
    net = quality.fit(texts, [i % 2 for i in range(len(texts))], epochs=1)
    lang = langid.fit(texts, [("a", "b")[i % 2] for i in range(len(texts))], epochs=1)
    tables = net.filters.pair_tables(), lang.filters.pair_tables()
    together = net.probabilities(tables[0], *bytecnn.join_rows(texts)), lang.predict(tables[1], *bytecnn.join_rows(texts))[1]
    alone = [net.probabilities(tables[0], *bytecnn.join_rows([t]))[0] for t in texts], [lang.predict(tables[1], *bytecnn.join_rows([t]))[1][0] for t in texts]
    assert np.allclose(together[0], alone[0], atol=1e-6) and np.allclose(together[1], alone[1], atol=1e-6)


def test_repeated_rows_are_scored_each_for_itself(spark):
    text = "The quick brown fox. " * 20
    docs = awkward(spark, [(1, text), (1, text), (1, "something else entirely"), (2, text)])
    net = quality.fit([raw(text), raw("zzz qqq")] * 4, [1, 0] * 4, epochs=1)
    got = sorted((r.doc_id, round(r.quality, 6)) for r in quality.score(docs, net, "quality").collect())
    assert len(got) == 4 and len({s for _, s in got}) == 2
    lang = langid.fit([raw(text), raw("zzz qqq")] * 4, ["en", "xx"] * 4, epochs=1)
    assert langid.identify(docs, lang, "l", "p").count() == 4


def test_the_toxicity_fit_needs_little_memory_beside_its_sample(monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = np.sort(rng.integers(1, 1 << 62, 500).astype(np.uint64))
    words = [rng.choice(vocabulary[:400], 2000) for _ in range(400)]
    labels = np.arange(400) % 2
    for i in range(1, 400, 2):
        words[i][100:104] = vocabulary[400 + i % 100]
    sentences = [np.repeat(np.arange(200, dtype=np.int32), 10) for _ in words]
    tracemalloc.start()
    model = toxicity.fit(words, sentences, labels, epochs=20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * sum(w.nbytes for w in words)  # of 12 bytes a word that the sample has
    monkeypatch.setattr(toxicity, "_RUN_WORDS", 999)
    short = toxicity.fit(words, sentences, labels, epochs=20)
    assert (short.hashes == model.hashes).all() and np.allclose(short.weights, model.weights) and np.isclose(short.bias, model.bias)
