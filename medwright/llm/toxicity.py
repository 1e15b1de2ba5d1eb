"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained on document labels.

A document is a bag of sentences (runs of words up to . ! ? or a line end, cut after 32 words). A
sentence's probability is a logistic function of its words; the document's is the noisy-or of its
sentences, 1 - prod(1 - p). Only document labels are known, so the gradient flows through the noisy-or
to the sentences that explain the label. Labels may be wrong at a small rate, which the likelihood
contains. An L1 step keeps only words that carry evidence, and words are looked up by a 64-bit hash, so
an unseen word never borrows a weight.

Fitting reads a bounded sample: the ``TRAIN_DOCS`` labelled training rows with the least hash of doc_id,
without documents of over ``TRAIN_WORDS`` words. Scoring reads every whole text. The fitted bias holds for bags of
that length only, and a long clean text would add it up to any score. So sentences of 0.5 or more count wherever they
stand, and all others as in the worst stretch of ``TRAIN_WORDS`` words; up to that length this is the plain noisy-or.

Defined cases: a null or empty text has no sentence and scores 0; without any usable label (or of one
class only) every score is the share of toxic labels, 0 without labels; labels that repeat count as toxic if one row says so;
an empty table gives an empty result. Rows that repeat are scored each for itself, and where their doc_id is in the training sample
each of them is learnt from. Spans stand in the order of the text; equal scores are not ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwright.llm.common import LETTERS, hash_spans, held_out, labelled, lowered, slices, table, training_sample, unburden, with_columns, words_of

TRAIN_DOCS = 8000
TRAIN_WORDS = 4096
SENTENCE_WORDS = 32
THRESHOLD = 0.7
#: Words of the sample that the fit goes over at a time.
_RUN_WORDS = 1 << 18

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


def sentence_words(data: np.ndarray, offsets: np.ndarray):
    """Word hashes, word starts and ends, and for each word its row and the number of its sentence."""
    data = lowered(data)
    starts, ends, rows = words_of(data, offsets, LETTERS)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, rows, np.zeros(0, np.int64)
    sentence = np.cumsum(_BREAK[data], dtype=np.int64)[starts] + rows
    first = np.diff(sentence, prepend=sentence[0] - 1) != 0
    at = np.flatnonzero(first)
    place = np.arange(len(starts)) - np.repeat(at, np.diff(at, append=len(starts)))
    return hash_spans(data, starts, ends), starts, ends, rows, np.cumsum(first | (place % SENTENCE_WORDS == 0)) - 1


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    prior: float | None = None  # the score of every document where nothing could be learned

    def logits(self, hashes: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        if not len(self.hashes):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        w = np.where(self.hashes[at] == hashes, self.weights[at], 0.0)
        return self.bias + np.bincount(sentence, w, n)


def fit(features: list[np.ndarray], sentences: list[np.ndarray], labels: np.ndarray, *, epochs: int = 400, rate: float = 0.3,
        l1: float = 0.3, noise: float = 0.02, least_docs: int = 5) -> Model:
    """Train on bags: per document its word hashes and the sentence number of each."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, prior=float(labels.mean()) if len(labels) else 0.0)
    known, df = np.unique(np.concatenate([np.unique(f) for f in features]), return_counts=True)
    known = known[df >= least_docs]
    sizes = [len(f) for f in features]
    feat, inst = np.empty(sum(sizes), np.int32), np.empty(sum(sizes), np.int32)
    doc, n, used = [], 0, 0
    for d in range(len(labels)):
        f, s = features[d], sentences[d]
        if not len(f):
            continue
        s = s - s[0]
        at = np.minimum(np.searchsorted(known, f), max(len(known) - 1, 0))
        hit = known[at] == f if len(known) else np.zeros(len(f), bool)
        more = used + int(hit.sum())
        feat[used:more] = at[hit]
        inst[used:more] = s[hit] + n
        doc.append(np.full(int(s[-1]) + 1, d, np.int32))
        n, used = n + int(s[-1]) + 1, more
    feat, inst = feat[:used], inst[:used]
    doc = np.concatenate(doc) if doc else np.zeros(0, np.int32)
    # Words are gone over in runs that end with a sentence, so that working memory stays small beside the sample.
    cuts = [0, *np.searchsorted(inst, inst[_RUN_WORDS::_RUN_WORDS], side="left").tolist(), used]
    runs = [(feat[i:j], inst[i:j], int(inst[i]), int(inst[j - 1]) + 1) for i, j in zip(cuts, cuts[1:]) if i < j]
    w, b = np.zeros(len(known)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = np.full(n, b)
        for f, s, i, j in runs:
            z[i:j] += np.bincount(s - i, w[f], j - i)
        some = np.bincount(doc, np.logaddexp(0, z), len(labels))  # -log of no toxic sentence
        none = np.exp(-some)
        p = noise + (1 - 2 * noise) * (1 - none)
        slope = (1 - 2 * noise) * none * np.where(labels > 0, -1 / p, 1 / (1 - p))
        gz = slope[doc] / (1 + np.exp(-z))
        gw, gb = np.zeros(len(w)), gz.sum()
        for f, s, _, _ in runs:
            gw += np.bincount(f, gz[s], len(w))
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate / (np.sqrt(v / (1 - 0.99 ** t)) + 1.0)
        w = w - scale * m / (1 - 0.9 ** t)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)
        b -= rate * mb / (1 - 0.9 ** t) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1.0)
    keep = w != 0
    return Model(known[keep], w[keep], b)


def train(docs: DataFrame, labels: DataFrame, n: int = TRAIN_DOCS) -> Model:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden()
        for batch in batches:
            for part, data, offsets in slices(batch):
                h, _, _, rows, sentence = sentence_words(data, offsets)
                cut = np.searchsorted(rows, np.arange(part.num_rows + 1))
                keep = [k for k in range(part.num_rows) if cut[k + 1] - cut[k] <= TRAIN_WORDS]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(keep, pa.int64())), part.column(1).take(pa.array(keep, pa.int64())),
                    pa.array([h[cut[k]:cut[k + 1]].tobytes() for k in keep], pa.binary()),
                    pa.array([sentence[cut[k]:cut[k + 1]].astype(np.int32).tobytes() for k in keep], pa.binary())],
                    names=["doc_id", "label", "words", "sentences"])

    sample = training_sample(docs, labelled(labels, "toxic"), n)
    rows = sample.mapInArrow(features, "doc_id long, label int, words binary, sentences binary").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    # The numbers of the sample are views of its buffers, which the fit needs no copy of.
    return fit([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("words")],
               [np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("sentences")], rows.column("label").to_numpy())


def document_hazard(hazard: np.ndarray, offending: np.ndarray, first: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """-log of no toxic sentence for each of ``n`` rows, from that of each sentence, its first word and the words' rows.

    Sentences that do not offend by themselves add up over two neighbouring halves of ``TRAIN_WORDS`` words at most.
    """
    half = TRAIN_WORDS // 2
    begin = np.searchsorted(rows, np.arange(n + 1))
    base = np.concatenate([[0], np.cumsum(-(-np.diff(begin) // half))])
    row = rows[first]
    total = np.bincount(row, np.where(offending, hazard, 0.0), n)
    weak = np.bincount(base[row] + (first - begin[row]) // half, np.where(offending, 0.0, hazard), int(base[-1]))
    owner = np.repeat(np.arange(n), np.diff(base))
    both = weak.astype(float)
    both[:-1] += np.where(owner[1:] == owner[:-1], weak[1:], 0.0)
    worst = np.zeros(n)
    np.maximum.at(worst, owner, both)
    return total + worst


def score(docs: DataFrame, model: Model, score: str = "score", spans: str | None = "offending") -> DataFrame:
    """``docs`` with the document's probability and, under ``spans``, its sentences of 0.5 or more.

    A span has the byte offsets of the sentence's words in the UTF-8 text and its probability.
    """
    kind = "array<struct<start:long,stop:long,score:double>>"
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    schema = schema.add(spans, T.DataType.fromDDL(kind)) if spans else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden()
        for batch in batches:
            for part, data, offsets in slices(batch):
                h, starts, ends, rows, sentence = sentence_words(data, offsets)
                n = int(sentence[-1]) + 1 if len(sentence) else 0
                first = np.searchsorted(sentence, np.arange(n))
                z, row = model.logits(h, sentence, n), rows[first]
                p = 1 - np.exp(-document_hazard(np.logaddexp(0, z), z >= 0, first, rows, part.num_rows))
                if model.prior is not None:
                    p, z = np.where(np.diff(offsets) > 0, model.prior, 0.0), np.full(n, -np.inf)
                columns = {score: pa.array(p)}
                if spans:
                    found = np.flatnonzero(z >= 0)
                    last = np.append(first[1:], len(sentence)) - 1
                    flat = pa.StructArray.from_arrays([
                        pa.array(starts[first[found]] - offsets[row[found]]), pa.array(ends[last[found]] - offsets[row[found]]),
                        pa.array(1 / (1 + np.exp(-z[found])))], names=["start", "stop", "score"])
                    columns[spans] = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[found], np.arange(part.num_rows + 1)), pa.int32()), flat)
                yield with_columns(part, **columns)

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
