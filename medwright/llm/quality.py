"""Quality classifier: a byte-level convolutional network over overlapping chunks of the whole document.

Filters of six bytes run over the raw UTF-8. A chunk is 512 bytes, and chunks overlap by half: each is the
maximum of two neighbouring blocks of 256. A document is described by the maximum and by the mean of its
chunks' filter maxima (the mean of maxima falls where a text keeps repeating itself), which a small
hidden layer combines into one probability.

Fitting reads a bounded sample: the ``TRAIN_DOCS`` labelled training rows of at most ``TRAIN_BYTES`` bytes
with the least hash of doc_id. Scoring reads every whole text.

Defined cases: a null or empty text is scored as one block of padding; labels that repeat count as good if one row
says so; without labels, or with one class only, every score is the share of good labels (0.5 without
labels); extra columns stay as they are; an empty table gives an empty result. Rows that repeat are scored each
for itself, and where their doc_id is in the training sample each of them is learnt from. Equal scores are not
ranked. A text of any length is scored whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwright.llm.bytecnn import Adam, Filters, filter_gradient, join_rows, lay_out, minibatches, pooled, pooled_at
from medwright.llm.common import held_out, labelled, slices, table, training_sample, utf8, with_columns

TRAIN_DOCS = 4000
TRAIN_BYTES = 32768
FILTERS = {6: 16}
HIDDEN = 8


def describe(blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum and mean over each document's chunks; also the chunks and each document's first one."""
    last = first[1:] - 1
    chunks = blocks.copy()
    chunks[:-1] = np.maximum(blocks[:-1], blocks[1:])
    chunks[last] = blocks[last]  # a document's last block begins no chunk of its own ...
    whole = np.ones(len(blocks), bool)
    whole[last[np.diff(first) > 1]] = False  # ... unless it is the only one
    chunks = chunks[whole]
    starts = (np.cumsum(whole) - whole)[first[:-1]]
    counts = np.diff(np.append(starts, len(chunks)))
    return np.concatenate([np.maximum.reduceat(chunks, starts), np.add.reduceat(chunks, starts) / counts[:, None]], axis=1), whole, starts


@dataclass
class Network:
    filters: Filters
    layers: dict[str, np.ndarray]
    prior: float | None = None

    def head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(((x - self.layers["mean"]) / self.layers["scale"]) @ self.layers["w1"] + self.layers["b1"])
        return h, h @ self.layers["w2"] + self.layers["b2"]

    def probabilities(self, tables: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        laid, first = lay_out(data, offsets)
        z = self.head(describe(pooled(tables, laid), first)[0])[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(float)))


def fit(texts: list[np.ndarray], labels: np.ndarray, *, epochs: int = 8, size: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    net = Network(Filters.random(FILTERS, rng), {})
    if not len(labels) or labels.min() == labels.max():
        net.prior = float(labels.mean()) if len(labels) else 0.5
        return net
    width = 2 * sum(FILTERS.values())
    some = rng.permutation(len(texts))[:500]
    laid, first = lay_out(*join_rows([texts[i] for i in some]))
    x = describe(pooled_at(net.filters, laid)[0], first)[0]
    net.layers = {"mean": x.mean(0), "scale": x.std(0) + 0.1, "w1": rng.normal(0, width ** -0.5, (width, HIDDEN)).astype(np.float32),
                  "b1": np.zeros(HIDDEN, np.float32), "w2": rng.normal(0, HIDDEN ** -0.5, HIDDEN).astype(np.float32),
                  "b2": np.full(1, np.log(labels.mean() / (1 - labels.mean())), np.float32)}
    adam = Adam(rate)
    for done, rows in minibatches(len(texts), size, epochs, rng):
        adam.rate = rate * (1 - 0.9 * done)
        laid, first = lay_out(*join_rows([texts[i] for i in rows]))
        blocks, places = pooled_at(net.filters, laid)
        x, whole, starts = describe(blocks, first)
        h, z = net.head(x)
        g = (1 / (1 + np.exp(-z)) - labels[rows]) / len(rows)
        gh = g[:, None] * net.layers["w2"] * (1 - h * h)
        normal = (x - net.layers["mean"]) / net.layers["scale"]
        gx = gh @ net.layers["w1"].T / net.layers["scale"]
        # Back through the mean and the maximum over chunks, then to the block that holds a chunk's maximum.
        begin = np.flatnonzero(whole)
        counts = np.diff(np.append(starts, len(begin)))
        doc = np.repeat(np.arange(len(rows)), counts)
        f = blocks.shape[1]
        alone = np.repeat(np.diff(first) == 1, counts)
        second = np.where(alone, begin, begin + 1)
        from_second = blocks[second] > blocks[begin]
        chunks = np.where(from_second, blocks[second], blocks[begin])
        is_top = chunks == x[doc, :f]
        ties = np.add.reduceat(is_top, starts, axis=0)
        gc = gx[doc, f:] / counts[doc][:, None] + np.where(is_top, gx[doc, :f] / ties[doc], 0)
        slope = np.zeros_like(blocks)
        np.add.at(slope, begin, np.where(from_second, 0, gc))
        np.add.at(slope, second, np.where(from_second, gc, 0))
        named = {**{("f", k): v for k, v in net.filters.weights.items()}, **net.layers}
        adam.step(named, {**{("f", k): v for k, v in filter_gradient(net.filters, laid, places, slope).items()},
                          "w1": normal.T @ gh + 1e-4 * net.layers["w1"], "b1": gh.sum(0), "w2": h.T @ g, "b2": g.sum(keepdims=True)})
    return net


def train(docs: DataFrame, labels: DataFrame, n: int = TRAIN_DOCS) -> Network:
    short = docs.filter(F.octet_length("text") <= TRAIN_BYTES)
    rows = training_sample(short, labelled(labels, "quality"), n).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    data, offsets = utf8(rows.column("text").combine_chunks())
    return fit([data[offsets[i]:offsets[i + 1]] for i in range(rows.num_rows)], rows.column("label").to_numpy())


def score(docs: DataFrame, net: Network, score: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.filters.pair_tables()
        for batch in batches:
            for part, data, offsets in slices(batch):
                yield with_columns(part, **{score: pa.array(net.probabilities(tables, data, offsets), pa.float64())})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
