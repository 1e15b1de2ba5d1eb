"""Language identification: a byte convolutional network over fixed-length windows.

Filters of two, three and four bytes run over the raw UTF-8; a window is a block of 256 bytes. The
filters' maxima in a window give a softmax over the languages of the training rows. A document's
distribution is the softmax of its windows' mean logits, weighted by the bytes each window holds.

Fitting reads a bounded sample: per language about ``TRAIN_DOCS`` of its training rows, picked by a hash of
doc_id, without texts of over ``TRAIN_BYTES`` bytes. Prediction reads every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without a training language every
text is ``und``; one training language only has score 1; extra columns stay as they are; an empty table
gives an empty result. Of equally likely languages the first by name is predicted. Rows that repeat are predicted each for itself;
rows of one doc_id with different languages teach each. A text of any length is read whole, in windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwright.llm.bytecnn import BLOCK, Adam, Filters, filter_gradient, join_rows, lay_out, minibatches, pooled, pooled_at
from medwright.llm.common import held_out, slices, table, texts_of, utf8, with_columns

TRAIN_DOCS = 400
TRAIN_BYTES = 32768
FILTERS = {2: 8, 3: 8, 4: 8}
UNKNOWN = "und"


@dataclass
class Network:
    filters: Filters
    layers: dict[str, np.ndarray]
    languages: list[str]

    def logits(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks - self.layers["mean"]) / self.layers["scale"]) @ self.layers["w"] + self.layers["b"]

    def predict(self, tables: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language of each row, and its probability."""
        laid, first = lay_out(data, offsets)
        held = np.maximum((laid[:-BLOCK] != 0xFF).reshape(-1, BLOCK).sum(1), 1e-9)
        z = np.add.reduceat(self.logits(pooled(tables, laid)) * held[:, None], first[:-1]) / np.add.reduceat(held, first[:-1])[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def fit(texts: list[np.ndarray], labels: list[str], *, epochs: int = 5, size: int = 256, rate: float = 0.02, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    net = Network(Filters.random(FILTERS, rng), {}, languages)
    if not languages:
        return net
    y = np.searchsorted(np.array(languages, object), np.array(labels, object))
    laid, first = lay_out(*join_rows(texts))
    windows = laid[:-BLOCK].reshape(-1, BLOCK)
    target = np.repeat(y, np.diff(first))
    full = (windows != 0xFF).sum(1) >= 8
    windows, target = windows[full], target[full]
    width = sum(FILTERS.values())
    spare = np.full(BLOCK, 0xFF, np.uint8)
    lay = lambda rows: np.concatenate([windows[rows].ravel(), spare])
    x = pooled_at(net.filters, lay(rng.permutation(len(windows))[:2000]))[0] if len(windows) else np.zeros((1, width))
    net.layers = {"mean": x.mean(0), "scale": x.std(0) + 0.1, "w": rng.normal(0, width ** -0.5, (width, len(languages))).astype(np.float32),
                  "b": np.zeros(len(languages), np.float32)}
    adam = Adam(rate)
    for done, rows in minibatches(len(windows), size, epochs, rng):
        adam.rate = rate * (1 - 0.9 * done)
        batch = lay(rows)
        blocks, places = pooled_at(net.filters, batch)
        z = net.logits(blocks)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), target[rows]] -= 1
        p /= len(rows)
        slope = p @ net.layers["w"].T / net.layers["scale"]
        named = {**{("f", k): v for k, v in net.filters.weights.items()}, **net.layers}
        normal = (blocks - net.layers["mean"]) / net.layers["scale"]
        adam.step(named, {**{("f", k): v for k, v in filter_gradient(net.filters, batch, places, slope).items()},
                          "w": normal.T @ p + 1e-4 * net.layers["w"], "b": p.sum(0)})
    return net


def train(docs: DataFrame, n: int = TRAIN_DOCS) -> Network:
    """Learn from text and non-null lang of rows that are not held out.

    A language of c rows gives those whose hashed id falls into n / c of the hash's range: about n.
    """
    known = (docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))
             .select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").alias("label")).distinct())
    share = known.groupBy("label").agg((F.lit(float(n << 20)) / F.count("*")).alias("share"))
    picked = known.join(share, "label").filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < F.col("share")).drop("share")
    rows = texts_of(docs.filter(F.octet_length("text") <= TRAIN_BYTES), picked).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    data, offsets = utf8(rows.column("text").combine_chunks())
    return fit([data[offsets[i]:offsets[i + 1]] for i in range(rows.num_rows)], rows.column("label").to_pylist())


def identify(docs: DataFrame, net: Network, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.filters.pair_tables()
        for batch in batches:
            for part, data, offsets in slices(batch):
                best, p = net.predict(tables, data, offsets) if net.languages else (np.zeros(part.num_rows, int), np.zeros(part.num_rows))
                yield with_columns(part, **{lang: pa.array([net.languages[i] for i in best] if net.languages else [UNKNOWN] * part.num_rows, pa.string()),
                                            score: pa.array(p, pa.float64())})

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return out.withColumn(score, F.when(letters, F.col(score)).otherwise(0.0)).withColumn(lang, F.when(letters, F.col(lang)).otherwise(UNKNOWN))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs)
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
