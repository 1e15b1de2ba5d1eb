"""Language-model scores by a hidden Markov model over words, beside an add-one unigram base.

A text's tokens are its words (A-Z in lower case, cut at white space) and one end. Every word belongs to
a class: each of the ``OWN`` commonest training words is one of its own, the others share ``SHARED``
classes by a hash of their last bytes. The model is P(text) = sum over state paths of the classes'
emissions, times P(word | class), which is add-one within the class with one place for unknown words; so
it is a distribution over all words, seen or not, and its tables have a fixed size however large the
vocabulary grows.

1. Tasks cut their documents into chunks and code each chunk by its own vocabulary; chunks are written.
2. Word counts are summed over the chunks' vocabularies, and come back to each chunk by a join that has
   one row per chunk and distinct word, not one per token.
3. Baum-Welch: each round, tasks run the scaled forward-backward recursion over all training documents
   and add up their expected counts; the counts are summed across partitions per block of classes. The
   first round starts from parameters fitted to a bounded sample (``SAMPLE_DOCS`` documents by hash).
4. The scaled forward recursion gives each document's exact log-likelihood.

Defined cases: a null or empty text is its end token; a null doc_id is never held out; repeated rows are scored each for
itself; without training rows N and V are 0 and the model is its prior; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medwright.llm.common import crc_held_out, release, slices, table, written

STATES = 8
OWN = 16384
SHARED = 2048
#: Rarer words stay in the shared classes, whose mass tells how likely unknown words are.
OWN_COUNT = 3
#: Longer words are never classes of their own, so the table of classes has a fixed size.
OWN_BYTES = 64
ROUNDS = 3
SAMPLE_DOCS = 1500
SAMPLE_ROUNDS = 12
CHUNK_BYTES = 4 << 20
#: Tokens of the documents that go through the recursion together.
BATCH_TOKENS = 150_000
#: Tokens whose moves are summed together.
_MOVE_TOKENS = 32_768
_CLASS_BLOCK = 1024
_PRIOR = 100.0


def words_of_text(text: bytes) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: A-Z, and the white space \\x20 and \\x09-\\x0D."""
    return text.lower().split()


def pack_codes(codes: np.ndarray, distinct: int) -> bytes:
    """Codes below ``distinct`` as byte planes, the low bytes first: three, or four if the codes need them. High planes compress well."""
    planes = np.ascontiguousarray(codes, "<u4").view(np.uint8).reshape(-1, 4).T
    return planes[:3 if distinct <= 1 << 24 else 4].tobytes()


def unpack_codes(packed, n: int) -> np.ndarray:
    """The ``n`` codes (one at least) behind ``pack_codes``."""
    out = np.zeros((n, 4), np.uint8)
    planes = np.frombuffer(packed, np.uint8).reshape(-1, n)
    out[:, :len(planes)] = planes.T
    return out.view("<u4")[:, 0]


def _chunks(modulus: int, remainder: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            lengths = np.array([len(c) for c in coded], np.int64)
            codes = np.concatenate(coded)
            train = np.repeat(~np.array(held), lengths)
            counts = np.bincount(codes[train], minlength=len(vocabulary))
            one = lambda x, t: pa.array([x], pa.list_(t))
            return pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().int >> 65], pa.int64()), one(ids, pa.int64()), one(held, pa.bool_()), one(lengths, pa.int64()),
                pa.array([pack_codes(codes, len(vocabulary))], pa.binary()), one(list(vocabulary), pa.binary()), one(counts, pa.int64())],
                names=["chunk", "doc_ids", "held", "lengths", "codes", "words", "counts"])

        vocabulary = defaultdict(count().__next__)
        ids, held, coded, size = [], [], [], 0
        for batch in batches:
            for part, data, offsets in slices(batch):
                raw = data.tobytes()
                for i, a, b in zip(part.column(0).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                    words = words_of_text(raw[a:b])
                    words.append(b"")  # the end
                    coded.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
                    ids.append(i)
                    held.append(i is not None and crc_held_out(i, modulus, remainder))
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield out()
                    vocabulary = defaultdict(count().__next__)
                    ids, held, coded, size = [], [], [], 0
        if ids:
            yield out()
    return run


_CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<long>, codes binary, words array<binary>, counts array<long>"
_CODED = "doc_ids array<long>, held array<boolean>, lengths array<long>, classes binary, known array<long>, base array<double>, within array<double>"


@dataclass
class Corpus:
    """Documents as class streams, with the sums that don't depend on states; N, V and each class's share."""

    coded: DataFrame
    tokens: int
    distinct: int
    share: np.ndarray


def code(docs: DataFrame, modulus: int, remainder: int) -> Corpus:
    chunks = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunks(modulus, remainder), _CHUNK), "hmm-chunks")
    local = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("chunk", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    total = written(local.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0")
                    .withColumn("class", F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(SHARED)).cast("int") + OWN), "hmm-words")
    top = total.filter((F.octet_length("word") <= OWN_BYTES) & (F.col("c") >= OWN_COUNT)).orderBy(F.desc("c"), "word").limit(OWN).select("word").toArrow().column(0).to_pylist()
    spark = docs.sparkSession
    own = spark.createDataFrame([(w, i) for i, w in enumerate(top)], "word binary, own int")
    total = total.join(F.broadcast(own), "word", "left").select("word", "c", F.coalesce("own", "class").alias("class"))  # OWN rows at most
    share, kinds = np.zeros(OWN + SHARED), np.zeros(OWN + SHARED, np.int64)
    for r in total.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow().to_pylist():
        share[r["class"]], kinds[r["class"]] = r["c"], r["v"]
    n, v = int(share.sum()), int(kinds.sum())
    # Back to the chunks: a row per chunk and distinct word. Words without a count have the class of their last bytes.
    found = (local.select("chunk", "place", "word").join(total.hint("merge"), "word", "left")
             .select("chunk", "place", F.coalesce("c", F.lit(0)).alias("c"),
                     F.coalesce("class", F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(SHARED)).cast("int") + OWN).alias("class"))
             .groupBy("chunk").agg(F.collect_list(F.struct("place", "c", "class")).alias("found")))
    alone = np.arange(OWN + SHARED) < len(top)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, r=row, b=batch: b.column(b.schema.get_field_index(name))[r]
                f = get("found").values
                place = f.field("place").to_numpy()
                c, kind = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                c[place], kind[place] = f.field("c").to_numpy(), f.field("class").to_numpy()
                lengths = get("lengths").values.to_numpy()
                codes = unpack_codes(get("codes").as_buffer(), int(lengths.sum()))
                at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                with np.errstate(divide="ignore"):
                    base = np.log10((c + 1) / (n + v + 1))
                    within = np.where(alone[kind], 0.0, np.log10((c + 1) / (share[kind] + kinds[kind] + 1)))
                one = lambda x, t: pa.array([x], pa.list_(t))
                yield pa.RecordBatch.from_arrays([
                    one(get("doc_ids").as_py(), pa.int64()), one(get("held").as_py(), pa.bool_()), one(lengths, pa.int64()), pa.array([kind[codes].astype("<u2").tobytes()], pa.binary()),
                    one(np.add.reduceat((c > 0).astype(np.int64)[codes], at), pa.int64()),
                    one(np.add.reduceat(base[codes], at), pa.float64()), one(np.add.reduceat(within[codes], at), pa.float64())],
                    names=[x.split()[0] for x in _CODED.split(", ")])

    coded = written(chunks.select("chunk", "doc_ids", "held", "lengths", "codes").join(found.hint("merge"), "chunk").drop("chunk").mapInArrow(apply, _CODED), "hmm-coded")
    release(spark, chunks)
    # Unknown words may fall into any shared class; classes for words of their own that no word fills get nothing.
    share = share + np.where(np.arange(OWN + SHARED) < OWN, 0.0, 0.1)
    return Corpus(coded, n, v, share / share.sum())


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
        """Expected counts to parameters; every class keeps its share of a small prior."""
        start, move = start + 0.1, move + 0.1
        emit = emit + _PRIOR * share[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def random(cls, share: np.ndarray, states: int, rng: np.random.Generator) -> Model:
        emit = share[:, None] * np.exp(rng.normal(0, 0.7, (len(share), states)))
        move = np.full((states, states), 0.05 / max(states - 1, 1)) + np.eye(states) * 0.95
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def batches_of(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Documents longest first, cut into batches of about BATCH_TOKENS tokens."""
    order = np.argsort(-lengths, kind="stable")
    part = np.cumsum(lengths[order]) // BATCH_TOKENS
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1)


def _steps(classes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes by time, then by document (longest first): the stream, and where each time begins."""
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")  # documents longer than t
    begin = np.concatenate([[0], np.cumsum(active)])
    t = np.repeat(np.arange(len(active)), active)
    return classes[first[np.arange(int(begin[-1])) - begin[t]] + t], begin


def forward(model: Model, stream: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables of every token, and the scale of each."""
    alpha = model.emit.take(stream, axis=0)
    scale = np.empty(len(stream))
    ahead, ones = np.empty((int(begin[1]), alpha.shape[1])), np.ones(alpha.shape[1])
    before = None
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        now, s = alpha[a:b], scale[a:b]
        if before is None:
            now *= model.start
        else:
            now *= np.matmul(before[:b - a], model.move, out=ahead[:b - a])
        np.matmul(now, ones, out=s)
        now /= s[:, None]
        before = now
    return alpha, scale


def log10_likelihood(scale: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    doc = np.arange(len(scale)) - np.repeat(begin[:-1], np.diff(begin))
    return np.bincount(doc, np.log10(scale), n)


def expected_counts(model: Model, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, moves, emissions) of some documents, and their log10 likelihood."""
    k = len(model.start)
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit), 0.0
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for rows in batches_of(lengths) if len(lengths) else ():
        stream, begin = _steps(classes, first[rows], lengths[rows])
        alpha, scale = forward(model, stream, begin)
        total += float(np.log10(scale).sum())
        # Backwards, in place: ``beta``, and emission times beta over the scale of each token.
        ahead = model.emit.take(stream, axis=0)
        ahead /= scale[:, None]
        beta = np.ones_like(alpha)
        back = np.ascontiguousarray(model.move.T)
        steps = list(zip(begin[:-1].tolist(), begin[1:].tolist()))
        later = None
        for a, b in reversed(steps):
            if later is not None:
                np.matmul(later, back, out=beta[a:a + len(later)])
            later = ahead[a:b]
            later *= beta[a:b]
        # The token behind each one that has one stands as far into the next time as it into its own.
        active = np.diff(begin)
        behind = np.arange(int(begin[1]), int(begin[-1]))
        before = behind - np.repeat(active[:-1], active[1:])
        for i in range(0, len(behind), _MOVE_TOKENS):
            move += (alpha[before[i:i + _MOVE_TOKENS]].T @ ahead[behind[i:i + _MOVE_TOKENS]]) * model.move
        beta *= alpha
        start += beta[:int(begin[1])].sum(0)
        for j in range(k):
            emit[:, j] += np.bincount(stream, beta[:, j], len(emit))
    return start, move, emit, total


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, held, lengths and classes of each coded chunk."""
    at = {n: i for i, n in enumerate(batch.schema.names)}
    for r in range(batch.num_rows):
        yield (batch.column(at["doc_ids"])[r].as_py(), batch.column(at["held"])[r].values.to_numpy(zero_copy_only=False),
               batch.column(at["lengths"])[r].values.to_numpy(), np.frombuffer(batch.column(at["classes"])[r].as_buffer(), "<u2"))


def _training(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Classes and lengths of the batch's training documents."""
    parts, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for _, held, lengths, classes in _streams(batch):
        parts.append(classes[np.repeat(~held, lengths)])
        sizes.append(lengths[~held])
    return np.concatenate(parts), np.concatenate(sizes)


def baum_welch(corpus: Corpus, model: Model) -> Model:
    """One round over all training documents."""
    k = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
        for batch in batches:
            for one in range(batch.num_rows):
                a, b, c, _ = expected_counts(model, *_training(batch.slice(one, 1)))
                start, move, emit = start + a, move + b, emit + c
        blocks = {-1: np.concatenate([start, move.ravel()]), **{i: emit[i * _CLASS_BLOCK:(i + 1) * _CLASS_BLOCK] for i in range(-(-len(emit) // _CLASS_BLOCK))}}
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([np.ascontiguousarray(x).tobytes() for x in blocks.values()], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(x.as_buffer(), float)
                total[block] = total[block] + x if block in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    kind = "block int, counts binary"
    parts = corpus.coded.select("doc_ids", "held", "lengths", "classes").mapInArrow(run, kind).repartition(8, "block").mapInArrow(add, kind).toArrow()
    total = {b: np.frombuffer(x.as_buffer(), float) for b, x in zip(parts.column(0).to_pylist(), parts.column(1))}
    if not total:
        return model
    emit = np.concatenate([total[b].reshape(-1, k) for b in sorted(total) if b >= 0])
    return Model.from_counts(total[-1][:k], total[-1][k:].reshape(k, k), emit, corpus.share)


def first_model(corpus: Corpus, states: int = STATES, n: int = SAMPLE_DOCS, rounds: int = SAMPLE_ROUNDS, seed: int = 5) -> Model:
    """Starting point: Baum-Welch from random parameters on about ``n`` training documents, picked by a hash of doc_id."""
    docs = corpus.coded.select(F.sum(F.size("doc_ids"))).first()[0] or 0
    share = n / max(docs, 1)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        for batch in batches:
            for ids, held, lengths, classes in _streams(batch):
                at = np.concatenate([[0], np.cumsum(lengths)])
                some = [j for j, i in enumerate(ids) if not held[j] and lengths[j] <= 4096 and zlib.crc32(f"hmm {i}".encode()) < share * 2 ** 32]
                yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in some], pa.int64()), pa.array([classes[at[j]:at[j + 1]].tobytes() for j in some], pa.binary())], names=["doc_id", "classes"])

    rows = corpus.coded.select("doc_ids", "held", "lengths", "classes").mapInArrow(pick, "doc_id long, classes binary").toArrow().sort_by([("doc_id", "ascending"), ("classes", "ascending")])
    streams = [np.frombuffer(x.as_buffer(), "<u2") for x in rows.column("classes")]
    model = Model.random(corpus.share, states, np.random.default_rng(seed))
    if streams:
        lengths, classes = np.array([len(s) for s in streams]), np.concatenate(streams)
        for _ in range(rounds):
            start, move, emit, _ = expected_counts(model, classes, lengths)
            model = Model.from_counts(start, move, emit, corpus.share)
    return model


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(corpus: Corpus, model: Model) -> DataFrame:
    """Each document's base and model log10 probability."""
    n = corpus.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            for r, (ids, held, lengths, classes) in enumerate(_streams(batch)):
                values = lambda name, r=r: batch.column(at[name])[r].values
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                total = values("within").to_numpy().copy()
                for rows in batches_of(lengths):
                    stream, begin = _steps(classes, first[rows], lengths[rows])
                    total[rows] += log10_likelihood(forward(model, stream, begin)[1], begin, len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(lengths), values("known"),
                                                  pa.array(np.full(len(ids), n)), values("base"), pa.array(total)], names=[x.split()[0] for x in _SCORED.split(", ")])

    return corpus.coded.mapInArrow(run, _SCORED)


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """Train on the rows whose id doesn't fall on ``remainder`` and score every row."""
    corpus = code(docs, modulus, remainder)
    model = first_model(corpus, states)
    for _ in range(rounds):
        model = baum_welch(corpus, model)
    return score(corpus, model)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
