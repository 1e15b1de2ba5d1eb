"""Benchmark decontamination by latent semantic retrieval.

Document frequencies of hashed words come from all documents. The benchmark's passages become TF-IDF rows,
and a distributed randomised SVD of them (a random projection, one power iteration, each a Spark job that
sums per block of features) gives latent spaces: items are dealt to blocks of about ``BLOCK_PASSAGES`` passages, half as many
again as a space has dimensions, so that a space keeps most of every passage however large the benchmark is. Only the features that a
block's items have are numbered, sent and gathered. Every passage of every document (overlapping windows of 40 words) is
projected into each space, and items whose passages reach a cosine of ``COSINE`` are candidates; the window counts as
no longer than the passage, so that what surrounds a short item does not hide it, and a passage of which the space
keeps little (one of a very long item) asks for ``SHARE`` of what it keeps, so that a verbatim copy always passes. A candidate is
confirmed on the words themselves: the longest common subsequence of the item and the words around the
passage must cover ``LCS`` of the item, and its answer words (the rarest quarter of its words) must be
present to ``ANSWER``. Reordered or reworded passages pass the first test and are judged by the other two.

One scan of the documents serves ``SPACES`` blocks; a benchmark of more takes more scans, each over the table the one before has written.

Words are runs of letters and digits in lower case. Defined cases: null or empty texts hold no passage and
are clean; items of fewer than ``LEAST_WORDS`` words are found where their words stand as one run, and only there (cosine,
lcs and answer are 1); items without a word or without an item_id are not searched, as nothing could be found or named; every word weighs something, so that an item
which most documents hold is found in all of them; items that
repeat are one item, under the smallest item_id; hits of equal lcs and cosine rank by item_id; rows that repeat are
searched each for itself; texts and items of any length are taken whole, window by window; without documents or items nothing is contaminated; extra
columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medwright.llm.common import LETTERS, hash_spans, lowered, mix, release, slices, table, unburden, words_of, written

FEATURES = 1 << 16
RANK = 192
STRIDE = 20  # words of half a window
COSINE = 0.3
#: The least share of what the space keeps of a passage that a window has to reach, where that is less than ``COSINE``.
SHARE = 2 / 3
LCS = 0.6
ANSWER = 0.5
LEAST_WORDS = 8
#: Passages of the items of a space, on average.
BLOCK_PASSAGES = 288
#: Spaces searched in one scan of the documents: some 50 MB that every task holds.
SPACES = 16
_FEATURE_BLOCK = 1024

_HITS = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:double>>"


def passage_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, and its row and its number in the row."""
    data = lowered(data)
    starts, ends, rows = words_of(data, offsets, LETTERS)
    return hash_spans(data, starts, ends), rows, np.arange(len(rows)) - np.searchsorted(rows, rows)


def _features(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(FEATURES - 1)).astype(np.int64)


def cells_of(words: np.ndarray, rows: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half windows: of each word its cell, the first cell of each row (n + 1 numbers), and whether the word counts.

    A word that repeats the one before it does not count, so that a stuttering text is no match for all that holds the word.
    """
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(-(-count // STRIDE))])
    repeats = np.zeros(len(words), bool)
    repeats[1:] = (words[1:] == words[:-1]) & (place[1:] % STRIDE > 0)
    return first[rows] + place // STRIDE, first, ~repeats


def idf_of(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every feature over all documents; never 0, as an item may stand in most of them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden()
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for part, data, offsets in slices(batch):
                words, rows, _ = passage_words(data, offsets)
                pairs = np.sort((rows * FEATURES + _features(words)).astype(np.uint32 if part.num_rows < 1 << 16 else np.uint64))
                pairs = pairs[np.diff(pairs, prepend=pairs[:1] + 1) != 0]
                df[:-1] += np.bincount((pairs & (FEATURES - 1)).astype(np.int64), minlength=FEATURES)
                df[-1] += part.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["feature", "df"])

    total = docs.select("text").mapInArrow(count, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(FEATURES + 1)
    df[total.column("feature").to_numpy()] = total.column("df").to_numpy()
    return np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.05


def passages_of(words: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """TF-IDF windows of one text's words: features, their weights (of length 1 together), and the length before that."""
    cell, first, counts = cells_of(words, np.zeros(len(words), np.int64), np.arange(len(words)), 1)
    f, cell = _features(words)[counts], cell[counts]
    out = []
    for c in range(max(1, int(first[1]) - 1)):
        some, tf = np.unique(f[np.searchsorted(cell, c):np.searchsorted(cell, c + 2)], return_counts=True)
        weight = tf * idf[some]
        size = float(np.linalg.norm(weight))
        out.append((some, weight / max(size, 1e-9), size))
    return out


@dataclass
class Space:
    """The latent space of a block of items: idf, of each feature its row in ``basis`` (-1: none), and the items."""

    idf: np.ndarray
    place: np.ndarray
    basis: np.ndarray  # (features of the block's items, dimensions)
    weighted: np.ndarray  # basis times idf
    item_ids: list[int]
    item_words: list[np.ndarray]
    answers: list[np.ndarray]
    passages: np.ndarray  # (passages, dimensions), of length 1
    owner: np.ndarray  # item of each passage
    sizes: np.ndarray  # length of each passage's TF-IDF row
    least: np.ndarray  # cosine that makes a candidate of it
    #: Of each length below LEAST_WORDS the hashes of the items' whole runs of words, sorted, and their items.
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each word on (the last n - 1 words begin no run)."""
    if len(words) < n:
        return words[:0]
    out = words[:len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out) + words[k:len(words) - n + 1 + k]
    return out


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return passage_words(raw, np.array([0, len(raw)]))[0]


def _svd(items: DataFrame, idf: np.ndarray, places: dict[int, np.ndarray], rank: int) -> dict[int, np.ndarray]:
    """Right singular vectors of each block's TF-IDF passages, by randomised subspace iteration.

    ``items`` has block and text, ``places`` numbers each block's features. A job sends the current
    bases to the passages and sums A'(A X) per block of features, for all blocks of items at once.
    """
    sizes = {b: int(place.max()) + 1 for b, place in places.items()}
    kind = "block int, rows int, part binary"

    def parts(total: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], pa.int32()) for i in range(2)] + [pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                          names=["block", "rows", "part"])

    def product(bases: dict[int, np.ndarray] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, total = dict(bases or {}), {}
            for batch in batches:
                for b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = _words(text)
                    if not len(words):
                        continue
                    if b not in x:
                        x[b] = np.random.default_rng(3).standard_normal((sizes[b], rank), np.float32)
                    if b not in total:
                        total[b] = np.zeros((sizes[b], x[b].shape[1]), np.float32)
                    for f, weight, _ in passages_of(words, idf):
                        own, weight = places[b][f], weight.astype(np.float32)
                        total[b][own] += np.outer(weight, weight @ x[b][own])
            for b, sums in total.items():
                yield parts({(b, i): sums[i:i + _FEATURE_BLOCK] for i in range(0, len(sums), _FEATURE_BLOCK)})
        return run

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = np.frombuffer(part.as_buffer(), np.float32)
                total[b, i] = total[b, i] + part if (b, i) in total else part
        yield parts(total)

    bases = None
    for _ in range(3):
        sums = items.mapInArrow(product(bases), kind).repartition(8, "block", "rows").mapInArrow(add, kind).toArrow()
        found: dict[int, dict[int, np.ndarray]] = {}
        for b, i, part in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), sums.column(2)):
            found.setdefault(b, {})[i] = np.frombuffer(part.as_buffer(), np.float32)
        bases = {}
        for b, own in found.items():
            y = np.concatenate([own[i] for i in sorted(own)]).reshape(sizes[b], -1)
            left, values, _ = np.linalg.svd(y, full_matrices=False)
            bases[b] = np.ascontiguousarray(left[:, values > values[0] * 1e-5])
    return bases


def latent_spaces(items: DataFrame, idf: np.ndarray, rank: int = RANK) -> list[Space]:
    """The spaces of the blocks of ``items`` (block, item_id, text); their items are read to the driver, block by block few."""
    read: dict[int, list[tuple[int, np.ndarray]]] = {}
    for row in sorted(items.select("block", "item_id", "text").collect()):
        read.setdefault(row.block, []).append((row.item_id, _words(row.text)))
    places = {}
    for b, own in read.items():
        used = np.unique(np.concatenate([_features(words) for _, words in own]))
        if len(used):
            places[b] = np.full(FEATURES, -1, np.int32)
            places[b][used] = np.arange(len(used))
    bases = _svd(items.select(F.col("block").cast("int"), "text"), idf, places, rank) if places else {}
    return [_space(read[b], idf, places[b], bases[b]) for b in places]


def _space(items: list[tuple[int, np.ndarray]], idf: np.ndarray, place: np.ndarray, basis: np.ndarray) -> Space:
    item_ids, item_words, answers, passages, owner, sizes = [], [], [], [], [], []
    runs: dict[int, list[tuple[int, int]]] = {}
    for item_id, words in items:
        if not len(words):
            continue
        if len(words) < LEAST_WORDS:
            runs.setdefault(len(words), []).append((int(run_hashes(words, len(words))[0]), len(item_ids)))
            answers.append(words)
        else:
            for f, weight, size in passages_of(words, idf):
                passages.append(weight @ basis[place[f]])
                owner.append(len(item_ids))
                sizes.append(size)
            distinct = np.unique(words)
            weight = idf[_features(distinct)]
            answers.append(distinct[np.argsort(-weight, kind="stable")][:max(2, len(distinct) // 4)])
        item_ids.append(item_id)
        item_words.append(words)
    latent = np.array(passages, np.float32).reshape(len(passages), basis.shape[1])
    kept = np.linalg.norm(latent, axis=1)
    sorted_runs = {}
    for n, own in runs.items():
        own.sort()
        sorted_runs[n] = np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own])
    return Space(idf, place, basis, basis * idf[place >= 0].astype(np.float32)[:, None], item_ids, item_words, answers,
                 latent / np.maximum(kept, 1e-9)[:, None], np.array(owner, np.int64), np.array(sizes, np.float32),
                 np.minimum(COSINE, SHARE * kept).astype(np.float32), sorted_runs)


def latent_space(docs: DataFrame, items: DataFrame, rank: int = RANK) -> Space:
    """One space for all of ``items`` (item_id, text)."""
    (space,) = latent_spaces(items.withColumn("block", F.lit(0)), idf_of(docs), rank)
    return space


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        m = row & masks.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def _sums(basis: np.ndarray, place: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """Sum of basis rows per cell. The j-th words of many cells are added at once, the fullest cells first."""
    out = np.zeros((cells, basis.shape[1]), np.float32)
    if not len(place):
        return out
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    counts = np.diff(begin, append=len(cell))
    order = np.argsort(-counts, kind="stable")
    for i in range(0, len(order), 512):
        some = order[i:i + 512]
        held = np.zeros((len(some), basis.shape[1]), np.float32)
        for j in range(int(counts[some[0]])):
            m = int(np.searchsorted(-counts[some], -j, side="left"))  # cells of more than j words
            held[:m] += basis.take(place[begin[some[:m]] + j], axis=0)
        out[cell[begin[some]]] = held
    return out


def search(words: np.ndarray, rows: np.ndarray, place: np.ndarray, n: int, *spaces: Space) -> list[list[dict]]:
    """Confirmed items of each of ``n`` rows, the best first."""
    hits: list[list[dict]] = [[] for _ in range(n)]
    if not len(words) or not spaces:
        return hits
    cell, first, counts = cells_of(words, rows, place, n)
    f = _features(words)
    weight = np.where(counts, spaces[0].idf[f], 0)
    last = np.zeros(int(first[-1]), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    norm = np.bincount(cell, weight * weight, len(last))
    norm[:-1] += np.where(last[:-1], 0, norm[1:])
    length = np.sqrt(np.maximum(norm, 1e-9)).astype(np.float32)
    starts = np.searchsorted(rows, np.arange(n + 1))
    for space in spaces:
        for row, found in _confirmed(_candidates(space, f, cell, counts, first, last, length), words, starts, space).items():
            hits[row] += found.values()
        for row, item in _short_items(words, rows, space):
            hits[row].append({"item_id": space.item_ids[item], "cosine": 1.0, "lcs": 1.0, "answer": 1.0})
    return [sorted(h, key=_best_first) for h in hits]


def _best_first(hit: dict) -> tuple:
    return -hit["lcs"], -hit["cosine"], hit["item_id"]


def _candidates(space: Space, f: np.ndarray, cell: np.ndarray, counts: np.ndarray, first: np.ndarray, last: np.ndarray,
                length: np.ndarray) -> dict[tuple[int, int], list[tuple[int, float]]]:
    """Of each row and item the windows (number in the row, cosine) that reach the item in the space."""
    found: dict[tuple[int, int], list] = {}
    if not len(space.passages):
        return found
    known = np.flatnonzero((space.place[f] >= 0) & counts)
    window = _sums(space.weighted, space.place[f[known]], cell[known], len(last))
    window[:-1] += np.where(last[:-1, None], 0, window[1:])
    # No product with a passage is longer than the window's projection, so most windows need none.
    long_enough = np.flatnonzero(np.linalg.norm(window, axis=1) >= space.least.min() * np.minimum(length, space.sizes.min()) * (1 - 1e-5))
    for i in range(0, len(long_enough), 4096):
        some = long_enough[i:i + 4096]
        for k in range(0, len(space.passages), 4096):
            dot = window[some] @ space.passages[k:k + 4096].T
            near = dot >= space.least[k:k + 4096] * np.minimum(length[some, None], space.sizes[k:k + 4096]) * (1 - 1e-5)
            hit = np.flatnonzero(near.any(1))
            if not len(hit):
                continue
            items, begin = np.unique(space.owner[k:k + 4096], return_index=True)  # an item's passages stand together
            at = some[hit]
            best = np.maximum.reduceat(np.where(near[hit], dot[hit] / length[at, None], -1), begin, axis=1)
            row = np.searchsorted(first, at, side="right") - 1
            c, item = np.nonzero(best >= 0)
            for key, place, cosine in zip(zip(row[c].tolist(), items[item].tolist()), (at - first[row])[c].tolist(), best[c, item].tolist()):
                found.setdefault(key, []).append((place, cosine))
    return found


def _confirmed(candidates: dict[tuple[int, int], list[tuple[int, float]]], words: np.ndarray, starts: np.ndarray, space: Space) -> dict[int, dict[int, dict]]:
    """The candidates whose words are there: of each row the items and their best figures."""
    hits: dict[int, dict[int, dict]] = {}
    for (row, item), places in candidates.items():
        a = space.item_words[item]
        text = words[starts[row]:starts[row + 1]]
        for at, end, cosine in _runs(sorted(places), len(a)):
            region = text[max(0, at * STRIDE - len(a)):(end + 2) * STRIDE + len(a)]
            answer = float(np.isin(space.answers[item], region).mean())
            lcs = lcs_length(a, region) / len(a) if answer >= ANSWER else 0.0
            own = hits.setdefault(row, {})
            if lcs >= LCS and (item not in own or lcs > own[item]["lcs"]):
                own[item] = {"item_id": space.item_ids[item], "cosine": min(1.0, cosine), "lcs": lcs, "answer": answer}
    return hits


def _short_items(words: np.ndarray, rows: np.ndarray, space: Space) -> Iterator[tuple[int, int]]:
    """Row and item where all words of a short item stand as one run."""
    for size, (keys, owner) in space.runs.items():
        run = run_hashes(words, size)
        at = np.searchsorted(keys, run)
        same = np.flatnonzero((keys[np.minimum(at, len(keys) - 1)] == run) & (rows[:len(run)] == rows[len(words) - len(run):]))
        for row, k in np.unique(np.stack([rows[same], at[same]], 1), axis=0).tolist():
            for item in owner[k:np.searchsorted(keys, keys[k], side="right")].tolist():  # texts that differ in case or marks share a run
                yield row, item


def _runs(places: list[tuple[int, float]], length: int) -> Iterator[tuple[int, int, float]]:
    """Neighbouring candidate windows as one stretch, but none much longer than the item."""
    at, end, best = places[0][0], places[0][0], places[0][1]
    for p, c in places[1:]:
        if p - end <= 1 and (p - at) * STRIDE <= 2 * length:
            end, best = p, max(best, c)
        else:
            yield at, end, best
            at, end, best = p, p, c
    yield at, end, best


def find_leaks(docs: DataFrame, benchmark: DataFrame, hits: str = "hits") -> DataFrame:
    """``docs`` with the benchmark items that each text holds, under ``hits``, the best first."""
    items = (benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
             .groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id")))
    words = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    passages = items.agg(F.sum(F.greatest(F.lit(1), F.ceil(words / STRIDE) - 1)).alias("n")).first().n or 0
    blocks = max(1, -(-int(passages) // BLOCK_PASSAGES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    idf = idf_of(docs)
    out = docs.withColumn(hits, F.array().cast(_HITS))
    for b in range(0, blocks, SPACES):
        if b:
            before, out = out, written(out, "leaks")
            release(docs.sparkSession, before)
        out = _search_all(out, latent_spaces(dealt.filter(F.col("block").between(b, b + SPACES - 1)), idf), hits)
    return out


def _search_all(docs: DataFrame, spaces: list[Space], hits: str) -> DataFrame:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
    slim = [replace(space, basis=space.basis[:0]) for space in spaces]  # a search only needs the weighted one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden()
        for batch in batches:
            at = batch.schema.get_field_index(hits)
            for part, data, offsets in slices(batch):
                new = search(*passage_words(data, offsets), part.num_rows, *slim)
                both = [sorted(a + b, key=_best_first) if a and b else a or b for a, b in zip(part.column(at).to_pylist(), new)]
                yield part.set_column(at, hits, pa.array(both, kind))

    return docs.mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it holds a benchmark item, the best item and its figures, and all items."""
    out = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = F.try_element_at("hits", F.lit(1))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), best["item_id"].alias("item_id"), best["cosine"].alias("cosine"),
                      best["lcs"].alias("lcs"), best["answer"].alias("answer"), F.col("hits")["item_id"].alias("item_ids"))
