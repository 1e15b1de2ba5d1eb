"""Best-fit packing of token sequences, by hierarchical rounds over what is left over.

Every map task encodes its documents, cuts those longer than a sequence, and packs its pieces best-fit,
longest first: each goes to the fullest sequence it still fits. Sequences that are full, or nearly,
are finished there. The underfull ones go up as single items: rounds group them (a bounded number to a
task), pack the items of a group best-fit again, and pass on what is still underfull, until one
group holds all or a round finds no more to merge. A document's pieces never move apart; a merged
sequence is its items behind each other, so offsets add up along the rounds.

Defined cases: a null or empty text is its end id alone; rows that repeat or share a doc_id (or have none)
are packed each for itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medwright.llm.common import in_few, slices, table, written
from medwright.llm.encoding import REMEMBERED, encoder

CAPACITY = 2048
END_ID = 0
#: A sequence with at most so many places left is finished in the round that packed it.
NEARLY_FULL = 8
#: Pieces that a map task packs at a time, and underfull sequences to a task of a later round.
LOCAL_PIECES = 200_000
GROUP_ITEMS = 50_000


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each item, and how full each bin is."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by places left
    left: list[int] = []  # the numbers of places left that occur, ascending
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(left, n)
        if at < len(left):
            room = left[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                left.pop(at)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            if not open_bins[room - n]:
                insort(left, room - n)
            open_bins[room - n].append(b)
    return bins, offsets, np.array(fill, np.int64)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin_id long, bin_offset long, bin_fill long"


def _pack_local(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, remembered: int) -> DataFrame:
    """Pieces of all documents with the sequence their own task packed them into; bin_id is unique to the task's attempt."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        made, pieces = 0, []

        def pack() -> pa.RecordBatch:
            nonlocal made, pieces
            bins, offsets, fill = best_fit(np.array([p[3] for p in pieces], np.int64), capacity)
            columns = [*map(list, zip(*pieces)), bins + base + made, offsets, fill[bins]]
            made += len(fill)
            pieces = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)],
                                              names=[x.split()[0] for x in _PIECES.split(", ")])

        for batch in batches:
            for part, _, _ in slices(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(vocabulary, remembered).encode(part.column(1).to_pylist())):
                    ids += end
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[i:i + 4 * capacity]
                        pieces.append((doc_id, k, i // 4, len(piece) // 4, zlib.crc32(piece)))
                if len(pieces) >= LOCAL_PIECES:
                    yield pack()
        if pieces:
            yield pack()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def _merge(bins: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """One round: bin_id, the sequence it becomes part of, its offset there, and that sequence's fill."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held or not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held).sort_by("bin_id")
        ids, fills = t.column("bin_id").to_numpy(), t.column("bin_fill").to_numpy()
        into, offsets, fill = best_fit(fills, capacity)
        first = np.zeros(len(fill), np.int64)  # a merged sequence is named after its longest item
        order = np.argsort(-fills, kind="stable")[::-1]
        first[into[order]] = ids[order]
        for i in range(0, len(ids), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array(first[into[s]]), pa.array(offsets[s]), pa.array(fill[into[s]])], names=["bin_id", "parent", "shift", "fill"])

    # Items are dealt by a hash that differs from round to round.
    dealt = bins.withColumn("g", F.pmod(F.xxhash64("bin_id", F.lit(level)), F.lit(groups))).repartition(groups, "g").drop("g")
    return dealt.mapInArrow(run, "bin_id long, parent long, shift long, fill long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``remembered``: words of each half of a worker's memory; fewer take time, not results.
    """
    pieces = written(_pack_local(docs, vocabulary, capacity, end_id, remembered), "pack-pieces")
    names = ["bin_id", "bin_fill"]
    underfull = pieces.filter(F.col("bin_fill") < capacity - NEARLY_FULL).groupBy("bin_id").agg(F.first("bin_fill").alias("bin_fill")).select(names)
    moves, level = None, 0
    first = count = underfull.count()
    while count > 1:
        groups = -(-count // GROUP_ITEMS)
        step = written(_merge(underfull, groups, capacity, level), "pack-round", count)
        moves = step if moves is None else written(_follow(moves, step), "pack-moves", first)
        underfull = step.filter(F.col("fill") < capacity - NEARLY_FULL).groupBy(F.col("parent").alias("bin_id")).agg(F.first("fill").alias("bin_fill")).select(names)
        after, level = underfull.count(), level + 1
        # All in one group: best fit has said its last word. Else go on while rounds still merge.
        if groups == 1 or after > 0.98 * count:
            break
        count = after
    if moves is None:
        moved = pieces.select("*", F.col("bin_id").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    else:
        to = moves.select("bin_id", "parent", "shift").hint("merge")
        moved = (pieces.join(to, "bin_id", "left").withColumn("sequence_id", F.coalesce("parent", "bin_id"))
                 .withColumn("offset", F.col("bin_offset") + F.coalesce("shift", F.lit(0))))
    return in_few(moved.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), pieces.count())


def _follow(moves: DataFrame, step: DataFrame) -> DataFrame:
    """Moves of earlier rounds, carried on by the next one."""
    nxt = step.select(F.col("bin_id").alias("parent"), F.col("parent").alias("p2"), F.col("shift").alias("s2"), F.col("fill").alias("f2")).hint("merge")
    return moves.join(nxt, "parent", "left").select("bin_id", F.coalesce("p2", "parent").alias("parent"), (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift"), F.coalesce("f2", "fill").alias("fill"))


def op10_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
