"""Near-duplicates by DartMinHash over word shingles.

A document is the set of its five-word shingles (words are cut at white space and put in lower case);
an element may also carry a weight. Every element owns a region, its weight times an axis of ranks, into which
darts fall as a Poisson process that depends on the element's hash alone. Each dart names one of the
signature's coordinates, and a coordinate keeps its earliest dart: two documents agree on a coordinate with the
probability of their (weighted) Jaccard similarity. Only ranks low enough to fill all coordinates are
generated, so a signature costs little more than a pass over the elements.

1. Documents with equal shingle sets collapse to the one with the least doc_id, so copies cost nothing below.
2. Bands of ``ROWS`` coordinates are joined. In a bucket nobody is paired with everybody: the members are compared with
   the least one, links are gathered into components, and only buckets that still hold several components go on.
   There members outside the largest component are compared with those of other components, as far as
   sizes and the triangle inequality (Jaccard distance is a metric, and the distances from the least member are known)
   leave a link possible, and leave the bucket; some in the first round, eight times as many in each next one. So every pair of a bucket is compared, or
   ruled out, or already in one component, and a large group of copies costs about one comparison a member.
   Copies that strayed too far from a text to be linked to it would still meet one another. So the members of crowded
   buckets are first told apart by their rare shingles, which at most ``RARE`` of them hold: pairs that share one are found by it.
   All other pairs share common shingles at most, and a member with too few of these for any partner of the bucket leaves it; the one
   with the largest share of them, which the others were made from or are close to, is compared with the rest.
3. A comparison is exact: the Jaccard similarity of both sets of 32-bit shingle hashes.
4. Components come from alternating large-star and small-star steps.

A pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS: 3e-5 at 0.8.

Defined cases: a text of one to four words has one shingle, all its words; a null or empty text has none and is
a class of its own; a null doc_id is compared with nothing and has no class; rows that share a doc_id are one
document; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medwright.llm.common import hash_spans, lowered, mix, release, slices, table, unburden, words_of, written

WORDS = 5
SIMILARITY = 0.8
ROWS = 4
BANDS = 20
#: Members of a bucket outside its largest component that are compared in the first later round.
CENTRES = 32
#: A bucket is crowded if it has more pairs than this between its largest component and the other ones' members.
CROWD = 1024
#: Members of crowded buckets that hold a rare shingle, at most.
RARE = 32

_STEP = np.uint64(0x9E3779B97F4A7C15)
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 16.0)])))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def dart_signature(elements: np.ndarray, weights: np.ndarray | None, coordinates: int) -> np.ndarray:
    """The earliest dart of every coordinate, of a set of hashed elements with positive weights (1 by default)."""
    slab = np.zeros(len(elements), np.uint64)
    top = np.ones(len(elements))
    if weights is not None:  # a region is cut into slabs of weight 1, the last one perhaps less
        whole = np.ceil(weights).astype(np.int64)
        top = np.repeat(weights, whole)
        slab = (np.arange(len(top)) - np.repeat(np.cumsum(whole) - whole, whole)).astype(np.uint64)
        elements = np.repeat(elements, whole)
    region = mix(elements + mix(slab + np.uint64(1)))
    total = len(elements) if weights is None else float(np.sum(weights))
    best = np.full(coordinates, np.inf)
    out = np.zeros(coordinates, np.uint64)
    # About k ln k + 2k darts fill k coordinates; ranks below ``end`` hold that many.
    begin, end = 0, max(1, int(np.ceil(coordinates * (np.log(coordinates) + 2) / total)))
    while True:
        cells = np.arange(begin, end, dtype=np.uint64)
        keys = mix(region[:, None] ^ mix(cells + np.uint64(77))[None, :]).ravel()
        darts = np.searchsorted(_POISSON, _uniform(keys))
        at = np.repeat(np.arange(len(keys)), darts)
        nth = (np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(np.uint64)
        dart = mix(keys[at] + (nth + np.uint64(1)) * _STEP)
        rank = begin + at % (end - begin) + _uniform(mix(dart ^ np.uint64(0xA5A5)))
        if weights is not None:
            element = at // (end - begin)
            hit = slab[element] + _uniform(mix(dart ^ np.uint64(0xC3C3))) < top[element]
            dart, rank = dart[hit], rank[hit]
        coordinate = (dart % np.uint64(coordinates)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        now, value = np.full(coordinates, np.inf), np.zeros(coordinates, np.uint64)
        now[coordinate[order]], value[coordinate[order]] = rank[order], dart[order]
        better = now < best
        best[better], out[better] = now[better], value[better]
        if np.isfinite(best).all():
            return out
        begin, end = end, 2 * end


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of all runs of five words; of fewer words, of the whole."""
    if not len(words):
        return words
    n = max(len(words) - WORDS + 1, 1)
    h = np.full(n, len(words[:WORDS]), np.uint64)
    for j in range(min(WORDS, len(words))):
        h = mix(h * _STEP + words[j:j + n])
    return np.unique(h)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows (doc_id, text) with the shingles of each."""
    unburden()
    for batch in batches:
        for part, data, offsets in slices(batch):
            data = lowered(data)
            starts, ends, owner = words_of(data, offsets)
            words = hash_spans(data, starts, ends)
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
            yield part, [shingles(words[cut[i]:cut[i + 1]]) for i in range(part.num_rows)]


_SKETCH = "doc_id long, n int, fp1 long, fp2 long, bands array<long>"


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: size and fingerprints of its shingle set, and its band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for part, sets in _documents(batches):
            fp, keys = [], []
            for s in sets:
                fp.append((int(s.sum().view(np.int64)), int(mix(s ^ np.uint64(3)).sum().view(np.int64))) if len(s) else (0, 0))
                key = salt[:bands if len(s) else 0].copy()
                for column in dart_signature(s, None, bands * rows).reshape(bands, rows).T if len(s) else ():
                    key = mix(key * _STEP + column)
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([f[0] for f in fp], pa.int64()), pa.array([f[1] for f in fp], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32()), pa.array(np.concatenate(keys)))],
                names=[x.split()[0] for x in _SKETCH.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SKETCH)


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and shingle set (sorted uint32) of the documents that ``ids`` names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _documents(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    return wanted.mapInArrow(run, "id long, shingles binary")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the Jaccard similarity of their sets (the highest, where rows share a doc_id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                j[i] = both / max(len(x) + len(y) - both, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j)], names=["a", "b", "similarity"])

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")).hint("merge")
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")).hint("merge")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """id and component (its least id) of every linked node; ``links`` has a and b.

    Large-star: every neighbour above a node is hung on the node's least neighbour. Small-star: a node and its
    neighbours below it are. Rounds repeat until the links no longer change; each is written to the shared folder. No round has more
    links than the one before; ``rows`` is about how many there are at most.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links", rows)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower.hint("merge"), "a")
        new = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "links", rows)
        after = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        release(edges.sparkSession, edges)
        edges = new
        if after == state or not after[0]:
            break
        state = after
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return out.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _shingle_counts(sets: DataFrame, limit: int) -> DataFrame:
    """word, seen (by how many sets of a task) and, of words that no more than ``limit`` hold, those sets: a row per task and shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            word = np.concatenate(words)
            order = np.argsort(word, kind="stable")
            owner = np.repeat(np.array(names, np.int64), [len(w) for w in words])[order]
            word, seen = np.unique(word, return_counts=True)
            few = seen <= limit
            offsets = np.concatenate([[0], np.cumsum(np.where(few, seen, 0))])
            holders = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(owner[np.repeat(few, seen)]), mask=pa.array(~few))
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(seen), holders], names=["word", "seen", "sets"])

        names, words, size = [], [], 0
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                words.append(np.frombuffer(x.as_buffer(), "<i4"))
                names.append(name)
                size += len(words[-1])
                if size >= 1 << 20:
                    yield out()
                    names, words, size = [], [], 0
        if names:
            yield out()

    return sets.select("set", "shingles").mapInArrow(run, "word int, seen long, sets array<long>")


def _rare(sets: DataFrame, similarity: float, limit: int = RARE, *, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``common``: id, m and c, the shingles of an id's set and those that more than ``limit`` of ``sets`` hold; ``pairs``: x, y that
    share a rare one and may be similar (``size``: shingles of all sets, at most). All other pairs share min(c, c') shingles at most. (Of an id's sets m is the least, c the largest.)"""
    sets = written(sets.groupBy("id", F.xxhash64("id", "shingles").alias("set")).agg(F.first("shingles").alias("shingles")), "near-crowd", size)
    words = written(_shingle_counts(sets, limit), "near-words")
    seen = words.groupBy("word").agg(F.sum("seen").alias("holders")).filter(F.col("holders") <= limit)
    rare = written(words.drop("seen").join(seen.hint("merge"), "word").select("word", "holders", F.explode("sets").alias("set")), "near-rare", size)
    number = rare.groupBy("set").agg(F.count("*").alias("rare"))
    common = sets.select("id", "set", (F.octet_length("shingles") / 4).cast("int").alias("m")).join(number.hint("merge"), "set", "left")
    common = written(common.groupBy("id").agg(F.min("m").alias("m"), F.max(F.col("m") - F.coalesce("rare", F.lit(0))).alias("c")), "near-common", size)
    shared = rare.filter("holders > 1").join(sets.select("set", "id").hint("merge"), "set").select("word", "id").distinct()
    pairs = shared.withColumnRenamed("id", "x").join(shared.withColumnRenamed("id", "y").hint("merge"), "word").filter("x < y").groupBy("x", "y").agg(F.count("*").alias("s"))
    for side in ("x", "y"):
        pairs = pairs.join(common.select(F.col("id").alias(side), F.col("m").alias(f"m_{side}"), F.col("c").alias(f"c_{side}")).hint("merge"), side)
    pairs = pairs.filter(F.col("s") + F.least("c_x", "c_y") >= _overlap(F.col("m_x"), F.col("m_y"), similarity)).select("x", "y")
    pairs = written(pairs, "near-sharing", size)
    release(sets.sparkSession, words, rare, sets)
    return common, pairs


def _overlap(m, n, similarity: float):
    """The elements that sets of ``m`` and ``n`` share at least if they are similar."""
    return (m + n) * (similarity / (1 + similarity))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_classes(sketches: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``groups``: fp1, fp2, n, id (least doc_id) and copies of every distinct set; ``classes``: id and component of the linked ones."""
    spark = sketches.sparkSession
    n_docs, size = sketches.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_bands = BANDS * n_docs
    named = sketches.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    groups = written(named.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "near-groups", n_docs)
    heads = named.join(groups.select("fp1", "fp2", "n", F.col("id").alias("doc_id")).hint("merge"), ["fp1", "fp2", "n", "doc_id"])
    heads = heads.groupBy("fp1", "fp2", "n", "doc_id").agg(F.first("bands").alias("bands"))  # rows that repeat
    bands = heads.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("key"))
    # Buckets with one member say nothing. The least member is the first centre.
    first = bands.groupBy("key").agg(F.min(F.struct("id", "n")).alias("centre"), F.count("*").alias("members")).filter("members > 1")
    buckets = written(bands.join(first.drop("members").hint("merge"), "key"), "near-buckets", n_bands)
    sets = written(_sets(docs, buckets.select("id").distinct()), "near-sets", size)
    close = similarity - 1e-9

    def fits(n, m):
        return F.least(n, m) >= F.greatest(n, m) * close

    rest = buckets.filter(F.col("id") != F.col("centre.id"))  # the centre meets all
    pairs = rest.filter(fits(F.col("n"), F.col("centre.n"))).select(F.col("id").alias("x"), F.col("centre.id").alias("y"))
    tried = written(_compared(_ordered(pairs), sets), "near-pairs", n_bands)
    links = tried.filter(F.col("similarity") >= close).select("a", "b")
    classes = components(links, n_bands)
    # Every member's distance from the first centre; where sizes alone rule a link out it stays open.
    met_first = tried.select(F.col("b").alias("id"), F.col("a").alias("first"), (1 - F.col("similarity")).alias("d")).hint("merge")
    left = written(rest.select("key", "id", "n", F.col("centre.id").alias("first")).join(met_first, ["id", "first"], "left").select("key", "id", "n", "d"), "near-rest", n_bands)
    tried = tried.select("a", "b")

    def named(members):
        """Members with the component they are in by now."""
        return members.join(classes.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    def link(pairs):
        """Compare the pairs (x, y) that were not compared yet, and join what is close."""
        nonlocal tried, links, classes
        found = written(_compared(_ordered(pairs).join(tried.hint("merge"), ["a", "b"], "left_anti"), sets), "near-pairs", n_bands)
        tried = tried.unionByName(found.select("a", "b"))
        new = found.filter(F.col("similarity") >= close).select("a", "b")
        if not new.isEmpty():
            links = links.unionByName(new)
            classes = components(links, n_bands)

    def meetings(members, centres):
        """Members and centres of a bucket in different components that can be close by what is known of them."""
        centres = centres.select("key", *[F.col(c).alias(f"c_{c}") for c in ("id", "n", "d", "m", "c", "component")])
        # Distances obey the triangle inequality: two members whose distances from the first centre differ too much can't be close.
        apart = F.coalesce(F.abs(F.col("d") - F.col("c_d")) > 1 - close, F.lit(False))
        few = F.when(F.col("c").isNotNull() & F.col("c_c").isNotNull(), F.least("c", "c_c") < _overlap(F.col("m"), F.col("c_m"), close)).otherwise(F.lit(False))
        met = members.join(centres.hint("merge"), "key").filter((F.col("component") != F.col("c_component")) & fits(F.col("n"), F.col("c_n")) & ~apart & ~few)
        return met.select(F.col("id").alias("x"), F.col("c_id").alias("y"))

    left = left.withColumn("m", F.lit(None).cast("int")).withColumn("c", F.lit(None).cast("long"))
    limit = CENTRES
    first_time = True
    while True:
        state = named(left)
        parts = state.groupBy("key", "component").agg(F.count("*").alias("members"))
        # Buckets that still hold several components, and the largest of them.
        several = (parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("members").alias("all"), F.max(F.struct("members", "component")).alias("largest"))
                   .filter("parts > 1").withColumn("outside", F.col("all") - F.col("largest.members")).withColumn("share", F.greatest(F.lit(1), F.floor(F.col("outside") / limit)))
                   .withColumn("crowded", F.col("outside") * F.col("all") > CROWD))
        open_ = written(state.join(several.select("key", "share", "crowded", F.col("largest.component").alias("largest")).hint("merge"), "key"), "near-open", n_bands)
        if open_.isEmpty():
            break
        old, sets = sets, written(sets.join(open_.select("id").distinct().hint("merge"), "id", "left_semi"), "near-sets", size)
        release(spark, old)
        members = open_.select("key", "id", "n", "d", "m", "c", "component")
        crowd = open_.filter("crowded").select("id").distinct()
        if first_time and not crowd.isEmpty():
            first_time = False
            common, sharing = _rare(sets.join(crowd.hint("merge"), "id", "left_semi"), close, size=size)
            told = members.drop("m", "c").join(common.hint("merge"), "id", "left")
            crowded = told.join(open_.filter("crowded").select("key").distinct().hint("merge"), "key", "left_semi")
            best = crowded.groupBy("key").agg(F.max(F.struct(F.col("c") / F.col("m"), -F.col("id"), "id", "n", "d", "m", "c", "component")).alias("best")).select("key", "best.*")
            ends = sharing
            for side in ("x", "y"):
                ends = named(ends.withColumnRenamed(side, "id")).withColumnRenamed("id", side).withColumnRenamed("component", f"of_{side}")
            link(meetings(crowded, best).unionByName(ends.filter("of_x <> of_y").select("x", "y")))
            # Members of crowded buckets whose common shingles are too few for the shortest set they could be close to are done with.
            least = crowded.groupBy("key").agg(F.min("m").alias("least"))
            done = (crowded.join(least.hint("merge"), "key").filter(F.col("c") < _overlap(F.col("m"), F.greatest(F.col("least"), F.col("m") * close), close)).select("key", "id").distinct())
            left = written(told.drop("component").join(done.hint("merge"), ["key", "id"], "left_anti"), "near-rest", n_bands)
            release(spark, open_, common, sharing)
            continue
        first_time = False
        centres = open_.filter((F.col("component") != F.col("largest")) & (F.pmod(F.xxhash64("id", "key"), F.col("share")) == 0))
        link(meetings(members, centres))
        left = written(members.drop("component").join(centres.select("key", "id").hint("merge"), ["key", "id"], "left_anti"), "near-rest", n_bands)
        release(spark, open_)
        limit *= 8
    release(spark, buckets, sets)
    return groups, classes


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size, kept and n_shingles, one row per row of ``docs``."""
    sketches = written(sketch(docs), "near-sketch")
    groups, classes = link_classes(sketches, docs, similarity)
    known = groups.join(classes.hint("merge"), "id", "left").select("fp1", "fp2", "n", "copies", F.coalesce("component", "id").alias("class_id"))
    sizes = known.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    known = written(known.join(sizes.hint("merge"), "class_id").select("fp1", "fp2", "n", "class_id", "class_size"), "near-classes", sketches.count())
    out = sketches.select("doc_id", "n", "fp1", "fp2").join(known.hint("merge"), ["fp1", "fp2", "n"], "left")
    named = F.col("doc_id").isNotNull()
    class_id = F.when(named, F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.when(named, F.coalesce("class_size", F.lit(1))).otherwise(1).alias("class_size"),
                      class_id.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("n").alias("n_shingles"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
