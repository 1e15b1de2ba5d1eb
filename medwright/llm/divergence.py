"""Source divergence audit: how far the term use of each source of a language is from each other source's.

A term is a run of letters (A-Z lower-cased) and non-ASCII characters. A language keeps the V terms that at
least ``MIN_DOCS`` of its documents hold. In a group (language, source) with N occurrences of kept terms a
term that occurs c times has p = 1 + floor(10^9 (c + 2) / (N + 2V)); the divergence of two groups is the
sum over all V terms of f(p, q) = floor((p - q)^2 / (p + q)). Most terms occur in few of the sources, so the sum is not
taken term by term for every pair. It is Gustavson's sparse row product, one row per group:

* the term-major index holds, for each term, the groups it occurs in and how often (its postings). It is
  cut into shards by a hash of the term, each of about ``SHARD_POSTINGS`` postings;
* in a shard each group scatters its terms through the index into a dense accumulator with one place per
  peer: for every posting of a term the group holds, the difference that the peer's count makes. No pair of postings leaves
  the task; a shard emits one dense row per group;
* zero baselines: a term that a group lacks has p0 = 1 + floor(2 10^9 / (N + 2V)), not 0. Before the scatter the accumulator
  gets f(p0, q0) for every term of the shard, corrected for the terms of either group by f(p, q0) - f(p0, q0), computed
  from how many of a group's terms have each share; the scatter then replaces f(p, q0) + f(p0, q) - f(p0, q0) by f(p, q)
  for the terms that both hold;
* the rows of all shards are added up by Spark.

A shard's groups are dealt in blocks of ``ROW_BLOCK`` rows, each with the shard's whole index, so a task holds one
shard and a block of rows, however many sources there are. Everything is integer arithmetic, exact while N + 2V is
under 9 * 10^15.

Defined cases: null text, lang and source count as ''; each row is a document, so a doc_id that repeats counts as
often as it stands there; a group without kept terms has p0 for every term; a language without kept terms has
divergence 0 between all its sources and no terms to rank; a language of one source has no pairs; ties rank by the item's
UTF-8 bytes; extra columns are ignored; an empty table gives an empty result. Texts of any length are taken whole, in
pieces that end between terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medwright.llm.common import release, slices, table, written

MIN_DOCS = 10
TOP_TERMS = 10
#: Postings of a shard of the term-major index on average.
SHARD_POSTINGS = 1 << 16
#: Groups whose accumulators one task fills from a shard.
ROW_BLOCK = 256
#: Bytes of a long text whose terms are taken at a time.
PIECE_BYTES = 4 << 20
#: Distinct (lang, source, term) a task counts before it hands them on.
HELD_TERMS = 200_000
SCALE = 1_000_000_000

_TERM = re.compile(rb"[a-z\x80-\xff]+")  # after bytes.lower(), which changes A-Z only


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``PIECE_BYTES`` that end before a byte outside terms."""
    i = 0
    while len(text) - i > PIECE_BYTES:
        j = i + PIECE_BYTES
        edge = re.compile(rb"[^a-zA-Z\x80-\xff]").search(text, j)
        if edge is None:
            break
        yield text[i:edge.start()]
        i = edge.start()
    yield text[i:] if i else text


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences and documents, added up within the task as far as memory allows."""
    counts: dict[tuple[str, str], Counter] = {}
    found: dict[tuple[str, str], Counter] = {}
    held = 0

    def drain() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            terms = list(own)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                pa.array(own.values(), pa.int64()), pa.array([found[lang, source][t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        found.clear()

    for batch in batches:
        for rows, data, offsets in slices(batch):
            for lang, source, a, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own, docs = counts.setdefault((lang, source), Counter()), found.setdefault((lang, source), Counter())
                before, here = len(own), set()
                for piece in _pieces(data[a:b].tobytes().lower()):
                    terms = _TERM.findall(piece)
                    own.update(terms)
                    here.update(terms)
                docs.update(here)
                held += len(own) - before
                if held >= HELD_TERMS:
                    yield from drain()
                    held = 0
    yield from drain()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs: one row per term of a group."""
    own = docs.select(_text("lang").alias("lang"), _text("source").alias("source"), _text("text").alias("text"))
    rows = own.mapInArrow(_count_terms, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# ---------------------------------------------------------------- exact arithmetic

def share(count: str, total: str) -> Column:
    """1 + floor(10^9 (count + 2) / total); the product is a decimal of 30 digits."""
    return F.expr(f"1L + (CAST({count} + 2 AS DECIMAL(19, 0)) * 1000000000BD) div CAST({total} AS DECIMAL(19, 0))")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``share`` for arrays, in 64 bits: the quotient is built three decimal digits at a time."""
    digits, rest = np.divmod(counts + 2, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        digits = digits * 1000 + more
    return digits + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits."""
    d = p - q
    return d * d // (p + q)


# ---------------------------------------------------------------- row accumulation

def shard_rows(terms: np.ndarray, groups: np.ndarray, counts: np.ndarray, totals: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """For each group of ``rows`` its divergence from every group, over the terms of one shard.

    ``terms`` (numbers from 0), ``groups`` and ``counts`` are the postings, ``totals`` has N + 2V of each group.
    """
    if not len(terms):
        yield from np.zeros((len(rows), len(totals)), np.int64)
        return
    order = np.argsort(terms, kind="stable")  # term-major: a term's postings stand together
    terms, groups, counts = terms[order], groups[order], counts[order]
    ends = np.cumsum(np.bincount(terms))
    starts = ends - np.bincount(terms)
    p, zero = shares(counts, totals[groups]), shares(np.zeros_like(totals), totals)
    by_group = np.argsort(groups, kind="stable")
    first = np.searchsorted(groups[by_group], np.arange(len(totals) + 1))
    # How many terms of a group have a count: what either group's own terms add needs no more than that.
    levels, many = np.unique(np.stack([groups, p], axis=1), axis=0, return_counts=True)
    level_group, level_p = levels[:, 0], levels[:, 1]
    for g in rows.tolist():
        none = divergence(zero[g], zero)
        acc = len(ends) * none
        own = np.flatnonzero(level_group == g)
        for at in np.array_split(own, -(-len(own) * len(zero) // (1 << 20)) or 1):
            acc += (many[at, None] * (divergence(level_p[at, None], zero[None, :]) - none[None, :])).sum(axis=0)
        np.add.at(acc, level_group, many * (divergence(level_p, zero[g]) - none[level_group]))
        mine = by_group[first[g]:first[g + 1]]
        lengths = ends[terms[mine]] - starts[terms[mine]]
        met = np.repeat(starts[terms[mine]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        peer, q, mp = groups[met], p[met], np.repeat(p[mine], lengths)
        np.add.at(acc, peer, divergence(mp, q) - divergence(mp, zero[peer]) - divergence(zero[g], q) + none[peer])
        yield acc


def _accumulate(key: tuple, table: pa.Table) -> pa.Table:
    """The accumulators of one block of groups over one shard. Rows without a term list all groups of the language."""
    group, total = table["idx"].to_numpy(), table["total"].to_numpy()
    listed = table["term"].is_null().to_numpy()
    totals = np.zeros(listed.sum(), np.int64)
    totals[group[listed]] = total[listed]
    terms = table["term"].combine_chunks().filter(pa.array(~listed)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    block = key[2].as_py()
    rows = np.arange(block * ROW_BLOCK, min(len(totals), (block + 1) * ROW_BLOCK))
    out = list(shard_rows(terms.astype(np.int64), group[~listed], table["n"].to_numpy()[~listed], totals, rows))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(rows), pa.string()), "idx": pa.array(rows, pa.int64()), "acc": pa.array(out, pa.list_(pa.int64()))})


# ---------------------------------------------------------------- the audit

def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: postings (lang, source, term, n, lang_n), groups (lang, source, idx, total) and langs.

    ``idx`` numbers a language's sources from 0; langs has v, sources, postings and lang_total of each lang.
    """
    spark = docs.sparkSession
    counts = written(term_counts(docs), "term-counts")
    known = written(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
                    .filter(F.col("docs") >= min_docs).drop("docs"), "term-kept")
    postings = written(counts.drop("docs").join(known, ["lang", "term"]), "term-postings")
    every = docs.select(_text("lang").alias("lang"), _text("source").alias("source")).distinct()
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("n"))
    nothing = F.lit(0).cast("long")
    langs = written(
        every.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
        .join(sizes, "lang", "left").join(postings.groupBy("lang").agg(F.count(F.lit(1)).alias("postings")), "lang", "left")
        .select("lang", "sources", F.coalesce("v", nothing).alias("v"), F.coalesce("postings", nothing).alias("postings"),
                (F.coalesce("n", nothing) + 2 * F.coalesce("v", nothing)).alias("lang_total")), "term-langs")
    groups = written(
        every.join(postings.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs.select("lang", "v"), "lang")
        .select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("idx"),
                (F.coalesce("n", nothing) + 2 * F.col("v")).alias("total")), "term-groups")
    release(spark, counts, known)
    return postings, groups, langs


def pair_divergence(postings: DataFrame, groups: DataFrame, langs: DataFrame, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """lang, source, item (another source) and value for all pairs of a language's sources.

    A shard's dense rows have a place for each pair of sources, so shards grow with the square of their
    number, up to sixteen times ``shard_postings``.
    """
    per_shard = F.greatest(F.lit(shard_postings), F.least(F.col("sources") * F.col("sources"), F.lit(16 * shard_postings)))
    cut = langs.select("lang", "sources", "postings", per_shard.cast("long").alias("per_shard")).select(
        "lang", F.expr("1 + postings div per_shard").alias("shards"), F.expr(f"1 + (sources - 1) div {ROW_BLOCK}").alias("blocks"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    named = groups.select("lang", "source", "idx", "total")
    index = (postings.join(named, ["lang", "source"]).join(cut, "lang")
             .select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), blocks, "term", "idx", "n", "total"))
    listed = (groups.join(cut, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
              .select("lang", "shard", blocks, F.lit(None).cast("string").alias("term"), "idx", F.lit(0).cast("long").alias("n"), "total"))
    rows = index.unionByName(listed).groupBy("lang", "shard", "block").applyInArrow(_accumulate, "lang string, idx long, acc array<long>")
    added = (rows.select("lang", "idx", F.posexplode("acc").alias("peer", "value")).filter(F.col("idx") != F.col("peer"))
             .groupBy("lang", "idx", F.col("peer").cast("long").alias("peer")).agg(F.sum("value").alias("value")))
    peers = groups.select("lang", F.col("idx").alias("peer"), F.col("source").alias("item"))
    return added.join(groups.select("lang", "idx", "source"), ["lang", "idx"]).join(peers, ["lang", "peer"]).select("lang", "source", "item", "value")


def term_divergence(postings: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item (a term the source uses more than its language) and value."""
    return (postings.join(groups.select("lang", "source", "total"), ["lang", "source"]).join(langs.select("lang", "lang_total"), "lang")
            .withColumn("p", share("n", "total")).withColumn("q", share("lang_n", "lang_total")).filter("p > q")
            .select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value")))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank."""
    postings, groups, langs = kept_terms(docs, min_docs)
    pairs = _ranked(pair_divergence(postings, groups, langs, shard_postings), "pair")
    return pairs.unionByName(_ranked(term_divergence(postings, groups, langs), "term").filter(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o SEMI JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + 2 * v.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM e WHERE n > 0 AND p > q),
w AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
             CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM w WHERE part = 'pair' OR rank <= 10
"""
