"""Filter interaction audit: what each filter removes, at each place, in every order of the filters.

A filter is a failure condition on a document with a letter and a bit. Every document becomes a mask of the
conditions it fails, and the table becomes mask cells: a count of documents, good documents and toxic
documents for each part and mask (2^filters cells a part at most), aggregated in the map tasks. From there on
nothing depends on the number of documents. A recursive CTE enumerates the orders: it starts from the empty
prefix joined with the masks that occur, extends each prefix by every letter it has not used and carries
the bits applied so far; the rows of a recursion level are that step, and joined with the cells of their mask
they give the step's metrics. A prefix is counted once for all orders that begin with it. The recursion carries masks, not
parts, so its size is fixed (325 prefixes of five letters times 32 masks at most) whatever the number of parts.

Whether a text stands under a smaller doc_id is decided on digests: the least doc_id of each digest is
aggregated in the map tasks and meets the documents on (digest, doc_id), a key that no group of copies
can make hot.

Everything is DataFrame operations and SQL.

Defined cases: a null text counts as empty, and null and empty texts are identical; a null source is the part
''; each row is a document, so a doc_id that repeats counts as often as it stands there; rows of one doc_id
are not duplicates of each other; a row without doc_id is never a duplicate, makes none and has no label;
of label rows that repeat, 1 holds; label rows without a document count nowhere; extra columns are ignored; an
empty table has no parts and gives no rows. There are no ties: counts are exact and every order is listed.
Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medwright.llm.common import release, table, written

_WHITE = r"[\x20\x09-\x0D]+"

#: The letter of the condition that looks at other documents.
DUPLICATE = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a document's own text, by letter."""
    words = F.filter(F.split(text, _WHITE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 50,
        "B": F.lit(100) * distinct < F.lit(65) * n,
        "C": F.lit(100) * capitals > F.lit(5) * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def bits(letters: str) -> dict[str, int]:
    return {letter: 1 << i for i, letter in enumerate(letters)}


def masked(docs: DataFrame, filters: Mapping[str, Column], text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part, digest of the text and the bits of the ``filters`` that the text fails."""
    own = bits("".join(filters))
    mask = F.lit(0)
    for letter, fails in filters.items():
        mask = mask.bitwiseOR(F.when(fails, own[letter]).otherwise(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("digest"), mask.alias("mask"))


def mask_cells(slim: DataFrame, labels: DataFrame, duplicate_bit: int) -> DataFrame:
    """part, mask, n, good and toxic: the documents of each part by the conditions they fail.

    ``slim`` (of ``masked``) is read twice. Both joins are on doc_id or on (digest, doc_id): keys that
    stand once in the right side and, but for repeated ids, once in the left.
    """
    firsts = (slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull())
              .withColumn("first", F.lit(True)))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    copied = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return (slim.join(firsts, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
            .groupBy("part", F.col("mask").bitwiseOR(F.when(copied, duplicate_bit).otherwise(0)).alias("mask"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")))


def step_metrics(cells: DataFrame, letters: str) -> DataFrame:
    """part, prefix, letter, step and the counts of each step, for every ordered choice of letters.

    ``steps`` holds for each prefix and mask the bits applied before and after its last letter.
    """
    filters = ", ".join(f"named_struct('letter', '{letter}', 'bit', {bit})" for letter, bit in bits(letters).items())
    return cells.sparkSession.sql(f"""
        WITH RECURSIVE steps (prefix, letter, bit, before, applied, step, mask) AS (
            SELECT '', '', 0, 0, 0, 0, mask FROM (SELECT DISTINCT mask FROM {{cells}})
            UNION ALL
            SELECT concat(s.prefix, f.letter), f.letter, f.bit, s.applied, s.applied | f.bit, s.step + 1, s.mask
            FROM steps s LATERAL VIEW inline(array({filters})) f AS letter, bit
            WHERE (s.applied & f.bit) = 0
        )
        SELECT c.part, s.prefix, s.letter, s.step,
               sum(CASE WHEN c.mask & s.applied = 0 THEN c.n ELSE 0 END) AS kept,
               sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & s.before = 0 THEN c.n ELSE 0 END) AS removed,
               sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & s.before <> 0 THEN c.n ELSE 0 END) AS redundant,
               sum(CASE WHEN c.mask = s.bit THEN c.n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & s.before = 0 THEN c.good ELSE 0 END) AS good_lost,
               sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & s.before = 0 THEN c.toxic ELSE 0 END) AS toxic_lost
        FROM {{cells}} c JOIN steps s ON c.mask = s.mask
        WHERE s.step > 0
        GROUP BY c.part, s.prefix, s.letter, s.step""", cells=cells)


def audit_orders(metrics: DataFrame, letters: str) -> DataFrame:
    """A row per part, order and step. ``metrics`` (of ``step_metrics``) is read three times.

    A prefix of k letters begins (letters - k)! orders, which weighs its removals in the sum over all orders.
    """
    k = len(letters)
    share = F.sum(F.col("removed") * F.factorial(F.lit(k) - F.col("step"))).alias("shapley")
    shapley = metrics.groupBy("part", "letter").agg(share)
    places = (metrics.filter(F.col("step") == k).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
              .withColumn("prefix", F.expr("substring(filter_order, 1, step)")))
    return (places.join(metrics, ["part", "prefix", "step"]).join(shapley, ["part", "letter"])
            .select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in
                                                      ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]))


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, duplicate: str = DUPLICATE) -> DataFrame:
    """The audit of ``filters`` (by default those of ``text_filters``) and of the duplicate condition ``duplicate``."""
    filters = text_filters(F.coalesce(F.col("text"), F.lit(""))) if filters is None else filters
    letters = "".join(filters) + duplicate
    slim = written(masked(docs, filters), "filter-masks")
    cells = written(mask_cells(slim, labels, bits(letters)[duplicate]), "filter-cells")
    release(docs.sparkSession, slim)
    return audit_orders(written(step_metrics(cells, letters), "filter-steps"), letters)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE t AS (
    SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS words FROM t),
l AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY ALL),
d AS (
    SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
           CAST(len(words) < 50 AS INTEGER)
         + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER)
         + 4 * CAST(100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x) AS INTEGER)
         + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INTEGER)
         + 16 * coalesce(CAST(w.doc_id > min(w.doc_id) OVER (PARTITION BY x) AS INTEGER), 0) AS mask
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o(filter_order, used) AS (
    SELECT '', 0
    UNION ALL
    SELECT filter_order || letter, used + bit FROM o, f WHERE (used & bit) = 0),
s AS (
    SELECT filter_order, step, f.letter, f.bit,
           coalesce((SELECT sum(g.bit) FROM f g WHERE contains(left(filter_order, step - 1), g.letter)), 0)::INTEGER AS before
    FROM o, generate_series(1, 5) AS q(step), f WHERE length(filter_order) = 5 AND substr(filter_order, step, 1) = f.letter),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
m AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
           sum(CASE WHEN (mask & (before | bit)) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM m
"""
