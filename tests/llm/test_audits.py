"""The two audits against plain loops over documents."""
from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from medwright.llm import divergence as V
from medwright.llm import filter_audit as A
from medwright.llm.common import table

from .helpers import SF, prose

# ------------------------------------------------------------------ filter interaction audit


def conditions(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def brute_audit(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = defaultdict(list)
    for i, text, source in rows:
        fails = {k for k, v in conditions(text or "").items() if v}
        if i is not None and i > least[text or ""]:
            fails.add("E")
        docs[source or ""].append((fails, i in good, i in toxic))
    out, total = [], Counter()
    for part, own in docs.items():
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                here = [d for d in left if letter in d[0]]
                gone = [d for d in own if letter in d[0] and d[0] & set(order[:step - 1])]
                left = [d for d in left if letter not in d[0]]
                total[part, letter] += len(here)
                out.append((part, "".join(order), step, len(left), len(here), len(gone), sum(d[0] == {letter} for d in own),
                            sum(d[1] for d in here), sum(d[2] for d in here)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
ODD = "doc_id long, text string, source string, part string, mask int, digest string, n long"


def odd(spark, rows):
    """Documents with extra columns whose names the audits use themselves."""
    return spark.createDataFrame([(i, t, s, "p", 3, "d", 1) for i, t, s in rows], ODD)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_filter_audit_query(spark):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]
    labels = [tuple(r) for r in table(spark, SF, "labels").select("doc_id", "quality", "toxic").collect()]
    got = A.op12_filter_audit(spark, SF)
    assert got.columns == AUDIT
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_filter_audit_awkward_rows(spark):
    clean = prose(1, 300)
    rows = [(1, clean, "a"), (2, clean, "a"), (3, clean, None), (None, clean, "a"), (None, None, None), (4, None, "a"), (5, "", "b"), (6, " \t\n", "b"),
            (7, "x " * 60, "a"), (7, "x " * 60, "a"), (8, "x " * 60, ""), (9, "A" * 200 + " #", "a"), (10, "ÉÈ ñ 日本 " * 30, "a"),
            (11, "one$two " + prose(2, 200_000), "long"), (0, "ABC " * 3, "b")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (99, 1, 1), (7, 1, 1), (4, 1, 0), (9, 0, 1)]
    assert sorted(map(tuple, A.audit(odd(spark, rows), labelled(spark, labels)).collect())) == brute_audit(rows, labels)


def test_filter_audit_of_an_empty_table_and_without_labels(spark):
    assert A.audit(odd(spark, []), labelled(spark, [(1, 1, 1)])).count() == 0
    out = A.audit(odd(spark, [(1, "a", "s")]), labelled(spark, []))
    assert out.count() == 600 and out.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_filter_audit_takes_other_filters(spark):
    out = A.audit(odd(spark, [(1, "ab", "s"), (2, "b", "s"), (3, "b", "s")]), labelled(spark, []),
                  {"X": F.col("text").contains("a"), "Y": F.length("text") > 1}, "Z").collect()
    assert len(out) == math.factorial(3) * 3
    removed = {(r.filter_order, r.step): r.removed for r in out}
    assert removed["XYZ", 1] == 1 and removed["XYZ", 2] == 0 and removed["XYZ", 3] == 1
    assert {(r.filter_order[r.step - 1], r.shapley) for r in out} == {("X", 3), ("Y", 3), ("Z", 6)}


def test_the_recursion_does_not_grow_with_parts(spark):
    """The rows of the recursive CTE are prefixes times masks; parts only meet them afterwards."""
    cells = spark.range(200).select(F.col("id").cast("string").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("mask"),
                                    F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    assert A.step_metrics(cells, "ABCDE").count() == 200 * 325


# ------------------------------------------------------------------ source divergence audit


def p_of(c, n, v):
    return 1 + 10**9 * (c + 2) // (n + 2 * v)


def f_of(p, q):
    return (p - q) ** 2 // (p + q)


def brute_divergence(rows, min_docs=10, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, found = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang or "", source or ""].update(terms)
        found[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in found[lang].items() if n >= min_docs]
        own = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = {s: {t: p_of(c[t], sum(c.values()), len(kept)) for t in kept} for s, c in own.items()}
        q = {t: p_of(whole[t], sum(whole.values()), len(kept)) for t in kept}
        for s in own:
            pairs = [(sum(f_of(share[s][t], share[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f_of(share[s][t], q[t]), t) for t in kept if own[s][t] and share[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(items[:most], 1)]
    return sorted(out)


def test_divergence_query(spark):
    rows = [(r.text, r.lang, r.source) for r in table(spark, SF, "documents").collect()]
    got = V.op13_source_divergence(spark, SF)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows)


def sources(spark, rows):
    """Documents with extra columns whose names the audit uses itself."""
    return spark.createDataFrame([(1, *r, "t", 3, 4) for r in rows], "doc_id long, text string, lang string, source string, term string, idx int, total int")


def test_divergence_awkward_rows_in_small_shards(spark):
    rows = [(prose(i, 30 * i), "en", f"s{i % 3}") for i in range(1, 12)]
    rows += [("Ünï ÜNÏ a_b'c 日本 x9y", "de", "a"), ("ünï Ünï", "de", "b"), ("ünï Ünï", "de", "b"), (None, "de", "c"), ("", None, None), ("a b a", None, "x"),
             ("a b", None, None), (None, None, "y"), ("only", "fr", "lonely"), ("zz", "es", "a"), ("yy", "es", "b"), (prose(3, 300_000), "en", "s1")]
    want = brute_divergence(rows, 2, 4)
    assert sorted(map(tuple, V.audit_sources(sources(spark, rows), 2, 4, shard_postings=5).collect())) == want
    assert sorted(map(tuple, V.audit_sources(sources(spark, rows), 2, 4).collect())) == want
    assert [r for r in want if r[0] == "es"] == [("es", "a", "pair", "b", 0, 1), ("es", "b", "pair", "a", 0, 1)]


def test_divergence_with_more_sources_than_a_block(spark):
    rows = [(f"w{'x' * (i % 5)} shared {'y' * (i % 3)}", "en", f"s{i:03d}") for i in range(V.ROW_BLOCK + 7)]
    got = V.audit_sources(sources(spark, rows), 1, 10)
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, 1, 10)


def test_empty_table_has_no_rows(spark):
    assert V.audit_sources(sources(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_shard_rows_match_the_dense_sum(seed):
    rng = np.random.default_rng(seed)
    s, t = int(rng.integers(1, 9)), int(rng.integers(1, 40))
    dense = rng.integers(0, 10 ** int(rng.integers(1, 8)), (s, t)) * (rng.random((s, t)) < 0.4)
    dense[0, :] += 1  # every term occurs
    totals = dense.sum(axis=1) + 2 * t
    g, term = np.nonzero(dense)
    mixed = rng.permutation(len(g))
    got = list(V.shard_rows(term[mixed], g[mixed], dense[g, term][mixed], totals, np.arange(s)))
    p = [[p_of(int(dense[a, k]), int(totals[a]) - 2 * t, t) for k in range(t)] for a in range(s)]
    assert np.array_equal(got, [[sum(map(f_of, p[a], p[b])) for b in range(s)] for a in range(s)])


def test_shares_stay_exact_for_large_counts(spark):
    c, n, v = 10**12 + 7, 3 * 10**15 + 1, 12345
    want = p_of(c, n, v)
    assert V.shares(np.array([c]), np.array([n + 2 * v])).tolist() == [want]
    df = spark.createDataFrame([(c, n + 2 * v)], "c long, t long")
    assert df.select(V.share("c", "t").alias("p")).first().p == want


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(V, "PIECE_BYTES", 10)
    text = "Ünïcödé words, and_more ".encode() * 20 + b"x" * 50
    assert b"".join(V._pieces(text)) == text
    assert [w for piece in V._pieces(text) for w in V._TERM.findall(piece.lower())] == V._TERM.findall(text.lower())
    assert list(V._pieces(b"")) == [b""]
