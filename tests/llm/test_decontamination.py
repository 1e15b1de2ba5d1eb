import numpy as np

from medwright.llm import decontamination as D

from .helpers import awkward, empty, prose


def words(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return D.passage_words(raw, np.array([0, len(raw)]))[0]


def test_lcs_equals_dynamic_programming():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert D.lcs_length(a, b) == t[-1, -1]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_randomised_svd_spans_the_passages(spark):
    bench = [(i, prose(100 + i, 30)) for i in range(12)]
    docs = awkward(spark, [(i, prose(i, 80)) for i in range(20)])
    space = D.latent_space(docs, items(spark, bench))
    found = [p for _, t in bench for p in D.passages_of(words(t), space.idf)]
    rows = np.zeros((len(found), int(space.place.max()) + 1))
    for row, (f, weight, _) in zip(rows, found):
        row[space.place[f]] = weight
    assert np.allclose(np.linalg.norm(rows, axis=1), 1) and len(space.basis) == rows.shape[1]  # the items' own features, no others
    assert np.allclose(rows @ space.basis @ space.basis.T, rows, atol=1e-3)  # rank enough: nothing is lost
    assert np.allclose(space.basis.T @ space.basis, np.diag(np.diag(space.basis.T @ space.basis)), atol=1e-4)


def test_planted_passages_and_paraphrases(spark):
    bench = [(i, prose(200 + i, 15 + 4 * i)) for i in range(10)] + [(50, "too short"), (51, None), (52, prose(200, 15))]
    rows = []
    for i in range(40):
        text = prose(i, 90).split()
        if i < 10:  # verbatim, in capitals for odd ones
            passage = bench[i][1].upper() if i % 2 else bench[i][1]
            text[i * 7:i * 7] = passage.split()
        elif i < 20:  # every sixth word replaced, one dropped
            passage = [w if k % 6 != 3 else f"other{k}" for k, w in enumerate(bench[i - 10][1].split())]
            text[20:20] = passage[:5] + passage[6:]
        rows.append((i, " ".join(text)))
    out = {r.doc_id: r for r in D.find_leaks(awkward(spark, rows), items(spark, bench), "found").collect()}
    for i in range(40):
        assert [h.item_id for h in out[i].found] == ([i % 10] if i < 20 else []), i
        assert out[i].hits == "h"
    assert all(h.lcs == 1 and h.answer == 1 for i in range(10) for h in out[i].found)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    bench = items(spark, [(i, prose(300 + i, 25)) for i in range(9)])
    docs = awkward(spark, [(i, prose(i, 40) + " " + prose(300 + i, 25)) for i in range(9)])
    one = [(r.doc_id, [h.item_id for h in r.found]) for r in D.find_leaks(docs, bench, "found").orderBy("doc_id").collect()]
    monkeypatch.setattr(D, "BLOCK_PASSAGES", 2)
    for spaces in (16, 2):  # all blocks in one scan, and several scans
        monkeypatch.setattr(D, "SPACES", spaces)
        many = [(r.doc_id, [h.item_id for h in r.found]) for r in D.find_leaks(docs, bench, "found").orderBy("doc_id").collect()]
        assert one == many == [(i, [i]) for i in range(9)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = D.find_leaks(docs, items(spark, [(1, prose(2, 60))]), "found").collect()
    assert len(out) == docs.count()
    assert sorted(str(r.doc_id) for r in out if r.found) == ["11"]
    assert not any(r.found for r in D.find_leaks(docs, items(spark, []), "found").collect())
    assert D.find_leaks(empty(spark), items(spark, [(1, prose(2, 60))]), "found").count() == 0


def test_thousands_of_items_are_all_found(spark):
    bench = [(i, prose(5000 + i, 15 + i % 45)) for i in range(2000)]
    docs = awkward(spark, [(d, " ".join(prose(9000 + 4 * d + k, 30 + 7 * k) + " " + bench[4 * d + k][1] for k in range(4))) for d in range(500)])
    out = {r.doc_id: r.found for r in D.find_leaks(docs.repartition(8), items(spark, bench), "found").collect()}
    assert all(sorted(h.item_id for h in out[d]) == list(range(4 * d, 4 * d + 4)) for d in range(500))
    assert all(h.lcs == 1 and h.answer == 1 for found in out.values() for h in found)


def reworded(text, k):
    """Every k-th word replaced."""
    return " ".join(w if i % k else f"other{i}" for i, w in enumerate(text.split()))


def test_a_space_finds_what_full_rows_find(spark):
    """Rank 192 against a basis that loses nothing (full TF-IDF rows), on verbatim, reworded and unrelated texts."""
    bench = [(i, prose(300 + i, 12 + i % 60)) for i in range(300)]
    texts = [prose(9000 + i, 50) + " " + (t if i % 3 == 0 else reworded(t, 3 + i % 4)) + " " + prose(8000 + i, 30) for i, t in bench] + [prose(4000 + i, 300) for i in range(60)]
    docs = awkward(spark, list(enumerate(texts)))
    small = D.latent_space(docs, items(spark, bench))
    exact = D.latent_space(docs, items(spark, bench), 2048)
    assert small.basis.shape[1] == D.RANK < len(small.passages) <= exact.basis.shape[1] + 1 and exact.least.min() > 0.299
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    place = D.passage_words(np.concatenate(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    found = [{(row, h["item_id"]) for row, own in enumerate(D.search(*place, len(texts), space)) for h in own} for space in (small, exact)]
    assert {(i, i) for i in range(0, 300, 3)} <= found[0] <= found[1]  # verbatim items all
    assert len(found[0]) >= 0.95 * len(found[1]) > 250


def test_a_passage_of_which_little_is_kept_is_still_found(spark):
    """Far more passages than dimensions: a verbatim copy passes whatever the space keeps."""
    bench = [(i, prose(300 + i, 30)) for i in range(200)]
    docs = awkward(spark, [(i, prose(9000 + i, 40) + " " + t + " " + prose(8000 + i, 30)) for i, t in bench])
    space = D.latent_space(docs, items(spark, bench), 8)
    assert np.median(space.least) < 0.2
    for i, text in ((r.doc_id, r.text) for r in docs.collect()):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert [h["item_id"] for h in D.search(*D.passage_words(raw, np.array([0, len(raw)])), 1, space)[0]] == [i]


def test_what_else_the_benchmark_holds_changes_no_hits(spark):
    bench = [(i, prose(300 + i, 25 + 3 * i)) for i in range(20)]
    docs = awkward(spark, [(i, prose(9000 + i, 40) + " " + (t if i % 2 else reworded(t, 8))) for i, t in bench])
    few = {r.doc_id: [(h.item_id, h.lcs, h.answer) for h in r.found] for r in D.find_leaks(docs, items(spark, bench), "found").collect()}
    more = bench + [(1000 + i, prose(20_000 + i, 15 + i % 50)) for i in range(800)]
    many = {r.doc_id: [(h.item_id, h.lcs, h.answer) for h in r.found] for r in D.find_leaks(docs, items(spark, more), "found").collect()}
    assert few == many and all([h[0] for h in few[i]] == [i] for i in range(1, 20, 2)) and sum(map(bool, few.values())) >= 15


def test_a_very_long_item_and_a_very_long_text(spark):
    long = prose(77, 4_000)
    docs = awkward(spark, [(1, prose(1, 200_000)), (2, prose(2, 500) + " " + long + " " + prose(3, 300)), (3, prose(4, 1000) + " " + prose(5, 20))])
    out = {r.doc_id: [h.item_id for h in r.found] for r in D.find_leaks(docs, items(spark, [(1, long), (2, prose(5, 20))]), "found").collect()}
    assert out == {1: [], 2: [1], 3: [2]}


def test_ties_and_repeated_rows(spark):
    same = prose(6, 25)
    docs = awkward(spark, [(1, same), (1, same), (1, prose(8, 30))])
    out = [[h.item_id for h in r.found] for r in D.find_leaks(docs, items(spark, [(9, same), (4, same.upper()), (4, same)]), "found").collect()]
    assert sorted(out) == [[], [4, 4], [4, 4]]  # texts that differ in case are two items; here both are named 4


def test_rare_words_around_a_short_item_do_not_hide_it(spark):
    common = "we know that the sum of two even numbers is even"
    rows = [(i, prose(i, 40) + (f" {common}" if i < 100 else "") + " " + " ".join(f"rare{i}x{k}" for k in range(40))) for i in range(300)]
    out = D.find_leaks(awkward(spark, rows), items(spark, [(1, common), (2, " ".join(f"rare7x{k}" for k in range(12)))]), "found").collect()
    assert {r.doc_id: sorted(h.item_id for h in r.found) for r in out} == {i: [1] * (i < 100) + [2] * (i == 7) for i in range(300)}


def test_an_item_that_many_documents_hold_is_found_in_all(spark):
    hot, everywhere = prose(800, 30), prose(801, 12)
    rows = [(i, prose(2000 + i, 30) + " " + everywhere + " " + prose(3000 + i, 35) + (" " + hot if i % 3 == 0 else "")) for i in range(600)]
    for more in ([], [(10 + i, prose(7000 + i, 40)) for i in range(300)]):  # in one space, and in several
        out = D.find_leaks(awkward(spark, rows), items(spark, [(1, hot), (2, everywhere), *more]), "found").collect()
        assert {r.doc_id: sorted(h.item_id for h in r.found) for r in out} == {i: [1, 2] if i % 3 == 0 else [2] for i in range(600)}


def test_short_items_are_found_as_whole_runs(spark):
    bench = [(1, "zebra"), (2, "Two Zebras?"), (3, "two zebras"), (4, "one two three four five six seven"), (5, "?!"), (None, "nameless item"), (6, "zebra zebra")]
    rows = [(1, "a Zebra, here"), (2, "two zebras " + prose(1, 30)), (3, "zebras two"), (4, "so one two three four five six seven"), (5, "one two three four five six"),
            (6, "seven"), (7, "ends with two"), (8, "zebras begin"), (9, "nameless item ?!"), (10, None), (11, "zebra zebra")]
    out = {r.doc_id: [(h.item_id, h.lcs) for h in r.found] for r in D.find_leaks(awkward(spark, rows).coalesce(1), items(spark, bench), "found").collect()}
    assert {i: [h[0] for h in found] for i, found in out.items() if found} == {1: [1], 2: [2, 3], 4: [4], 11: [1, 6]}
    assert all(h[1] == 1 for found in out.values() for h in found)
