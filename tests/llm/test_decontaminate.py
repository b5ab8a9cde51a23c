"""Decontamination against aligning every item at every place."""

import random

import numpy as np

from marlstone.llm import decontaminate

from .helpers import AWKWARD, SCHEMA, folded_words, frame, sentence

ITEMS = [(1, sentence(1, 30, 5000)), (2, sentence(2, 13, 5000)), (3, sentence(3, 9, 5000)), (4, sentence(4, 7, 5000)), (None, sentence(5, 25, 5000)), (6, None), (7, ""), (8, sentence(8, 60, 5000)), (8, sentence(8, 60, 5000))]


def items(spark, rows):
    return spark.createDataFrame([(k, t, "x") for k, t in rows], "item_id bigint, text string, doc_id string")


def matches(doc, item):
    """Whether some window of the item agrees with the document to the share, at any alignment."""
    d, w = folded_words(doc), folded_words(item)
    width = min(decontaminate.WINDOW, len(w))
    if len(w) < decontaminate.SPAN:
        return False
    for shift in range(-len(w) + 1, len(d)):
        lo, hi = max(shift, 0), min(shift + len(w), len(d))
        same = [d[i] == w[i - shift] for i in range(lo, hi)]
        for i in range(len(same) - width + 1):
            if sum(same[i : i + width]) * 5 >= width * 4:
                return True
    return False


def planted():
    r = random.Random(4)
    docs = []
    for i, (_, t) in enumerate(ITEMS):
        if t:
            w = t.split()
            for j, share in enumerate((0, 0.1, 0.15, 0.5)):
                own = [f"z{r.randrange(10**6)}" if r.random() < share else x for x in w]
                docs.append((100 + 10 * i + j, sentence(300 + i, 40, 5000) + " " + " ".join(own).upper() + ", " + sentence(400 + i, 30, 5000)))
            docs.append((100 + 10 * i + 5, " ".join(w[: len(w) // 2]) + " " + sentence(500 + i, 20, 5000)))
    return docs + [(900 + i, sentence(700 + i, 100, 5000)) for i in range(20)]


def test_recall_and_precision(spark):
    docs = planted()
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(frame(spark, docs), items(spark, ITEMS)).collect()}
    want = {(k, i) for k, t in docs for i, x in ITEMS if x and matches(t, x)}
    assert got <= want
    assert len(got) >= 0.9 * len(want) and len(want) > 15
    assert {(100, 1), (110, 2), (120, 3), (140, None), (170, 8)} <= got
    assert not {k for k, _ in got if k >= 900}


def test_short_items_with_any_words_replaced(spark):
    from itertools import combinations

    bench = [(n, sentence(20 + n, n, 5000)) for n in (8, 9, 10)]
    docs = []
    for n, t in bench:
        for gone in combinations(range(n), n // 5):
            words = ["new" if i in gone else x for i, x in enumerate(t.split())]
            docs.append((100 * n + len(docs), sentence(600, 6, 5000) + " " + " ".join(words) + " " + sentence(601, 6, 5000)))
    got = {r.doc_id for r in decontaminate.contamination(frame(spark, docs), items(spark, bench)).collect()}
    assert got == {k for k, _ in docs}


def test_seeds_miss_nothing_that_the_share_allows():
    """Every pattern of differences in items (or windows) of every length, by enumeration."""
    from itertools import combinations

    for n in range(1, decontaminate.WINDOW + 1):
        most = n - -(-n * 4 // 5) if n >= decontaminate.SPAN else 0
        seeds = decontaminate.seeds_of(n)
        if n == decontaminate.WINDOW:  # of longer items too
            assert seeds == decontaminate.seeds_of(100)
        for gone in combinations(range(n), most):
            assert any(not {at + m for m in mask} & set(gone) for mask, span in seeds for at in range(n - span + 1))


def test_everything_that_brute_force_finds_is_found(spark):
    r = random.Random(11)
    bench = [(n, sentence(50 + n, n, 40)) for n in range(8, 30)] + [(100 + n, sentence(200 + n, n, 40)) for n in range(8, 15)]
    docs = []
    for i in range(150):
        w = r.choice(bench)[1].split()
        a = r.randrange(max(len(w) - 8, 1))
        own = [f"w{r.randrange(40)}" if r.random() < 0.12 else x for x in w[a : a + r.randrange(8, 20)]]
        docs.append((i, sentence(300 + i, r.randrange(4), 40) + " " + " ".join(own) + " " + sentence(500 + i, r.randrange(9), 40)))
    got = {(x.doc_id, x.item_id) for x in decontaminate.contamination(frame(spark, docs), items(spark, bench)).collect()}
    assert got == {(k, i) for k, t in docs for i, x in bench if matches(t, x)} and len(got) > 60


def test_the_best_alignment_is_reported(spark):
    item = sentence(5, 20, 5000).split()
    docs = [(1, " ".join(item[:14] + ["x"] + item)), (2, " ".join(item + item)), (3, " ".join(item[3:]))]
    got = sorted(map(tuple, decontaminate.contamination(frame(spark, docs), items(spark, [(1, " ".join(item))])).collect()))
    assert got == [(1, 1, 20, 20, 15), (2, 1, 20, 20, 0), (3, 1, 17, 17, 0)]


def test_items_of_a_few_words_match_as_a_whole(spark):
    bench = [(1, "Forty-two"), (2, "one two three four five"), (3, "single"), (4, ""), (5, None), (6, " ...")]
    docs = [(10, "the answer is forty two, they say"), (11, "forty and two"), (12, "zero ONE two three four five six"), (13, "one two three x four five"), (14, "a SINGLE word"), (15, ""), (16, None), (17, "forty"), (18, "two forty")]
    got = {(r.doc_id, r.item_id, r.n_match, r.start_word) for r in decontaminate.contamination(frame(spark, docs), items(spark, bench), least=1).collect()}
    assert got == {(10, 1, 2, 3), (12, 2, 5, 1), (14, 3, 1, 1)}
    assert decontaminate.without_contaminated(frame(spark, docs), items(spark, bench)).count() == len(docs)


def test_every_mask_ignores_what_it_should():
    h = np.arange(40, dtype=np.uint64) * np.uint64(77777)
    for mask in decontaminate.MASKS:
        before = decontaminate.masked(h, mask)
        for place in range(decontaminate.SPAN):
            x = h.copy()
            x[10 + place] += np.uint64(1)
            assert (decontaminate.masked(x, mask)[10] == before[10]) == (place not in mask)


def test_awkward_documents(spark):
    docs = frame(spark, [*AWKWARD, (50, ITEMS[0][1]), (50, ITEMS[0][1]), (None, ITEMS[1][1])])
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contamination(docs, items(spark, ITEMS)).collect())
    assert got == [(0, 2), (50, 1), (50, 1)]
    kept = decontaminate.without_contaminated(docs, items(spark, ITEMS))
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD)


def test_a_large_benchmark_is_worked_through_in_parts(spark):
    docs, bench = frame(spark, planted()), items(spark, ITEMS)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(decontaminate.contamination(docs, bench, most=40)) == rows(decontaminate.contamination(docs, bench))
    assert rows(decontaminate.without_contaminated(docs, bench, most=40)) == rows(decontaminate.without_contaminated(docs, bench))


def test_empty_tables(spark):
    empty, none = spark.createDataFrame([], SCHEMA), items(spark, [])
    assert decontaminate.contamination(empty, items(spark, ITEMS)).count() == 0
    assert decontaminate.contamination(frame(spark, AWKWARD), none).count() == 0
    assert decontaminate.without_contaminated(frame(spark, AWKWARD), none).count() == len(AWKWARD)
