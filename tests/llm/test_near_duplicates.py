"""The chosen-path join against comparing all pairs."""

import random
from collections import Counter

import numpy as np

from marlstone.llm import minhash

from .helpers import AWKWARD, SCHEMA, frame, raw_words, sentence


def shingles(text):
    w = raw_words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def groups_by_brute_force(docs, threshold):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = set()
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                pairs.add((j, i))
                parent[find(i)] = find(j)
    return pairs, [find(i) for i in range(len(docs))]


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def test_recall_and_precision(spark):
    docs = []
    for g in range(40):
        base = sentence(1000 + g, 150, 5000)
        docs += [(len(docs) + c, edited(base, 0.04, 100 * g + c) if c else base) for c in range(1 + g % 4)]
    docs += [(1000 + i, sentence(5000 + i, 100, 5000)) for i in range(60)]
    pairs, group = groups_by_brute_force(docs, minhash.THRESHOLD)
    got = {r.doc_id: r.duplicate_of for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    stays = [got.get(k, k) for k, _ in docs]
    assert np.mean([stays[a] == stays[b] for a, b in pairs]) >= 0.9
    wrong = [k for i, (k, _) in enumerate(docs) if stays[i] != k and group[i] != group[[d for d, _ in docs].index(stays[i])]]
    assert len(wrong) <= 0.02 * len(docs)
    assert not [k for k in got if k >= 1000]


def test_large_groups(spark):
    base, other = sentence(1, 200, 9000), sentence(2, 200, 9000)
    docs = [(i, edited(base, 0.01, i)) for i in range(300)] + [(1000 + i, edited(other, 0.01, i)) for i in range(200)] + [(2000 + i, base) for i in range(50)] + [(5000, sentence(3, 200, 9000))]
    got = {r.doc_id: r.duplicate_of for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert Counter(got.values()) == {0: 349, 1000: 199}


def joined(pairs, n):
    part = list(range(n))
    for a, b in pairs:
        part = [part[a] if x == part[b] else x for x in part]
    return part


def test_nodes_join_what_all_pairs_join():
    """Small nodes, heavy sets and branches, each against comparing everything."""
    rng = np.random.default_rng(1)
    lo, hi = minhash.bounds(0.5)
    for small, groups, share in ((64, 20, 0.75), (4, 20, 0.75), (4, 2, 0.7), (4, 1, 0.66), (8, 40, 0.5)):
        base = rng.integers(0, 1 << 32, (groups, minhash.COORDINATES), dtype=np.uint32)
        tokens = base[rng.integers(0, groups, 60)].copy()
        other = rng.random(tokens.shape) > share**0.5
        tokens[other] = rng.integers(0, 1 << 32, int(other.sum()), dtype=np.uint32)
        same = (tokens[:, None] == tokens[None]).sum(axis=2)
        every = [(i, j) for i in range(60) for j in range(i + 1, 60) if same[i, j] >= lo]
        # As many roots as a production run has trees.
        path = np.arange(minhash.trees_for(0.999), dtype=np.uint64).repeat(60)
        u = np.tile(np.arange(60), len(path) // 60)
        got = {tuple(e) for e in minhash.node_pairs(path * np.uint64(977), u, np.tile(tokens, (len(path) // 60, 1)), 0.5, small)}
        assert got <= set(every)
        near, part = [p for p in every if same[p] >= minhash.COORDINATES // 2], joined(got, 60)
        assert np.mean([part[a] == part[b] for a, b in near] or [1]) >= 0.99
        if small == 64:
            assert joined(got, 60) == joined(every, 60)


def test_trees_reach_the_recall():
    assert [minhash.trees_for(r) for r in (0.5, 0.9, 0.99, 0.999)] == [1, 3, 6, 9]
    rng = np.random.default_rng(5)
    alive = rng.poisson(1, 20_000).astype(float)  # branches that a pair at the threshold has in common, level by level
    for _ in range(12):
        alive = np.minimum(rng.poisson(minhash.INNER * alive), 1000)
    for r in (0.9, 0.99):
        assert 1 - (1 - (alive > 0).mean()) ** minhash.trees_for(r) >= r - 0.01


def test_pairs_are_verified_on_the_shingles(spark):
    docs = [(i, sentence(i, 60, 30_000) + " " + sentence(900, n, 30_000)) for i, n in enumerate((10, 60, 118, 124, 130, 200))]
    docs += [(10 + i, sentence(20 + i, 60, 30_000) + " " + sentence(901, 200, 30_000)) for i in range(5)]
    pairs, group = groups_by_brute_force(docs, minhash.THRESHOLD)
    got = {r.doc_id: r.duplicate_of for r in minhash.near_duplicates(frame(spark, docs), recall=0.99999).collect()}
    first = {g: docs[g][0] for g in group}
    assert {k: first[g] for (k, _), g in zip(docs, group) if first[g] != k} == got and pairs


def test_crowded_branches_are_branched_on_the_way(spark):
    docs = [(i, edited(sentence(i // 3, 150, 5000), 0.04, i)) for i in range(60)]
    sigs = minhash.signatures(frame(spark, docs), 0.5, 9).cache()
    rows = lambda crowd: {(r.a, r.b) for r in minhash.candidates(sigs, 0.5, crowd).collect()}
    plain, crowded = rows(1000), rows(1)
    assert len(plain & crowded) >= 0.9 * len(plain) > 30


def test_chains_and_crowded_nodes(spark):
    """Groups in which only neighbours are near, among many sets that share boilerplate."""
    words = sentence(7, 2000, 30_000).split()
    docs = [(i, " ".join(words[12 * i : 12 * i + 60])) for i in range(100)]
    shared = sentence(8, 40, 30_000)
    docs += [(1000 + i, shared + " " + sentence(2000 + i, 60, 30_000)) for i in range(200)]
    pairs, group = groups_by_brute_force(docs, minhash.THRESHOLD)
    got = {r.doc_id: r.duplicate_of for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    stays = [got.get(k, k) for k, _ in docs]
    assert np.mean([stays[a] == stays[b] for a, b in pairs]) >= 0.98 and len(pairs) >= 90
    assert not [k for k in got if k >= 1000]


def test_short_tokens_agree_where_tokens_do():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 5000, (400, minhash.COORDINATES), dtype=np.uint32)  # as small as minima are
    short = minhash._short(tokens)
    same, looks = tokens[:-1] == tokens[1:], short[:-1] == short[1:]
    assert short.dtype == np.uint16 and (looks | ~same).all() and same.any() and (looks & ~same).mean() < 2e-4


def test_tokens_and_shingles_are_shuffled_sparingly(spark):
    """Two bytes a token, and one exchange of the 3-grams, which are those of the least row with each set id."""
    base = [(i, sentence(i, 1 + 7 * i, 5000)) for i in range(12)]
    docs = [*base, *base[:4], *((50 + k, t) for k, t in base[:6]), (None, base[1][1]), (30, None), (31, " ")]
    sigs = minhash.signatures(frame(spark, docs), 0.5, 3)
    rows = sigs.collect()
    assert {len(r.tokens) for r in rows} == {2 * minhash.COORDINATES} and len(rows) == len(docs) - 2
    wanted = sigs.groupBy("u").agg(minhash.F.min(minhash.F.struct("d", "h")).alias("k")).select("u", "k.d", "k.h")
    wanted = spark.createDataFrame(wanted.collect(), "u bigint, d bigint, h bigint")
    sets = minhash._shingle_sets(frame(spark, docs), wanted)
    text = {k: t for k, t in docs}
    got = {r.u: len(r.shingles) // 8 for r in sets.collect()}
    assert got == {r.u: len(shingles(base[1][1] if r.d < 0 else text[r.d])) for r in wanted.collect()}
    plan = minhash._shingle_sets(frame(spark, docs), wanted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_awkward_documents(spark):
    got = Counter((r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(frame(spark, AWKWARD)).collect())
    assert got == {(7, 7): 1, (8, 7): 1, (9, 7): 1}
    docs = frame(spark, AWKWARD)
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    want = Counter(AWKWARD)
    from .helpers import A

    want[7, A] -= 1
    want[8, A] -= 1
    want[9, A + " tail words here"] -= 1
    assert left == +want


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (300, 400), (7, 7)]
    got = {r.v: r.root for r in minhash.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100, 400: 100}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.without_near_duplicates(empty).count() == 0
