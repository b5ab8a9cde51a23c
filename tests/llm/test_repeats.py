"""Suffix arrays and repeated passages against brute force."""

import tracemalloc
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import repeats, suffix_array

from .helpers import AWKWARD, SCHEMA, frame, key, raw_words, sentence


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 5), st.sampled_from([4, 3000]))
def test_induced_sorting_sorts(values, times, sigma):
    t = (np.array(values * times) * (700 if sigma == 3000 else 1)).astype(np.int32)
    direct, suffix_array.DIRECT = suffix_array.DIRECT, 3
    try:
        sa = suffix_array.suffix_array(t, sigma)
    finally:
        suffix_array.DIRECT = direct
    full = t.tolist()
    assert sa.tolist() == sorted(range(len(full)), key=lambda i: full[i:])
    lcp, phi = suffix_array.permuted_lcp(t, sa)
    for i in range(len(full)):
        if phi[i] >= 0:
            k = 0
            while max(i, phi[i]) + k < len(full) and full[i + k] == full[phi[i] + k]:
                k += 1
            assert lcp[i] == k


def brute(docs, length):
    """Merged spans by (doc_id, text): every window of words that occurs again."""
    seen, out = defaultdict(int), set()
    for _, t in docs:
        w = raw_words(t)
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])] += 1
    for k, t in docs:
        w, spans = raw_words(t), []
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out |= {(k, t, a, b) for a, b in spans}
    return sorted(((k, a, b, b - a) for k, _, a, b in out), key=key)


def test_awkward_documents(spark):
    got = repeats.repeated_passages(frame(spark, AWKWARD)).collect()
    assert sorted(map(tuple, got), key=key) == brute(AWKWARD, repeats.LENGTH)


def test_shifted_and_edited_passages(spark):
    passage = sentence(1, 130, 3000)
    w = passage.split()
    docs = [(1, sentence(2, 40) + " " + passage), (2, passage + " " + sentence(3, 60)), (3, " ".join(w[:70] + ["edit"] + w[71:])), (4, " ".join(w[10:59])), (5, " ".join(w[10:60])), (6, sentence(4, 300)), (7, "\n".join(w[60:120]))]
    docs += [(8, " ".join(w[:55] + w[:55])), (9, "go " * 200), (10, "go " * 49), (11, "a b " * 60)]
    got = sorted(map(tuple, repeats.repeated_passages(frame(spark, docs)).collect()), key=key)
    assert got == brute(docs, repeats.LENGTH)
    assert {r[0] for r in got} >= {1, 2, 3, 5, 7, 8, 9, 11} and not {r[0] for r in got} & {4, 6}


def test_other_lengths(spark):
    docs = [(i, sentence(100 + i % 7, 60, 12)) for i in range(20)]
    for length, gram in ((5, 2), (9, 9), (20, 1)):
        got = sorted(map(tuple, repeats.repeated_passages(frame(spark, docs), length, gram).collect()), key=key)
        assert got == brute(docs, length)


def test_arrays_are_cut_between_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "ARRAY_WORDS", 200)
    docs = [(i, sentence(200 + i // 2, 150, 300)) for i in range(12)] + [(50 + i, sentence(200 + i, 140, 300) + " x" + str(i)) for i in range(6)]
    got = repeats.shard_spans  # the limit holds inside workers too only if they fork after this; the plain call is what is tested
    x = {"anchor": np.array([5, 5, 9, 9, 7], np.uint64), "doc": np.arange(5), "tag": np.zeros(5, np.int32), "begin": np.array([0, 3, 0, 0, 0], np.int32), "n": np.array([60, 60, 55, 57, 50], np.int32), "inner": np.zeros(5, np.int8)}
    base = np.arange(200, dtype=np.uint32)
    x["words"] = np.concatenate([base[:60], np.append(base[:59], np.uint32(900)), base[100:155], base[100:157], base[20:70]])
    found = got(x, 50)
    assert sorted(zip(found["doc"].tolist(), found["a"].tolist(), found["b"].tolist())) == [(0, 0, 59), (1, 3, 62), (2, 0, 55), (3, 0, 55)]
    assert sorted(map(tuple, repeats.repeated_passages(frame(spark, docs)).collect()), key=key) == brute(docs, repeats.LENGTH)


def test_equal_runs_send_their_words_once():
    base = np.arange(500, dtype=np.uint32)
    n = np.array([60, 55, 60, 60, 55, 57])
    starts = [0, 100, 0, 0, 100, 100]
    part = {"anchor": np.array([5, 9, 5, 5, 9, 9], np.uint64), "row": None, "begin": np.arange(6), "n": n, "inner": np.zeros(6, bool), "words": np.concatenate([base[a : a + k] for a, k in zip(starts, n)]), "doc": np.arange(6), "tag": np.zeros(6, np.int32)}
    del part["row"]
    batch = repeats._pack_runs([part], 1)
    x = {k: np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=v) for k, v in (repeats.RUN | {"words": np.dtype(np.uint32)}).items()}
    assert len(x["words"]) == 60 + 55 + 57 and x["copy"].sum() == 3
    both = {k: np.concatenate([v, v]) for k, v in x.items()}  # as of two batches
    found = repeats.shard_spans(both, 50)
    assert sorted({(d, a - d, b - d) for d, a, b in zip(found["doc"].tolist(), found["a"].tolist(), found["b"].tolist())}) == [(0, 0, 60), (1, 0, 55), (2, 0, 60), (3, 0, 60), (4, 0, 55), (5, 0, 57)]


def hot_shard(runs, n=90, shared=60):
    """Runs of one anchor: a shared passage, each time among other words, a few of which occur twice."""
    rng = np.random.default_rng(4)
    words = rng.integers(1000, 1 << 32, (runs, n), dtype=np.uint32)
    at = rng.integers(0, n - shared + 1, runs)
    for i, a in enumerate(at.tolist()):
        words[i, a : a + shared] = np.arange(shared)
    words[1::7, :at[0]] = words[0, :at[0]]
    return {"anchor": np.full(runs, 5, np.uint64), "doc": np.arange(runs), "tag": np.zeros(runs, np.int32), "begin": np.zeros(runs, np.int32), "n": np.full(runs, n, np.int32), "inner": np.zeros(runs, np.int8), "copy": np.zeros(runs, np.int8), "words": words.ravel()}


def test_a_hot_anchor_is_searched_as_a_suffix_array_would(monkeypatch):
    x = hot_shard(300)
    for length in (50, 60, 7):
        by_array = repeats.copied(x["words"], x["n"], length)
        for block in (100, 1 << 18):
            monkeypatch.setattr(repeats, "BLOCK", block)
            assert (repeats.copied_of_many(x["words"], x["n"], length) == by_array).all() and by_array.any()
    plain = repeats.shard_spans(x)
    monkeypatch.setattr(repeats, "ARRAY_WORDS", 200)
    hot = repeats.shard_spans(x)
    assert all((plain[k] == hot[k]).all() for k in plain)


def test_memory_of_a_hot_anchor_is_some_bytes_a_word():
    """A suffix array over all runs of the anchor took hundreds."""
    x = hot_shard(8000)
    tracemalloc.start()
    found = repeats.shard_spans(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(found["doc"])) == 8000
    assert peak < 80 * len(x["words"])


def test_boilerplate_in_every_document(spark):
    shared = sentence(9, 70, 3000)
    docs = [(i, sentence(1000 + i, 30, 3000) + " " + shared + " " + sentence(2000 + i, 30, 3000)) for i in range(300)]
    assert sorted(map(tuple, repeats.repeated_passages(frame(spark, docs)).collect()), key=key) == brute(docs, repeats.LENGTH)


def test_empty_table(spark):
    assert repeats.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
