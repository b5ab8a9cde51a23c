"""Closed syncmers against a plain version, and their defining properties."""

from collections import Counter

from marlstone.llm import syncmers, words

from .helpers import AWKWARD, SCHEMA, frame, key, raw_words, sentence


def plain(text, k, s):
    """Positions of closed syncmers, by looking at every k-mer alone."""
    import numpy as np
    import pyarrow as pa

    w = raw_words(text)
    h = next(words.slices(pa.array([text or ""]))).hashes if text else np.zeros(0, np.uint64)
    fine = words.grams(h, s).tolist()
    out = []
    for i in range(len(w) - k + 1):
        inner = fine[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_positions_match_a_plain_version(spark):
    for k, s in ((16, 4), (6, 2), (3, 3)):
        got = syncmers.fingerprints(frame(spark, AWKWARD), k, s).collect()
        want = [(i, None, None) if t is None else (i, len(raw_words(t)), plain(t, k, s)) for i, t in AWKWARD]
        assert sorted([(r.doc_id, r.n_words, r.positions) for r in got], key=key) == sorted(want, key=key)
        assert all(r.fingerprints is None or len(r.fingerprints) == len(r.positions) for r in got)


def test_a_shared_passage_has_the_same_anchors(spark):
    passage = sentence(50, 80)
    docs = [(1, sentence(51, 33) + " " + passage + " " + sentence(52, 20)), (2, passage), (3, sentence(53, 5) + "\n" + passage)]
    got = {r.doc_id: dict(zip(r.positions, r.fingerprints)) for r in syncmers.fingerprints(frame(spark, docs)).collect()}
    for d, shift in ((1, 33), (3, 5)):
        assert {p + shift: f for p, f in got[2].items()}.items() <= got[d].items()
    gaps = sorted(got[2])
    assert max(b - a for a, b in zip(gaps, gaps[1:])) <= syncmers.K - syncmers.S + 1


def test_equal_kmers_have_equal_fingerprints(spark):
    r = syncmers.fingerprints(frame(spark, [(1, sentence(7, 3000, 40))]), 4, 2).first()
    w = raw_words(sentence(7, 3000, 40))
    by = {}
    for p, f in zip(r.positions, r.fingerprints):
        assert by.setdefault(tuple(w[p : p + 4]), f) == f
    assert len(set(by.values())) == len(by) and max(Counter(by.values()).values()) == 1


def test_empty_table(spark):
    assert syncmers.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_texts_and_copies_with_replaced_words_share_fingerprints(spark, tmp_path):
    w = sentence(9, 90).split()
    texts = [(n, " ".join(w[:n])) for n in range(1, 20)]
    copies = [(100 + n, "\n".join(w[:n])) for n in range(1, 20)]
    edited = [(200, " ".join(w)), (201, " ".join("new" if i % 11 == 10 else x for i, x in enumerate(w)))]
    frame(spark, [*texts, *copies, *edited, (300, None), (301, " ")]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in syncmers.op5_fingerprints(spark, str(tmp_path)).collect()}
    for n in range(1, 20):
        assert got[n].fingerprints and got[n].fingerprints == got[100 + n].fingerprints and got[n].positions == got[100 + n].positions
    assert len({got[n].fingerprints[0] for n in range(1, 6)}) == 5
    assert set(got[200].fingerprints) & set(got[201].fingerprints)
    assert got[300].fingerprints is None and got[301].fingerprints == []
