"""The quality classifier: held-out accuracy, traversal, awkward input."""

import numpy as np

from marlstone.llm import boosting, quality

from .helpers import AWKWARD, SCHEMA, frame, raw_words


def test_traversal_matches_walking_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    m = boosting.fit(x, y)
    assert ((m.probability(x) > 0.5) == y).mean() > 0.97
    for row in x[:40]:
        total = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert abs(m.margin(row[None])[0] - total) < 1e-9


def plain_statistics(text):
    b = (text or "").encode()
    words, n = raw_words(text), max(len(b), 1)
    w = max(len(words), 1)
    upper, digit, high, space = (lambda c: 65 <= c <= 90), (lambda c: 48 <= c <= 57), (lambda c: c >= 0x80), (lambda c: c <= 32)
    alnum = lambda c: upper(c) or digit(c) or high(c) or 97 <= c <= 122
    share = lambda of: sum(map(of, b)) / n
    count = lambda xs: max([xs.count(x) for x in set(xs)], default=0)
    pairs = set(zip(words, words[1:]))
    return [
        np.log1p(len(b)), np.log1p(len(words)), sum(map(len, words)) / w, share(upper), share(digit), share(lambda c: not alnum(c) and not space(c)), share(high), share(space), b.count(b"|") / n, b.count(b"!") / n,
        sum(not alnum(x[-1]) and x[-1:] not in b".,;:?!'\")" for x in words) / w, len(set(words)) / w, count(words) / w, len(pairs) / max(len(words) - 1, 1), len(words) / (b.count(b"\n") + 1), len({x[-1] for x in words}) / w, sum(len(x) > 20 for x in words) / w, sum(upper(x[0]) for x in words) / w,
    ]


def test_statistics_against_plain_ones(spark, sf):
    docs = [(k, t) for k, t in AWKWARD if t is None or len(t) < 200_000] + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    got = {r.doc_id: r.features for r in quality.features(frame(spark, docs)).collect()}
    for k, t in docs:
        np.testing.assert_allclose(got[k], plain_statistics(t), rtol=1e-5, atol=1e-6, err_msg=str(k))


def plain_fit(x, y, trees, depth, rate, bins, l2, least):
    """Boosting with loops: every split of every node tried one by one, the first best one taken."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    base = np.log((y.sum() + 1e-3) / (n - y.sum() + 1e-3))
    margin, out = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        nodes, splits = [np.arange(n)], []
        for _ in range(depth):
            below = []
            for rows in nodes:
                best = (1e-9, None, None)
                for j in range(k):
                    for e in edges[j]:
                        left = rows[x[rows, j] <= e]
                        right = rows[x[rows, j] > e]
                        if h[left].sum() < least or h[right].sum() < least:
                            continue
                        gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, j, e)
                splits.append(best[1:])
                below += [rows[x[rows, best[1]] <= best[2]], rows[x[rows, best[1]] > best[2]]] if best[1] is not None else [rows, rows[:0]]
            nodes = below
        leaves = [-rate * g[rows].sum() / (h[rows].sum() + l2) for rows in nodes]
        for rows, leaf in zip(nodes, leaves):
            margin[rows] += leaf
        out.append((splits, leaves))
    return base, out


def test_splits_against_trying_them_all():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    x[:, 2] = np.round(x[:, 2])  # many ties
    y = (x[:, 0] + 0.5 * x[:, 2] * (x[:, 1] > 0) + 0.3 * rng.normal(size=300) > 0).astype(float)
    how = {"trees": 5, "depth": 3, "rate": 0.3, "bins": 16, "l2": 1.0, "least": 1.0}
    m = boosting.fit(x, y, **how)
    base, want = plain_fit(x, y, **how)
    assert abs(m.base - base) < 1e-12
    for i, (splits, leaves) in enumerate(want):
        for node, (j, e) in enumerate(splits):
            if j is None:
                assert m.threshold[i, node] == np.inf
            else:
                assert m.feature[i, node] == j and m.threshold[i, node] == e
        np.testing.assert_allclose(m.leaf[i], leaves, atol=1e-9)


def test_one_class_and_no_rows():
    x = np.zeros((4, 3))
    assert (boosting.fit(x, np.ones(4)).probability(x) > 0.9).all()
    assert (boosting.fit(x, np.zeros(4)).probability(x) < 0.1).all()
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).probability(x).tolist() == [0.5] * 4


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    known = sorted((r.doc_id, r.quality) for r in labels.collect())
    model = quality.fit(docs, spark.createDataFrame(known[::2], "doc_id bigint, quality int"))
    scored = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = known[1::2]
    assert np.mean([scored[k].keep == (q == 1) for k, q in held]) >= 0.95
    assert np.mean([scored[k].keep for k, q in held if q == 1]) >= 0.97
    kept = {r.doc_id for r in quality.accepted(docs, model).collect()}
    assert kept == {k for k, r in scored.items() if r.keep}


def test_awkward_documents_and_labels(spark):
    docs = frame(spark, AWKWARD)
    labels = spark.createDataFrame([(7, 1, None, "x"), (7, 0, 1, "x"), (None, 1, 0, None), (4, None, 0, None), (99, 1, 1, None), (11, 0, 0, None)], "doc_id bigint, quality int, toxic int, text string")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    unlabelled = quality.fit(docs, labels.limit(0))
    assert quality.accepted(docs, unlabelled).count() == len(AWKWARD)
    assert quality.score(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert quality.accepted(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_the_sample_is_bounded(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, quality int")
    assert quality.fit(docs, labels, most=10).base is not None
