"""Line deduplication and the license scan against comparing everything."""

from fractions import Fraction

import numpy as np
import pytest

from marlstone.llm import frequency, license_scan, line_dedup

from .helpers import AWKWARD, SCHEMA, folded_words, frame, key, raw_words, sentence


def text_hash(spark, texts):
    """Spark's xxhash64 of texts, which orders rows of one id."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts if t is not None], "t string").distinct()
    return {r[0]: r[1] >> 32 for r in df.select("t", F.xxhash64("t")).collect()}


def brute(spark, docs, t):
    order = text_hash(spark, [x for _, x in docs])
    lines, out = [], []
    for k, text in set(docs):
        if text is not None:
            for n, line in enumerate(text.split("\n")):
                lines.append(((k is not None, k or 0, order[text], n), frozenset(raw_words(line)), (k, text, n)))
    lines.sort(key=lambda x: x[0])
    gone = set()
    for i, (_, a, own) in enumerate(lines):
        for _, b, _ in lines[:i]:
            both = len(a & b)
            if both and both * t.denominator >= (len(a) + len(b) - both) * t.numerator:
                gone.add(own)
                break
    for k, text in docs:
        out.append((k, text if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (k, text, n) not in gone)))
    return out


@pytest.mark.parametrize(("t", "how"), [(Fraction(9, 10), {}), (Fraction(1, 2), {}), (Fraction(1), {}), (Fraction(9, 10), {"first": 1, "hot": 1, "split": 1}), (Fraction(1, 2), {"first": 1, "hot": 8, "split": 2})])
def test_removed_lines(spark, t, how):
    docs = [(k, x) for k, x in AWKWARD if x is None or len(x) < 5000]
    base = sentence(1, 20).split()
    docs += [(30 + i, "\n".join([" ".join(base[:i] + ["new"] + base[i + 1 :]), sentence(40 + i, 6, 8), sentence(60 + i, 3, 4), "Of."])) for i in range(12)]
    words = sentence(41, 400, 60).split()
    docs += [(200 + i, "\n".join(" ".join(sorted(set(words[i : i + 24 + j]))) for j in range(3))) for i in range(0, 120, 2)]
    docs += [(60, "a b c d e f g h i j\nj i h g f e d c b a\na b c d e f g h i k\n\n\nx"), (61, "x\r\nX\n x ")]
    docs_frame = frame(spark, docs)
    got = line_dedup.deduplicated(docs_frame, t, **how)
    assert got.columns == docs_frame.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(brute(spark, docs, t), key=key)


def test_long_lines_and_counts(spark):
    long = sentence(5, 30_000, 20_000)
    docs = [(1, long), (2, long + " extra"), (3, "short line here"), (4, "short line here")]
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.deduplicated(frame(spark, docs)).collect()}
    assert got[1][0] == long and got[2] == ("", 0) and got[3][0] == "short line here" and got[4] == ("", 0)


def test_very_long_texts_and_lines(spark):
    many = "\n".join(sentence(i % 700, 12, 90) for i in range(3000))
    docs = [(1, many), (2, many[: len(many) // 2]), (3, "x y z\n" * 4000)]
    got = line_dedup.deduplicated(frame(spark, docs))
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(brute(spark, docs, line_dedup.THRESHOLD), key=key)


def bucket(lines, t=line_dedup.THRESHOLD, **how):
    """The matches of lines (arrays of distinct words, rare first) that all meet in one bucket."""
    n = np.array([len(x) for x in lines])
    words = np.concatenate(lines)
    first = np.cumsum(n) - n
    keep = np.minimum(line_dedup.prefix(n, t) + 1, n)
    bit = np.uint64(1) << (line_dedup.mix(words.copy()) >> np.uint64(58))
    x = {"doc": np.arange(len(n)), "tag": np.zeros(len(n), np.int32), "line": np.zeros(len(n), np.int32), "size": n.astype(np.int32), "set": np.add.reduceat(line_dedup.mix(words.copy()), first), "map1": np.bitwise_xor.reduceat(bit, first), "map2": np.zeros(len(n), np.uint64), "keep": keep, "words": words[line_dedup._spans(first, keep)]}
    x, gone = line_dedup.collapsed(x)
    entries, tail = line_dedup.prefix_entries(x, t, 256)
    entries |= {"tail": tail, **{k: v.astype(line_dedup.KINDS[k]) for k, v in gone.items()}}
    return line_dedup.bucket_matches(entries, t, **how).to_pandas()


def test_copies_and_hot_words_take_linear_time():
    import time

    def seconds(make, n):
        lines = make(n)
        began = time.perf_counter()
        found = bucket(lines)
        return time.perf_counter() - began, found

    line = np.arange(1, 21, dtype=np.uint64)
    took, found = seconds(lambda n: [line] * n, 100_000)
    assert took < 5 and len(found) == 99_999 and found.same.all()
    rng = np.random.default_rng(4)
    # One word that all lines share, then words of their own.
    hot = lambda n: [np.concatenate([[np.uint64(1)], np.sort(rng.integers(2, 1 << 40, 19).astype(np.uint64))]) for _ in range(n)]
    seconds(hot, 1000)
    small, large = (seconds(hot, n)[0] for n in (5000, 20_000))
    assert large < 8 * small + 1
    # Lines of one form, which are all alike.
    form = lambda n: [np.concatenate([[np.uint64(i + 1)], np.uint64(1 << 40) + np.arange(39, dtype=np.uint64)]) for i in range(n)]
    took, found = seconds(form, 20_000)
    assert took < 20 and len(set(found.doc)) == 19_999 and len(found) < 20_000 * 8 * 12


def test_the_bitmap_filter_never_rejects_a_match():
    rng = np.random.default_rng(3)
    t = Fraction(4, 5)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        a = rng.integers(0, 1 << 40, n).astype(np.uint64)
        b = a.copy()
        b[: n // 8] += np.uint64(1)
        sets = [np.unique(x) for x in (a, b)]
        both = len(np.intersect1d(*sets))
        if both * 5 >= (len(sets[0]) + len(sets[1]) - both) * 4:
            maps = [np.bitwise_xor.reduce(np.uint64(1) << (line_dedup.mix(x.copy()) >> np.uint64(58))) for x in sets]
            total = len(sets[0]) + len(sets[1])
            assert total - int(np.bitwise_count(maps[0] ^ maps[1])) >= 2 * int(line_dedup.needed(np.array([total]), t)[0])


def test_word_counts_cover_all_documents(spark):
    docs = frame(spark, AWKWARD)
    assert frequency.word_counts(docs).sum() == sum(len(raw_words(t)) for _, t in AWKWARD)
    assert frequency.word_counts(spark.createDataFrame([], SCHEMA)).sum() == 0


def test_empty_table(spark):
    assert line_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_scan(spark):
    notice = license_scan.TEMPLATES["apache-2.0-notice"]
    docs = [*AWKWARD, (100, "intro\n" + notice + "\nReleased under the MIT License."), (101, " ".join(notice.split()[:-4])), (102, "released UNDER the (MIT) license!"), (102, "released UNDER the (MIT) license!"), (103, "under the license"), (None, "Licensed under CC BY-NC 4.0."), (104, " ".join(notice.split()[:10]))]
    templates = license_scan.TEMPLATES | {"none": "...", "one": "word"}
    got = license_scan.scan(frame(spark, docs), templates).collect()
    want = []
    for k, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            block = set(folded_words(line))
            for label, template in templates.items():
                t = set(folded_words(template))
                both = len(t & block)
                if t and both * 5 >= len(t) * 4:
                    want.append((k, n, label, both, len(t)))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {(100, "apache-2.0-notice"), (100, "mit"), (102, "mit"), (None, "cc-by-nc-4.0"), (4, "one")} <= {(r.doc_id, r.license) for r in got}


def test_wrapped_notices(spark):
    import textwrap

    long = ["apache-2.0-notice", "mit-grant", "gpl-3.0-notice", "bsd-3-clause"]
    docs = [(10 * i + j, "intro\nof the\n" + "\n".join(" * " + x for x in textwrap.wrap(license_scan.TEMPLATES[n], width)) + "\n" + sentence(i, 50)) for i, n in enumerate(long) for j, width in enumerate((72, 46))]
    docs += [(100, license_scan.TEMPLATES["mit-grant"]), (101, sentence(1, 200)), (102, None), (103, "Released under\n" + sentence(2, 60) + "\nthe MIT License")]
    got = {(r.doc_id, r.license, r.line_no, r.n_common == r.n_template) for r in license_scan.scan_wrapped(frame(spark, docs)).collect()}
    assert {(k, x) for k, x, *_ in got if x in long} == {(10 * i + j, n) for i, n in enumerate(long) for j in range(2)}
    assert all(line in (1, 2) and full for _, x, line, full in got if x in long)
    assert not {k for k, *_ in got if k >= 100}
    assert license_scan.scan_wrapped(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_templates_in_parts(spark, monkeypatch):
    """Hundreds of templates, by an inverted index and in parts, against comparing all with all."""
    templates = {f"t{i}": sentence(3000 + i, 5 + i % 30, 800) for i in range(300)}
    docs = [(i, "\n".join([sentence(4000 + i, 12, 800), templates[f"t{i}"], " ".join(templates[f"t{i + 100}"].split()[: 4 + i % 30]), sentence(i, 300, 800)])) for i in range(40)]
    want = []
    sets = {k: set(folded_words(t)) for k, t in templates.items()}
    for k, text in docs:
        for n, line in enumerate(text.split("\n")):
            block = set(folded_words(line))
            want += [(k, n, label, len(t & block), len(t)) for label, t in sets.items() if len(t & block) * 5 >= len(t) * 4]
    whole = sorted(map(tuple, license_scan.scan(frame(spark, docs), templates).collect()), key=key)
    assert whole == sorted(want, key=key)
    wrapped = sorted(map(tuple, license_scan.scan_wrapped(frame(spark, docs), templates).collect()), key=key)
    monkeypatch.setattr(license_scan, "MOST_WORDS", 400)
    assert sorted(map(tuple, license_scan.scan(frame(spark, docs), templates).collect()), key=key) == whole
    assert sorted(map(tuple, license_scan.scan_wrapped(frame(spark, docs), templates).collect()), key=key) == wrapped


def test_full_texts_that_are_wrapped(spark):
    import textwrap

    full = [k for k in license_scan.TEMPLATES if k.endswith("-full")]
    docs = [(i, sentence(i, 40) + "\n\n" + textwrap.fill(license_scan.TEMPLATES[k], 70) + "\n\n" + sentence(50 + i, 40)) for i, k in enumerate(full)]
    got = {(r.doc_id, r.license) for r in license_scan.scan_wrapped(frame(spark, docs)).collect()}
    assert {(i, k) for i, k in enumerate(full)} <= got and len(full) >= 3


def test_too_many_templates_are_refused(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        license_scan.scan(frame(spark, []), {"a": "one two three four"})
