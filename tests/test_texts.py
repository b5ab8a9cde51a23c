"""The text index against a plain version, and what it does with texts it has seen."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from marlstone.operators import fulltext


def plain_scores(rows, words, stop):
    docs = [(i, [t for t in re.split(r"[\W_]+", text.lower()) if t and not (stop and t in fulltext.STOP_WORDS)]) for i, text in rows if text is not None]
    n, length = len(docs), sum(len(ts) for _, ts in docs) / len(docs)
    df = {w: sum(w in ts for _, ts in docs) for w in words}
    out = []
    for i, ts in docs:
        tf = Counter(ts)
        if any(tf[w] for w in words):
            out.append((i, round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ts) / length)) for w in words), 9)))
    return sorted(out)


ROWS = [(f"d{i:03d}", text) for i, text in enumerate(
    [None, "", "...", "the of and", "Straße straße STRASSE", "licensed", "unlicensed licensed-to licensed", "ééé été É", "日本 語 日本", "1.5 x_y 𝒳𝒳 a-b", "licensed " * 50 + "other " * 30]
    + [" ".join(["word%d" % (i * j % 23) for j in range(i % 17)]) + " the licensed" * (i % 3 == 0) for i in range(120)]
)]


@pytest.mark.parametrize("stop", [True, False])
def test_plain_and_saved_indexes(spark, tmp_path, stop):
    df = spark.createDataFrame(ROWS, "k string, text string").repartition(3)
    index = fulltext.TextIndex(df, "k", "text", stop)
    saved = index.save(str(tmp_path / "index"))
    less = [r for r in ROWS if r[0] not in ("d005", "d014", "d000", "d001")]
    gone = spark.createDataFrame([("d005",), ("d014",), ("d001",)], "k string")
    for words in (["licensed"], ["licensed", "word3"], ["word3"], ["straße"], ["été"], ["日本"], ["qqqq"], ["licensed"]):
        for rows, indexes in ((ROWS, (index, saved)), (less, (index.delete(gone), saved.delete(gone)))):
            for x in indexes:
                assert sorted((r.k, round(r.score, 9)) for r in x.scores(" ".join(words)).collect()) == plain_scores(rows, words, stop), (words, x.path)
    assert index.count() == saved.count() == len(ROWS) - 1 and saved.delete(gone).count() == index.delete(gone).count() == len(ROWS) - 4


def test_counts_in_small_parts(monkeypatch):
    monkeypatch.setattr(fulltext, "RUNS_AT_ONCE", 5)
    monkeypatch.setattr(fulltext, "TERMS_AT_ONCE", 2)
    docs = [[], ["a", "b", ""], ["x"] * 12, ["b", "x", "the"], ["", ""], ["y", "x", "z", "b", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9, 15)), pa.array(docs, pa.list_(pa.string()))], ["id", "runs"])
    lengths, postings = {}, {}
    for r in pa.Table.from_batches(fulltext._packed([batch.slice(0, 0), batch], True)).to_pylist():
        if r["what"] == "lengths":
            lengths |= dict(zip(r["ids"], r["dl"]))
        else:
            postings |= {(r["term"], i): (dl, tf) for i, dl, tf in zip(r["ids"], r["dl"], r["tf"], strict=True)}
    own = {i: [t for t in ts if t not in ("", "a", "the")] for i, ts in enumerate(docs, 9)}
    assert lengths == {i: len(ts) for i, ts in own.items()}
    assert postings == {(t, i): (len(ts), ts.count(t)) for i, ts in own.items() for t in ts}


def test_texts_are_taken_apart_once(spark):
    df = spark.createDataFrame(ROWS, "k string, text string")
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    index = fulltext.TextIndex(df.coalesce(1).mapInArrow(seen, df.schema), "k", "text")
    assert index.score("d005", "licensed")[1] and index.score("d006", "licensed")[1]
    assert index.scores("licensed").count() == index.search("licensed", 1000).count()
    assert calls.value == len(ROWS)


def test_postings_are_shuffled_by_batch(spark, tmp_path):
    n = 2000
    df = spark.createDataFrame([(i, "aa bb cc dd ee ff gg hh") for i in range(n)], "id bigint, text string").coalesce(2)
    saved = fulltext.TextIndex(df, "id", "text").save(str(tmp_path / "x"))
    rows = sum(spark.read.parquet(f"{tmp_path}/x/{p.name}").count() for p in (tmp_path / "x").iterdir() if p.is_dir())
    assert rows <= 2 * 9 and saved.scores("aa").count() == n
