"""Document quality: boosted trees over statistics of whole texts.

The statistics come from Arrow buffers in one narrow numpy stage.  The model is
fitted on the driver from at most ``MOST_LABELLED`` labelled documents (a hash
sample, the same on every run) and sent to the executors as flat arrays, whose
size depends on neither the corpus nor the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, common
from .words import RAW, Slice, slices

#: Labelled documents to fit on at most; the documented bound of the sample.
MOST_LABELLED = 20_000
#: Documents whose probability of good quality is under this are rejected.
THRESHOLD = 0.5

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "punctuation", "high", "space", "bar", "exclaim", "odd_ends", "distinct_words", "top_word", "distinct_pairs", "line_words", "distinct_ends", "long_words", "capital_starts",
)

_UPPER, _DIGIT, _PUNCT, _HIGH, _SPACE, _ALNUM = (np.zeros(256, dtype=bool) for _ in range(6))
for _b in range(256):
    _UPPER[_b] = 65 <= _b <= 90
    _DIGIT[_b] = 48 <= _b <= 57
    _HIGH[_b] = _b >= 0x80
    _SPACE[_b] = _b <= 32
    _ALNUM[_b] = _UPPER[_b] or _DIGIT[_b] or 97 <= _b <= 122 or _b >= 0x80
    _PUNCT[_b] = not _ALNUM[_b] and not _SPACE[_b]
_PLAIN_END = _ALNUM.copy()
_PLAIN_END[[ord(c) for c in ".,;:?!'\")"]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive offsets."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(flags, offsets[:-1][full], dtype=np.int64)
    return out


def _distinct(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values by row, and how often the most frequent one occurs."""
    if not len(row):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    key = np.sort((row.astype(np.uint64) << np.uint64(43)) | (hashes >> np.uint64(21)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    own = (key[first] >> np.uint64(43)).astype(np.int64)
    most = np.zeros(rows, dtype=np.int64)
    np.maximum.at(most, own, np.diff(np.concatenate([first, [len(key)]])))
    return np.bincount(own, minlength=rows), most


def statistics(s: Slice) -> np.ndarray:
    """(rows, FEATURES) of a slice of at most 2**21 rows."""
    rows, d, offsets = len(s), s.data, s.offsets
    size = np.diff(offsets)
    words = np.diff(s.first)
    length = s.ends - s.starts
    row = s.row_of_word()
    b, w = np.maximum(size, 1), np.maximum(words, 1)
    by_byte = lambda t: _sums(t[d], offsets) / b
    by_word = lambda flags: np.bincount(row, flags, minlength=rows) / w
    last = d[s.ends - 1] if len(s.ends) else np.zeros(0, np.uint8)
    distinct, top = _distinct(row, s.hashes, rows)
    pair = s.hashes[:-1] * np.uint64(3) + s.hashes[1:] if len(row) > 1 else np.zeros(0, np.uint64)
    within = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    pairs, _ = _distinct(row[:-1][within], pair[within], rows)
    ends, _ = _distinct(row, last.astype(np.uint64) << np.uint64(50), rows)
    newline, bar, exclaim = (_sums(d == c, offsets) for c in (10, ord("|"), ord("!")))
    return np.stack([
        np.log1p(size), np.log1p(words), by_word(length), by_byte(_UPPER), by_byte(_DIGIT), by_byte(_PUNCT), by_byte(_HIGH), by_byte(_SPACE), bar / b, exclaim / b,
        by_word(~_PLAIN_END[last]), distinct / w, top / w, pairs / np.maximum(words - 1, 1), words / (newline + 1), ends / w, by_word(length > 20), by_word(_UPPER[d[s.starts]]) if len(s.starts) else np.zeros(rows),
    ], axis=1).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, features): FEATURES of each text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1), RAW):
                x = statistics(s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.rows.start, len(s)), common.lists(x.ravel(), np.arange(len(s) + 1) * x.shape[1], pa.float32())], ["doc_id", "features"])

    return common.id_and_text(docs).mapInArrow(run, "doc_id bigint, features array<float>")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> boosting.Trees:
    """Trees fitted on the labelled documents, at most ``most`` labels of them (those with the smallest hashes).

    Labels without an id or a quality are left out; repeated rows count each.
    Without any labelled document the model gives even odds, so all documents
    stay.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most).collect()
    schema = "doc_id bigint, quality int"
    chosen = docs.sparkSession.createDataFrame(sample, schema)
    own = common.id_and_text(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")  # at most `most` ids
    found = features(own).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "features")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "features").limit(most).collect()  # of documents that are repeated, too, no more
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    x = np.array([r[2] for r in rows], dtype=np.float32).reshape(len(rows), len(FEATURES))
    return boosting.fit(x, np.array([1.0 if r[1] > 0 else 0.0 for r in rows]))


def score(docs: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, keep), a row for each row of docs: the probability of good quality, and whether it reaches the threshold.

    Null and empty texts are scored as empty texts, very long ones by all they
    hold; a null doc_id stays null; repeated rows are scored alike; other columns
    are ignored; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1), RAW):
                p = sent.value.probability(statistics(s))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.rows.start, len(s)), pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "keep"])

    return common.id_and_text(docs).mapInArrow(run, "doc_id bigint, score double, keep boolean")


def accepted(docs: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, all columns as they are.

    Cases as in `score`: null and empty texts are judged as empty texts, ids don't
    matter, repeated rows stay or go together, a score that ties with the threshold
    stays, an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [sent.value.probability(statistics(s)) >= threshold for s in slices(batch.column(at), RAW)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

    return common.map_rows(docs, run)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
