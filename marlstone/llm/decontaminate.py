"""Benchmark decontamination with spaced seeds.

A mask looks at some of ``SPAN`` consecutive words and ignores the rest, so a
replaced word at an ignored place doesn't break a hit.  The masked hashes of all
benchmark items form a table that documents probe at every word under every
mask; so that no place of a short item (one in ``RUNS``) must agree, its
runs of a few words are seeds too, and a still shorter one is its own seed.  Together
they miss no pattern of differences that ``SHARE`` allows.  Each hit fixes an alignment of item and document, which is verified: the
document is contaminated by the item if, along that alignment, some ``WINDOW``
consecutive words (all of a shorter item) agree in at least ``SHARE`` of them.

The benchmark's size is measured first.  Up to ``SENT_WORDS`` words it is sent
to the executors; beyond, it is worked through in parts of that size, each a
pass over the documents, so no broadcast grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import FOLDED, Slice, mix, slices

SPAN = 8
MASKS = ((0, 1, 2, 4, 7), (0, 1, 4, 5, 7), (0, 2, 3, 6, 7))
#: Seeds of consecutive words for items of so many words; where 7 of 8, 8 of 9 or 8 of 10 agree, some run is as long.
RUNS = {8: (0, 1, 2, 3), 9: (0, 1, 2, 3), 10: (0, 1, 2)}
WINDOW = 13
SHARE = Fraction(4, 5)
SENT_WORDS = 2_000_000
_ODD = np.uint64(0xD6E8FEB86659FD93)


def masked(hashes: np.ndarray, mask: tuple[int, ...], span: int = SPAN) -> np.ndarray:
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.full(n, sum(1 << m for m in mask), dtype=np.uint64)
    for m in mask:
        acc *= _ODD
        acc += hashes[m : m + n]
    return mix(acc)


def seeds_of(n: int) -> list[tuple[tuple[int, ...], int]]:
    """(mask, span) for an item of n words.  Whatever words SHARE lets differ, one of them agrees somewhere; under SPAN words, all must."""
    if n < SPAN:
        return [(tuple(range(n)), n)] if n else []
    return [(mask, SPAN) for mask in MASKS] + ([(RUNS[n], len(RUNS[n]))] if n in RUNS else [])


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


class Seeds:
    """The masked hashes of some items, sorted, with a table of bits in front."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids = ids
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.words = np.concatenate([np.zeros(0, np.uint64), *words])
        found = []
        of = [seeds_of(len(w)) for w in words]
        #: The masks and their spans; those of short items only where there are any.
        self.masks = sorted({m for own in of for m in own})
        for item, w in enumerate(words):
            for mask, span in of[item]:
                h = masked(w, mask, span)
                found.append((h, np.full(len(h), item, np.int32), np.arange(len(h), dtype=np.int32)))
        self.hash, self.item, self.at = (np.concatenate([np.zeros(0, k), *x]) for k, x in zip((np.uint64, np.int32, np.int32), zip(*found) if found else ((), (), ())))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.at = self.hash[order], self.item[order], self.at[order]
        self.bits = max(16, int(len(self.hash)).bit_length() + 5)
        table = np.zeros(1 << self.bits, dtype=bool)
        table[self._cell(self.hash)] = True
        self.table = np.packbits(table)

    def _cell(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def alignments(self, s: Slice) -> np.ndarray:
        """Distinct (row, item, word of the document where the item would begin)."""
        out = [np.zeros((0, 3), np.int64)]
        for mask, span in self.masks:
            h = masked(s.hashes, mask, span)
            cell = self._cell(h)
            p = np.flatnonzero(self.table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)
            lo, hi = np.searchsorted(self.hash, h[p], "left"), np.searchsorted(self.hash, h[p], "right")
            n = hi - lo
            p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
            row = np.searchsorted(s.first, p, side="right") - 1
            inside = p + span <= s.first[row + 1]
            p, lo, n, row = p[inside], lo[inside], n[inside], row[inside]
            k = _spans(lo, n)
            out.append(np.stack([np.repeat(row, n), self.item[k], np.repeat(p - s.first[row], n) - self.at[k]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def verified(self, s: Slice, most: int = 1 << 22) -> list[tuple[int, int, int, int, int]]:
        """(row, item, matches, overlap, start) of the best alignment of each row and item that passes: most matches, then most overlap, then the first."""
        row, item, begin = self.alignments(s).T
        n = self.size[item]
        lo, hi = np.maximum(begin, 0), np.minimum(begin + n, np.diff(s.first)[row])
        width = np.minimum(WINDOW, n)
        row, item, begin, n, lo, hi, width = (v[hi - lo >= width] for v in (row, item, begin, n, lo, hi, width))
        size = hi - lo
        need = np.where(n < SPAN, n, -(-width * SHARE.numerator // SHARE.denominator))
        matches, best = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        ends = np.cumsum(size)
        a = 0
        while a < len(row):  # about ``most`` words at a time
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")), a + 1)
            k = slice(a, b)
            same = s.hashes[_spans(s.first[row[k]] + lo[k], size[k])] == self.words[_spans(self.first[item[k]] + lo[k] - begin[k], size[k])]
            run = np.concatenate([[0], np.cumsum(same)])
            start = np.cumsum(size[k]) - size[k]
            matches[k] = run[start + size[k]] - run[start]
            windows = size[k] - width[k] + 1
            at = _spans(start, windows)
            best[k] = np.maximum.reduceat(run[at + np.repeat(width[k], windows)] - run[at], np.cumsum(windows) - windows)
            a = b
        row, item, matches, size, lo = (v[best >= need] for v in (row, item, matches, size, lo))
        order = np.lexsort((lo, -size, -matches, item, row))
        row, item, matches, size, lo = (v[order] for v in (row, item, matches, size, lo))
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])[: len(row)]
        return list(zip(*(v[new].tolist() for v in (row, item, matches, size, lo))))


def _item_words(benchmark: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1), FOLDED):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.rows.start, len(s)), common.lists(s.hashes.view(np.int64), s.first, pa.int64())], ["item_id", "words"])

    common.reachable(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item_id bigint, words array<bigint>").filter(F.size("words") >= least)


def seed_tables(benchmark: DataFrame, most: int = SENT_WORDS, least: int = SPAN) -> Iterator[Seeds]:
    """The benchmark's seeds, in parts of about ``most`` words; of items of ``least`` words on."""
    items = _item_words(benchmark, least)
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = -(-total // most)
    for part in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == part)
        rows = sorted(own.collect(), key=lambda r: (r[0] is not None, r[0], r[1]))
        yield Seeds([r[0] for r in rows], [np.array(r[1], dtype=np.int64).view(np.uint64) for r in rows])


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = SENT_WORDS, least: int = SPAN) -> DataFrame:
    """(doc_id, item_id, n_match, n_overlap, start_word): every document and benchmark item that overlap.

    The best alignment of each pair: words that agree, words compared, and the
    document's word it begins at.  Of alignments that tie in the words that agree,
    the one with more words compared counts, then the first.  Words are folded.
    Items under ``SPAN`` words, if ``least`` lets them in, match where all their
    words stand in a row.  Items under ``least`` words (null and empty ones
    always) never match, nor do null and empty documents; very long texts are
    read whole; null ids stay null; repeated rows, of documents and of items, give
    repeated matches; other columns are ignored; an empty table gives none.
    """
    schema = "doc_id bigint, item_id bigint, n_match int, n_overlap int, start_word int"
    rows, found = common.id_and_text(docs), None
    for seeds in seed_tables(benchmark, most, least):
        sent = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(s.rows.start + r, sent.value.ids[i], *x) for s in slices(batch.column(1), FOLDED) for r, i, *x in sent.value.verified(s)]
                columns = list(zip(*hits)) if hits else [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])], ["doc_id", "item_id", "n_match", "n_overlap", "start_word"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, most: int = SENT_WORDS) -> DataFrame:
    """The rows of docs that no benchmark item overlaps, all columns as they are.

    Null and empty texts stay; rows are judged by themselves, so repeated rows
    stay or go together; a null doc_id, other columns and very long texts make no
    difference; an empty table stays empty.  An item under ``SPAN`` words is no
    reason to remove a text: so few words stand in a row by chance.
    """
    out = docs
    at = docs.columns.index("text")
    for seeds in seed_tables(benchmark, most):
        sent = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for s in slices(batch.column(at), FOLDED):
                    for row, *_ in sent.value.verified(s):
                        keep[s.rows.start + row] = False
                yield batch.filter(pa.array(keep))

        out = common.map_rows(out, run)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), least=1)
