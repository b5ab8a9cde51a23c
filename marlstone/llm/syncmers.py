"""Closed-syncmer fingerprints over words.

A k-mer of words is chosen if the smallest hash among its inner s-mers lies at
its first or last place.  Whether it is depends on the k-mer alone, never on its
neighbours, so a passage has the same anchors wherever it occurs, at the same
distances: matching (fingerprint, position difference) pairs aligns texts.  Of
k - s + 1 inner places two count, so about 2 / (k - s + 1) of the k-mers are
kept, and any k - s + 1 consecutive k-mers hold at least one: a shared passage
of 2k - s words always has an anchor.  A shorter text may have none; it can have
one fingerprint of all its words instead.  Everything is numpy over Arrow buffers in one narrow stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .words import RAW, Slice, grams, slices, sliding_min

K, S = 6, 2


def chosen(s: Slice, k: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word position and fingerprint of each closed syncmer of a slice."""
    fine, coarse = grams(s.hashes, inner), grams(s.hashes, k)
    lowest = sliding_min(fine, k - inner + 1)
    at = np.flatnonzero((fine[: len(coarse)] == lowest) | (fine[k - inner : k - inner + len(coarse)] == lowest)) if len(coarse) else np.zeros(0, np.int64)
    row = np.searchsorted(s.first, at, side="right") - 1
    inside = at + k <= s.first[row + 1]
    at, row = at[inside], row[inside]
    return row, at - s.first[row], coarse[at]


def with_whole(s: Slice, k: int, inner: int, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``chosen`` found, and for each row with words but no syncmer a fingerprint of all its words at position 0."""
    row, position, print_ = found
    size = np.diff(s.first)
    bare = np.flatnonzero((np.bincount(row, minlength=len(s)) == 0) & (size > 0))
    more = np.zeros(len(bare), dtype=np.uint64)
    for n in np.unique(size[bare]).tolist():  # under 2k - inner words
        own = size[bare] == n
        more[own] = grams(s.hashes[s.first[bare[own]][:, None] + np.arange(n)].ravel(), n)[::n]
    rows = np.concatenate([row, bare])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([position, np.zeros(len(bare), position.dtype)])[order], np.concatenate([print_, more])[order]


def fingerprints(docs: DataFrame, k: int = K, inner: int = S, whole: bool = False) -> DataFrame:
    """(doc_id, n_words, positions, fingerprints), a row for each row of docs.

    ``positions`` are word offsets in ascending order, ``fingerprints`` the
    k-mers' hashes there.  A tie of two inner minima counts if either lies at an
    edge.  Texts under k words (the empty one too) have empty lists, but with
    ``whole``, a text of words without any syncmer has one fingerprint of them all
    at position 0; a very long text has all its fingerprints; a null text has nulls;
    a null doc_id stays null; repeated rows give repeated rows; other columns are
    ignored; an empty table gives none.
    """
    if not 0 < inner <= k:
        raise ValueError("inner must be from 1 to k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for s in slices(text, RAW):
                found = chosen(s, k, inner)
                row, position, print_ = with_whole(s, k, inner, found) if whole else found
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(s)))]).astype(np.int32))
                null = text.slice(s.rows.start, len(s)).is_null()
                mask = {"mask": null} if null.true_count else {}
                words = pa.array(np.diff(s.first), mask=null.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.rows.start, len(s)), words, pa.ListArray.from_arrays(offsets, pa.array(position.astype(np.int32)), **mask), pa.ListArray.from_arrays(offsets, pa.array(print_.view(np.int64)), **mask)], ["doc_id", "n_words", "positions", "fingerprints"])

    return common.id_and_text(docs).mapInArrow(run, "doc_id bigint, n_words bigint, positions array<int>, fingerprints array<bigint>")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"), whole=True)
