"""Corpus-wide word frequencies in a table of fixed size.

Prefix filtering needs *some* total order of words that all texts share, and
works best with rare words first.  Words are counted over all documents in
2**bits hashed cells, so what executors are sent has the same size at any scale;
words that share a cell share a frequency and are then ordered by hash.  The
order is total whatever the cells hold, so results are exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .words import RAW, slices

BITS = 20
PARTS = 16


def cells(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def word_counts(docs: DataFrame, byte_table: np.ndarray = RAW, bits: int = BITS) -> np.ndarray:
    """How many words of docs fall into each cell; zeros for an empty table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for s in slices(batch.column(0), byte_table):
                np.add.at(found, cells(s.hashes, bits), np.uint32(1))
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), common.blobs([x.tobytes() for x in np.split(found, PARTS)])], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sums.setdefault(part, np.zeros((1 << bits) // PARTS, dtype=np.uint64))
                own += np.frombuffer(counts.as_buffer(), dtype=np.uint32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), common.blobs([x.tobytes() for x in sums.values()])], ["part", "counts"])

    schema = "part int, counts binary"
    common.reachable(docs.sparkSession)
    total = np.zeros(1 << bits, dtype=np.uint64)
    size = (1 << bits) // PARTS
    for part, counts in docs.select(docs["text"].cast("string")).mapInArrow(count, schema).repartition(PARTS, "part").mapInArrow(add, schema).collect():
        total[part * size : (part + 1) * size] = np.frombuffer(counts, dtype=np.uint64)
    return total


def levels(counts: np.ndarray) -> np.ndarray:
    """The counts on a logarithmic scale of 256 levels, rare first."""
    return np.minimum(255, np.log2(np.maximum(counts, 1).astype(np.float64)) * 8).astype(np.uint8)
