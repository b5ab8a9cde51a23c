"""Shuffling columns instead of rows.

Operators that exchange many small fixed-size entries pack all entries of an
Arrow batch that go to the same bucket into one row of binary columns.  The
shuffle then moves a few large values, and the receiving side gets whole numpy
arrays.  Buckets are a fixed multiple of the shuffle partitions, which a cluster
sets by its data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .words import mix

PER_PARTITION = 4


def schema(kinds: Mapping[str, np.dtype]) -> str:
    return "bucket int, " + ", ".join(f"{name} binary" for name in kinds)


def buckets(df_or_spark) -> int:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return PER_PARTITION * common.shuffle_partitions(spark)


def pack(key: np.ndarray, columns: Mapping[str, np.ndarray], count: int) -> pa.RecordBatch:
    """A row for each bucket that has entries; the bucket depends on the 64-bit key only."""
    bucket = (mix(key.astype(np.uint64)) % np.uint64(count)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(bucket)]]) if len(first) else first
    arrays = [pa.array(bucket[first], pa.int32())]
    for x in columns.values():
        x = np.ascontiguousarray(x[order])
        arrays.append(common.blobs([x[a:b].tobytes() for a, b in zip(first, last)]))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def pack_ragged(key: np.ndarray, columns: Mapping[str, np.ndarray], ragged: Mapping[str, tuple[np.ndarray, np.ndarray]], count: int) -> Iterator[pa.RecordBatch]:
    """As ``pack``, with columns of several values for each entry: (all values, how many each entry has)."""
    if not len(key):
        return
    bucket = (mix(key.astype(np.uint64)) % np.uint64(count)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    last = np.concatenate([first[1:], [len(bucket)]])
    arrays = [pa.array(bucket[first], pa.int32())]
    for x in columns.values():
        x = np.ascontiguousarray(x[order])
        arrays.append(common.blobs([x[a:b].tobytes() for a, b in zip(first, last)]))
    for values, length in ragged.values():
        begin, size = (np.cumsum(length) - length)[order], length[order]
        ends = np.concatenate([[0], np.cumsum(size)])
        x = values[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        arrays.append(common.blobs([x[a:b].tobytes() for a, b in zip(ends[first], ends[last])]))
    yield pa.RecordBatch.from_arrays(arrays, ["bucket", *columns, *ragged])


def per_bucket(packed: DataFrame, kinds: Mapping[str, np.dtype], work: Callable[[dict[str, np.ndarray]], pa.RecordBatch | None], out: str) -> DataFrame:
    """work() on the entries of each whole bucket; it returns a batch of schema ``out`` or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(parts: list[list[bytes]]) -> dict[str, np.ndarray]:
            return {name: np.frombuffer(b"".join(p), dtype=kind) for (name, kind), p in zip(kinds.items(), parts)}

        now, parts = None, [[] for _ in kinds]
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now:
                    if now is not None and (done := work(joined(parts))) is not None:
                        yield done
                    now, parts = bucket, [[] for _ in kinds]
                for p, column in zip(parts, batch.columns[1:]):
                    p.append(column[i].as_py())
        if now is not None and (done := work(joined(parts))) is not None:
            yield done

    n = common.shuffle_partitions(packed.sparkSession)
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, out)
