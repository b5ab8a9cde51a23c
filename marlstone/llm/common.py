"""What the operators share: tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable

NULL_ID = -(1 << 63)  # stands for a null doc_id where rows are ordered or joined


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset, in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors.

    What an application stored is deleted when it ends.
    """
    spark = df.sparkSession
    own = f"{shared_folder(spark)}/marlstone/{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(own)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    reachable(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, whatever other columns there are."""
    reachable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_rows(docs: DataFrame, run) -> DataFrame:
    """docs.mapInArrow(run) for a run that returns rows as they are, whatever the columns are called."""
    reachable(docs.sparkSession)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def blobs(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, type=pa.binary())


#: Bits of `bit_map`; a fixed size, whatever goes in.
MAP_BITS = 26
_MAP_PARTS = 16


def bit_map(keys: DataFrame) -> np.ndarray:
    """2**MAP_BITS bits, packed into bytes, with those of the keys (a column of 64-bit hashes) set."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            part = batch.column(1).to_numpy(zero_copy_only=False)
            cell = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - MAP_BITS)
            for p in np.unique(part).tolist():
                bits = found.setdefault(p, np.zeros((1 << MAP_BITS) // _MAP_PARTS, dtype=bool))
                bits[(cell[part == p] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), blobs([np.packbits(x).tobytes() for x in found.values()])], ["part", "bits"])

    out = np.zeros((1 << MAP_BITS) // 8, dtype=np.uint8)
    size = len(out) // _MAP_PARTS
    shift = 64 - (_MAP_PARTS.bit_length() - 1)
    split = keys.toDF("k").select("k", F.shiftrightunsigned("k", shift).cast("int").alias("part"))
    for part, bits in split.repartition(_MAP_PARTS, "part").mapInArrow(build, "part int, bits binary").collect():  # 2**MAP_BITS bits together
        out[part * size : (part + 1) * size] = np.frombuffer(bits, dtype=np.uint8)
    return out


def in_bit_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set: always for keys that went in."""
    cell = (keys.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
