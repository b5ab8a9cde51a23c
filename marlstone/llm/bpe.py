"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts up to ``chunk`` characters are encoded where they are read.  A longer one
becomes rows of overlapping chunks that are pre-tokenised in parallel; in each
overlap, the first pre-token boundary that both neighbours have is where they
resynchronise (from there on both split alike), and the pieces between these
points are encoded in parallel and joined.  A boundary after white space is no
such point: alone, the piece before it would split its last spaces otherwise.  A text in which some overlap has no
common boundary (a run of one character class that is longer than the overlap)
is encoded as a whole, so the result is always that of the plain encoding.
Decoding looks ids up in a table of raw bytes and concatenates them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vocabulary

CHUNK = 1 << 16  # characters
OVERLAP = 1 << 11


def encode_text(text: str, path: str = vocabulary.RANKS_PATH) -> np.ndarray:
    return vocabulary.encoding(path).encode_to_numpy(text).astype(np.int32)


def decode_ids(ids: np.ndarray, path: str = vocabulary.RANKS_PATH) -> bytes:
    """The concatenated raw bytes of the tokens."""
    table, start, length = vocabulary.token_bytes(path)
    if not len(ids):
        return b""
    n = length[ids]
    ends = np.cumsum(n)
    return table[np.repeat(start[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


def resync(left: np.ndarray, right: np.ndarray) -> int:
    """The first boundary that both have, -1 if there is none."""
    both = np.intersect1d(left, right)
    return int(both[0]) if len(both) else -1


def _boundaries(body: str, last: bool) -> np.ndarray:
    """Starts of the pre-tokens, without those after white space; the end of a cut-off chunk can't be trusted, so its last two are left out."""
    at = np.fromiter((m.start() for m in vocabulary.splitter().finditer(body)), dtype=np.int64)
    at = at if last else at[:-2]
    return at[[i == 0 or not body[i - 1].isspace() for i in at.tolist()]] if len(at) else at


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoding(path).encode_to_numpy
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [encode(t) if t is not None else None for t in part.column(1).to_pylist()]
                n = np.fromiter((0 if x is None else len(x) for x in ids), dtype=np.int64, count=len(ids))
                none = pa.array([x is None for x in ids], pa.bool_())
                flat = np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)]).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=none) if none.true_count else pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["doc_id", "token_ids"])

    return run


def _edges(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for part, parts, body in zip(*(batch.column(c).to_pylist() for c in ("part", "parts", "body"))):
                at = _boundaries(body, part == parts - 1)
                heads.append((at[at < overlap] + part * chunk).tolist())
                tails.append((at[at >= chunk] + part * chunk).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*batch.schema.names, "head", "tail"])

    return run


def _pieces(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            ids = []
            for part, body, lo, hi in zip(x["part"], x["body"], x["lo"], x["hi"]):
                piece = body[lo - part * chunk : None if hi is None else hi - part * chunk]
                ids.append(encode_text(piece, path).tolist())
            keep = batch.select(["doc_id", "key", "copies", "part"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(ids, pa.list_(pa.int32()))], [*keep.schema.names, "ids"])

    return run


def _encode_long(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    # Rows that are alike are encoded once; the rest of the rows tell how often.
    own = long.groupBy("doc_id", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    parts = F.ceil(F.length("text") / chunk).cast("int")
    cut = own.select("doc_id", "key", "copies", parts.alias("parts"), "text", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select("doc_id", "key", "copies", "parts", "part", F.substring("text", F.col("part") * chunk + 1, F.lit(chunk + overlap)).alias("body"))
    edged = cut.mapInArrow(_edges(chunk, overlap), "doc_id bigint, key bigint, copies bigint, parts int, part int, body string, head array<bigint>, tail array<bigint>")
    w = Window.partitionBy("doc_id", "key").orderBy("part")
    common_at = lambda a, b: F.array_min(F.array_intersect(a, b))
    synced = edged.withColumn("lo", F.when(F.col("part") == 0, F.lit(0).cast("bigint")).otherwise(common_at(F.lag("tail").over(w), F.col("head"))))
    synced = synced.withColumn("hi", F.lead("lo").over(w)).withColumn("broken", F.max(F.col("lo").isNull()).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pieces = synced.filter(~F.col("broken")).select("doc_id", "key", "copies", "part", "body", "lo", "hi").mapInArrow(_pieces(path, chunk), "doc_id bigint, key bigint, copies bigint, part int, ids array<int>")
    joined = pieces.groupBy("doc_id", "key").agg(F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p")).select("doc_id", "copies", F.flatten(F.col("p.ids")).alias("token_ids"))
    joined = joined.select("doc_id", "token_ids", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("col")
    broken = synced.filter(F.col("broken") & (F.col("part") == 0)).select(F.col("doc_id").alias("b_id"), F.col("key").alias("b_key"))
    whole = long.join(broken, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.xxhash64("text") == F.col("b_key")), "left_semi")
    return joined.unionByName(whole.mapInArrow(_encoder(path), "doc_id bigint, token_ids array<int>"))


def encode(docs: DataFrame, path: str = vocabulary.RANKS_PATH, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, token_ids, n_tokens), a row for each row of docs.

    A null text gives null ids and a null count, an empty one an empty list, a very
    long one the ids of the whole; a null doc_id stays null; repeated rows are
    encoded each; other columns are ignored; an empty table gives none.
    """
    rows = common.id_and_text(docs)
    short = rows.filter(F.length("text").isNull() | (F.length("text") <= chunk))
    long = rows.filter(F.length("text") > chunk)
    ids = short.mapInArrow(_encoder(path), "doc_id bigint, token_ids array<int>").unionByName(_encode_long(long, path, chunk, overlap))
    return ids.select("doc_id", "token_ids", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).cast("bigint").alias("n_tokens"))


def _raw(column: pa.ListArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows' tokens one after another, and where each row's begin and end."""
    table, start, length = vocabulary.token_bytes(path)
    ids = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(len(rows), np.int64)
    size = length[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    return table[np.repeat(start[ids] - ends[:-1], size) + np.arange(ends[-1])], ends[rows]


def decode(encoded: DataFrame, path: str = vocabulary.RANKS_PATH) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids): the tokens' raw bytes one after another, as UTF-8.

    Null ids give a null text, no ids an empty one; bytes that aren't UTF-8 (of
    ids that no text has) give replacement characters.  A null doc_id stays null,
    repeated rows are decoded each, very long ones whole; other columns are ignored;
    an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data, cut = _raw(part.column(1), path)
                text = [None if null else data[a:b].tobytes().decode("utf-8", "replace") for null, a, b in zip(part.column(1).is_null().to_pylist(), cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id bigint, text string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, decoded_chars, decoded_hash): every document encoded, and what decoding its ids gives back."""
    return checked(encode(common.table(spark, sf_dir, "documents")))


def checked(encoded: DataFrame, path: str = vocabulary.RANKS_PATH) -> DataFrame:
    """encoded, with the length and the xxhash64 (Spark's, of the UTF-8 bytes) of each decoded text.

    Null ids give nulls, no ids the empty text's; a null doc_id stays null; repeated
    rows stay; very long texts are decoded whole; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                column = part.column(1)
                data, cut = _raw(column, path)
                text = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data))
                nulls = column.is_null()
                if nulls.true_count:
                    text = pc.if_else(nulls, pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, "doc_id bigint, token_ids array<int>, n_tokens bigint, decoded string").select("doc_id", "token_ids", "n_tokens", F.length("decoded").cast("bigint").alias("decoded_chars"), F.when(F.col("decoded").isNotNull(), F.xxhash64("decoded")).alias("decoded_hash"))
