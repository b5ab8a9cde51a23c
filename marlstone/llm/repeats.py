"""Repeated passages by suffix arrays over content-defined shards.

Passages are ``LENGTH`` consecutive words.  The least hash of the word q-grams
in a passage is its *anchor*: it depends on the passage alone, so all copies of
a passage, wherever they are, meet in the shard of that anchor, and shards can
be searched independently without losing any.

1. Anchors are counted over all documents; those that occur once can't have a
   repeated passage.
2. Documents that have repeated anchors send, for each run of passages with the
   same anchor, the run's words to the anchor's shard.
   Runs of equal words are collapsed where they are read, so boilerplate sends its
   words once for each batch of documents, however many have it.
3. In a shard, runs of equal words are collapsed again, a suffix array of the rest is
   induced, and the permuted common prefixes tell which passages have a copy.
   Suffix arrays are bounded: the runs of an anchor that has too many words for one
   are compared by the hashes of all their passages instead, with the same result.
4. Overlapping repeated passages of a document are merged into spans.

Words are compared by 32 bits of their hashes, so two different words are taken
as equal once in four billion comparisons; a passage has 50.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks, common
from .line_dedup import _place
from .suffix_array import permuted_lcp, suffix_array
from .words import RAW, Slice, grams, mix, slices, sliding_min

LENGTH = 50
GRAM = 16
#: Words that one suffix array is built over at most; it takes up to about 0.6 kB for each.
ARRAY_WORDS = 64_000
#: Words, or hashes of passages, that are worked on at once where only a few bytes for each are kept.
BLOCK = 1 << 18

COUNTED = {"anchor": np.dtype(np.uint64), "doc": np.dtype(np.int64), "tag": np.dtype(np.int32)}


def anchors(s: Slice, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: places where passages begin, their anchors, and the places of words whose q-gram is an anchor."""
    n = len(s.hashes)
    h = grams(s.hashes, gram)
    width = length - gram + 1
    least = sliding_min(h, width)
    row = s.row_of_word()
    starts = np.flatnonzero(np.arange(len(least)) + length <= s.first[row[: len(least)] + 1]) if len(least) else np.zeros(0, np.int64)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    # A q-gram is chosen if it is the least of a passage around it: not over the greatest least of these.
    padded = np.full(len(h) + width - 1, ~np.uint64(0))
    padded[starts + width - 1] = ~least[starts]
    greatest = ~sliding_min(padded, width)  # [p]: over passages that begin from p - width + 1 to p
    picked = np.flatnonzero((h <= greatest) & (greatest != 0))
    return starts, least[starts], picked[picked + gram <= n]


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, tag, anchors): of each document with any, its anchors that occur more than once in all documents."""
    count = blocks.buckets(docs)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            found: list[tuple[np.ndarray, ...]] = []
            for s in slices(batch.column(2), RAW):
                _, _, picked = anchors(s, length, gram)
                row = np.searchsorted(s.first, picked, side="right") - 1 + s.rows.start
                found.append((grams(s.hashes, gram)[picked], doc[row], tag[row]))
            if found:
                x = dict(zip(COUNTED, map(np.concatenate, zip(*found))))
                yield blocks.pack(x["anchor"], x, count)

    def repeated(x: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        order = np.lexsort((x["tag"], x["doc"], x["anchor"]))
        a, doc, tag = (x[k][order] for k in COUNTED)
        twice = np.concatenate([[False], a[1:] == a[:-1]]) if len(a) else np.zeros(0, bool)
        twice[:-1] |= twice[1:]
        a, doc, tag = a[twice], doc[twice], tag[twice]
        if not len(a):
            return None
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        order = np.lexsort((tag[new], doc[new]))
        a, doc, tag = a[new][order], doc[new][order], tag[new][order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(tag[first]), common.lists(a.view(np.int64), np.concatenate([first, [len(a)]]), pa.int64())], ["doc", "tag", "anchors"])

    packed = docs.select(*_place(docs), F.col("text").cast("string").alias("text")).mapInArrow(spread, blocks.schema(COUNTED))
    found = blocks.per_bucket(packed, COUNTED, repeated, "doc bigint, tag int, anchors array<bigint>")
    return found.groupBy("doc", "tag").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))


RUN = {"anchor": np.dtype(np.uint64), "doc": np.dtype(np.int64), "tag": np.dtype(np.int32), "begin": np.dtype(np.int32), "n": np.dtype(np.int32), "inner": np.dtype(np.int8), "copy": np.dtype(np.int8)}


def _runs(s: Slice, mine: tuple[np.ndarray, np.ndarray], length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of passages with one anchor, of the anchors in ``mine`` (rows of the slice, anchors): RUN without doc and tag, with row and the words."""
    starts, least, picked = anchors(s, length, gram)
    row = np.searchsorted(s.first, starts, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(starts) else starts
    stop = np.concatenate([new[1:], [len(starts)]]) if len(new) else new
    together = lambda r, a: mix(a ^ mix(r.astype(np.uint64) + np.uint64(1)))
    wanted = np.isin(together(row[new], least[new]), together(*mine))
    new, stop = new[wanted], stop[wanted]
    begin = starts[new]
    size = stop - new + length - 1
    # How often the anchor itself occurs in the run: a run with one has no repeat within.
    chosen = np.zeros(len(s.hashes) + 1, dtype=np.int64)
    chosen[picked + 1] = 1
    chosen = np.cumsum(chosen)
    inner = (chosen[begin + size - gram + 1] - chosen[begin]) > 1
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return {"anchor": least[new], "row": row[new], "begin": begin - s.first[row[new]], "n": size, "inner": inner, "words": (s.hashes[at] >> np.uint64(32)).astype(np.uint32)}


def _blocks(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of runs that have about BLOCK words together."""
    ends, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, side="right")), lo + 1)
        yield lo, hi
        lo = hi


def _identity(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of position-mixed words for each run of n words; runs of equal words, and only they, have equal ones."""
    one, two = np.empty(len(n), np.uint64), np.empty(len(n), np.uint64)
    at = 0
    for lo, hi in _blocks(n):
        size = n[lo:hi]
        first = np.cumsum(size) - size
        own = words[at : at + size.sum()].astype(np.uint64) << np.uint64(31)
        at += len(own)
        place = (np.arange(len(own)) - np.repeat(first, size)).astype(np.uint64)
        for out, k, salt in ((one, 0x9E3779B97F4A7C15, 1), (two, 0xC2B2AE3D27D4EB4F, 2)):
            out[lo:hi] = np.add.reduceat(mix(own ^ (place * np.uint64(k)) ^ np.uint64(salt)), first)
    return one, two


def _gather(words: np.ndarray, n: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The words of some of the runs."""
    first, size = (np.cumsum(n) - n)[which], n[which]
    out, at = np.empty(size.sum(), words.dtype), 0
    for lo, hi in _blocks(size):
        own = size[lo:hi]
        stop = at + own.sum()
        out[at:stop] = words[np.repeat(first[lo:hi] - (np.cumsum(own) - own), own) + np.arange(stop - at)]
        at = stop
    return out


def _pack_runs(parts: list[dict[str, np.ndarray]], count: int) -> pa.RecordBatch:
    """Runs by bucket; of equal ones the first sends its words, and the others follow it as copies."""
    x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    n = x["n"].astype(np.int64)
    x["copy"] = np.zeros(len(n), np.int8)
    bucket = (mix(x["anchor"].copy()) % np.uint64(count)).astype(np.int32)
    if len(n):
        one, two = _identity(x["words"], n)
        order = np.lexsort((two, one, n, x["anchor"], bucket))
        same = np.logical_and.reduce([v[order][1:] == v[order][:-1] for v in (two, one, n, x["anchor"])])
        x["copy"][order[1:][same]] = 1
    else:
        order = np.zeros(0, np.int64)
    lead = x["copy"][order] == 0
    words = _gather(x["words"], n, order[lead])
    size = np.where(lead, n[order], 0)
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(bucket)]]) if len(first) else first
    ends = np.concatenate([[0], np.cumsum(size)])
    arrays = [pa.array(bucket[first], pa.int32())]
    for k, kind in RUN.items():
        v = np.ascontiguousarray(x[k][order].astype(kind))
        arrays.append(common.blobs([v[a:b].tobytes() for a, b in zip(first, last)]))
    arrays.append(common.blobs([words[ends[a] : ends[b]].tobytes() for a, b in zip(first, last)]))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *RUN, "words"])


def copied(words: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """For each word of some runs: whether a passage that has a copy among them begins there."""
    ends = np.cumsum(sizes)
    k = len(sizes)
    # Each run ends with a symbol of its own, less than all words, so that no common prefix goes on beyond it.
    t = np.empty(len(words) + k, dtype=np.int64)
    own = np.arange(len(words)) + np.repeat(np.arange(k), sizes)
    values, rank = np.unique(words, return_inverse=True)
    t[own] = rank + k
    t[ends + np.arange(k)] = np.arange(k)
    sa = suffix_array(t, len(values) + k)
    lcp, phi = permuted_lcp(t, sa)
    hit = lcp >= length
    out = hit.copy()
    out[phi[hit]] = True
    return out[own]


def _begins(first: np.ndarray, n: np.ndarray, length: int, total: int) -> np.ndarray:
    """For each of ``total`` words: whether a passage of one of the runs begins there: at all of its words but the last length - 1."""
    step = np.zeros(total + 1, dtype=np.int8)
    step[first] += 1
    step[first + n - length + 1] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def _passage_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Of the passage at every word that has ``length`` words from it on; runs are not heeded."""
    out = np.empty(max(len(words) - length + 1, 0), dtype=np.uint64)
    for lo in range(0, len(out), BLOCK):
        hi = min(lo + BLOCK, len(out))
        out[lo:hi] = grams(mix(words[lo : hi + length - 1].astype(np.uint64)), length)
    return out


def copied_of_many(words: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """As `copied`, for more words than a suffix array is built over: passages are compared by two hashes, a part of them at once."""
    out = np.zeros(len(words), dtype=bool)
    sizes = sizes.astype(np.int64)
    begins = _begins(np.cumsum(sizes) - sizes, sizes, length, len(words))
    one = _passage_hashes(words, length)
    parts = np.uint64(-(-len(one) // BLOCK))
    for part in range(int(parts)):
        at = np.concatenate([lo + np.flatnonzero(begins[lo : min(lo + BLOCK, len(one))] & (one[lo : lo + BLOCK] % parts == part)) for lo in range(0, len(one), BLOCK)])
        h = one[at]
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        at = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(at) else at
        # What may have a copy, BLOCK at most for each time that one passage fits in, by both hashes.
        two = np.zeros(len(at), dtype=np.uint64)
        for j in range(length):
            two = mix(two ^ words[at + j].astype(np.uint64))
        order = np.lexsort((two, one[at]))
        at, two = at[order], two[order]
        same = (one[at[1:]] == one[at[:-1]]) & (two[1:] == two[:-1])
        out[at[1:][same]] = True
        out[at[:-1][same]] = True
    return out


def _arrays(anchor: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of runs, in the order of anchors, with whole anchors and ARRAY_WORDS words at most; an anchor with more is alone."""
    if not len(n):
        return
    ends = np.cumsum(n)
    stops = [*(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(n)]
    lo = last = 0
    for stop in stops:
        if last > lo and ends[stop - 1] - (ends[lo - 1] if lo else 0) > ARRAY_WORDS:
            yield lo, last
            lo = last
        last = stop
    yield lo, last


def shard_spans(x: dict[str, np.ndarray], length: int = LENGTH) -> dict[str, np.ndarray] | None:
    """(doc, tag, a, b): stretches of words from a to b that consist of passages with copies, of the runs of a bucket."""
    lead_run = x["copy"] == 0 if "copy" in x else np.ones(len(x["n"]), dtype=bool)
    leads = np.flatnonzero(lead_run)
    n = x["n"][leads].astype(np.int64)
    # Copies were told where they were read; leads of several batches may still be equal.
    one, two = _identity(x["words"], n)
    by = np.lexsort((two, one, n, x["anchor"][leads]))
    key = [v[by] for v in (x["anchor"][leads], n, one, two)]
    new = np.concatenate([[True], np.logical_or.reduce([v[1:] != v[:-1] for v in key])])
    kind = np.empty(len(leads), dtype=np.int64)
    kind[by] = np.cumsum(new) - 1
    kind = kind[np.cumsum(lead_run) - 1]  # of every run
    lead = by[new]  # one run of each kind; kinds are in the order of anchors
    words, n = _gather(x["words"], n, lead), n[lead]
    first = np.cumsum(n) - n
    anchor, inner = x["anchor"][leads[lead]], x["inner"][leads[lead]] != 0
    alone = np.concatenate([[True], anchor[1:] != anchor[:-1]]) & np.concatenate([anchor[1:] != anchor[:-1], [True]])
    many = np.bincount(kind) > 1
    search = (~alone | inner) & ~(alone & many)
    # A passage begins at every word of a run but the last length - 1.
    flags = _begins(first[many], n[many], length, len(words))
    todo = np.flatnonzero(search)
    for lo, hi in _arrays(anchor[todo], n[todo]):
        part = todo[lo:hi]
        own = _gather(words, n, part)
        hit = (copied if len(own) <= ARRAY_WORDS else copied_of_many)(own, n[part], length)
        ends = np.cumsum(n[part])
        for f, a, b in zip(first[part].tolist(), (ends - n[part]).tolist(), ends.tolist()):
            flags[f : f + b - a] |= hit[a:b]
    # Stretches in the kinds, then for every run of the kind.
    begin, stop = flags.copy(), flags.copy()
    begin[1:] &= ~flags[:-1]
    stop[:-1] &= ~flags[1:]
    begin[first] = flags[first]
    stop[first[1:] - 1] = flags[first[1:] - 1]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + length
    if not len(a):
        return None
    where = np.searchsorted(first, a, side="right") - 1
    a, b = a - first[where], b - first[where]
    per_kind = np.bincount(where, minlength=len(n))
    span_first = np.cumsum(per_kind) - per_kind
    times = per_kind[kind]
    run = np.repeat(np.arange(len(kind)), times)
    span = np.repeat(span_first[kind] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    return {"doc": x["doc"][run], "tag": x["tag"][run], "a": a[span] + x["begin"][run], "b": b[span] + x["begin"][run]}


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the spans of each document that consist of repeated passages.

    A span is the union of overlapping (or adjoining) stretches of ``length``
    words, each of which occurs again, in any document or elsewhere in the same.
    Words are what white space separates; spans are in word offsets, the end
    excluded.  Texts under ``length`` words (null and empty ones too) have none;
    a null doc_id stays null; each of two rows that are alike repeats the other,
    and they give their spans once; very long texts are searched whole; other
    columns are ignored; an empty table gives none.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be from 1 to length")
    count = blocks.buckets(docs)
    mine = common.stored(_anchor_rows(docs, length, gram), "anchors")
    text = docs.select(*_place(docs), F.col("text").cast("string").alias("text")).join(mine, ["doc", "tag"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            of, parts, held = batch.column(3), [], 0
            for s in slices(batch.column(2), RAW):
                own = of.slice(s.rows.start, len(s))
                rows = np.repeat(np.arange(len(s)), own.value_lengths().to_numpy(zero_copy_only=False))
                x = _runs(s, (rows, own.flatten().to_numpy(zero_copy_only=False).view(np.uint64)), length, gram)
                row = x.pop("row") + s.rows.start
                parts.append(x | {"doc": doc[row], "tag": tag[row]})
                held += len(x["words"])
                if held > 4_000_000:
                    yield _pack_runs(parts, count)
                    parts, held = [], 0
            if parts:
                yield _pack_runs(parts, count)

    kinds = RUN | {"words": np.dtype(np.uint32)}

    def work(x: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        found = shard_spans(x, length) if len(x["n"]) else None
        if found is None:
            return None
        return pa.RecordBatch.from_arrays([pa.array(found["doc"]), pa.array(found["tag"]), pa.array(found["a"], pa.int64()), pa.array(found["b"], pa.int64())], ["doc", "tag", "a", "b"])

    packed = text.mapInArrow(spread, blocks.schema(kinds))
    spans = blocks.per_bucket(packed, kinds, work, "doc bigint, tag int, a bigint, b bigint").distinct()
    w = Window.partitionBy("doc", "tag").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = spans.withColumn("opens", F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0)).withColumn("k", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = joined.groupBy("doc", "tag", "k").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"))
    return merged.select(F.when(F.col("doc") != common.NULL_ID, F.col("doc")).alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(common.table(spark, sf_dir, "documents"))
