"""Near-duplicate documents by a chosen-path set-similarity join on MinHash.

Each text's set of word 3-grams is embedded as ``COORDINATES`` minwise tokens.
Texts with equal embeddings are one set from the start.  The root of each
independent tree picks coordinates at random, ``1 / threshold`` on average, and
a set goes down one branch for each, named by its token there.

1. Branches and set ids alone are shuffled; where two sets meet, the sets' tokens
   follow, as 16 bits of a hash each: equal ones stay equal.  A branch of over ``CROWD`` sets is branched once more on the way.
2. A node of at most ``SMALL`` sets is compared exhaustively.  In a larger one,
   sets that are like the node on average are compared with all others, and the
   rest picks ``INNER / threshold`` coordinates and branches again, however deep.
3. What the tokens bring together is a candidate if they agree in about the
   threshold of places; candidates are then verified on the 3-grams themselves.

A pair at the threshold has one branch in common at a root and ``INNER`` in an
inner node, on average, so it survives any number of levels with the probability
s = 1 - exp(-INNER s), and a tree with 1 - exp(-s): ``trees_for`` derives how many
trees reach a recall.  Within a node, a pair is left out only where both are
surely near one third set: groups are the connected components, and they stay
the same.  The row with the least (doc_id, text hash) of each stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common
from .words import RAW, Slice, grams, mix, slices

SHINGLE = 3
COORDINATES = 128
THRESHOLD = 0.5
RECALL = 0.99
INNER = 2
SMALL = 64
CROWD = 100_000
#: Agreements under the threshold that are still verified, and over it that count as sure within a node.
BAND = 0.12
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)


def trees_for(recall: float, inner: float = INNER) -> int:
    """How many trees find a pair at the threshold with probability ``recall``, whatever their depth."""
    s = 1.0
    for _ in range(200):
        s = 1 - math.exp(-inner * s)
    return max(1, math.ceil(-math.log(1 - recall) / s))


def chosen_coordinates(seed: int, threshold: float, mean: float = 1) -> np.ndarray:
    """Each coordinate with probability mean / (threshold * COORDINATES); at least one."""
    rng = np.random.default_rng(seed & 0x7FFFFFFFFFFFFFFF)
    found = np.flatnonzero(rng.random(COORDINATES) < mean / (threshold * COORDINATES))
    return found if len(found) else rng.integers(0, COORDINATES, 1)


def embed(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a slice that have words, and their minwise tokens (rows, COORDINATES)."""
    n = np.diff(s.first)
    rows = np.flatnonzero(n > 0)
    if not len(rows):
        return rows, np.zeros((0, COORDINATES), np.uint32)
    # A text of fewer words than a shingle has one: all of its words.
    full = grams(s.hashes, SHINGLE)
    starts, counts, values = [], [], []
    for length in range(1, SHINGLE):
        short = rows[n[rows] == length]
        g = grams(s.hashes, length)
        values.append(g[s.first[short]])
        starts.append(short)
        counts.append(np.ones(len(short), np.int64))
    long = rows[n[rows] >= SHINGLE]
    k = n[long] - SHINGLE + 1
    at = np.repeat(s.first[long] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum()) if len(long) else np.zeros(0, np.int64)
    values.append(full[at] if len(at) else np.zeros(0, np.uint64))
    starts.append(long)
    counts.append(k)
    own, count, x = np.concatenate(starts), np.concatenate(counts), (np.concatenate(values) >> np.uint64(32)).astype(np.uint32)
    begin = np.cumsum(count) - count
    out = np.empty((len(own), COORDINATES), dtype=np.uint32)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat(x * _MULTIPLY[i] + _ADD[i], begin)
    order = np.argsort(own, kind="stable")
    return own[order], out[order]


def set_ids(tokens: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's tokens."""
    u = np.zeros(len(tokens), dtype=np.uint64)
    for i in range(COORDINATES):
        u = mix(u * np.uint64(3) + tokens[:, i].astype(np.uint64))
    return u.view(np.int64)


def _keyed(docs: DataFrame) -> tuple:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(common.NULL_ID)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h")


def _short(tokens: np.ndarray) -> np.ndarray:
    """16 bits of a hash of each token: equal ones stay equal, and unequal ones look equal once in 65,536 times, so no pair agrees in less."""
    return (mix(tokens.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, threshold: float, trees: int) -> DataFrame:
    """(d, h, u, tokens, paths): of each row with words, its id, text hash, set id, minwise tokens (16 bits of a hash each) and root branches."""
    common.reachable(docs.sparkSession)
    roots = [chosen_coordinates(1000 + tree, threshold) for tree in range(trees)]
    tree, coordinate = np.repeat(np.arange(trees), [len(r) for r in roots]).astype(np.uint64), np.concatenate(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(2), RAW):
                rows, tokens = embed(s)
                at = pa.array(rows + s.rows.start)
                paths = mix(tokens[:, coordinate].astype(np.uint64) ^ mix((tree << np.uint64(32)) + coordinate.astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(set_ids(tokens)), common.blobs([x.tobytes() for x in _short(tokens)]), common.blobs([x.tobytes() for x in paths])], ["d", "h", "u", "tokens", "paths"])

    return docs.select(*_keyed(docs), F.col("text").cast("string").alias("text")).mapInArrow(run, "d bigint, h bigint, u bigint, tokens binary, paths binary")


def bounds(threshold: float) -> tuple[int, int]:
    """Equal tokens from which a pair is a candidate, and from which it is surely near."""
    return math.ceil(COORDINATES * (threshold - BAND)), math.ceil(COORDINATES * min(1.0, threshold + BAND))


def _children(path: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Branches of sets in one inner node (``path`` repeated): (row of tokens, branch), INNER / threshold for each on average."""
    chosen = chosen_coordinates(int(path), threshold, INNER)
    names = mix(np.uint64(path) + chosen.astype(np.uint64) + np.uint64(1))
    return np.tile(np.arange(len(tokens)), len(chosen)), mix(tokens[:, chosen].T.astype(np.uint64) ^ names[:, None]).ravel()


def _small_pairs(path: np.ndarray, e: np.ndarray, tokens: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Candidates among the sets of each small node; entries are in the order of nodes."""
    at, to, sure = [], [], []
    for d in range(1, len(path)):
        i = np.flatnonzero(path[:-d] == path[d:])
        if not len(i):
            break
        for k in range(0, len(i), 1 << 15):
            own = i[k : k + (1 << 15)]
            same = (tokens[e[own]] == tokens[e[own + d]]).sum(axis=1)
            near = same >= lo
            at.append(own[near])
            to.append(own[near] + d)
            sure.append(same[near] >= hi)
    if not at:
        return []
    i, j, is_sure = np.concatenate(at), np.concatenate(to), np.concatenate(sure)
    # Two sets that are surely near the same earlier one of their node are joined by it.
    lead = np.arange(len(path))
    np.minimum.at(lead, j[is_sure], i[is_sure])
    needed = (lead[i] != lead[j]) | (lead[j] == i)
    return [np.stack([e[i[needed]], e[j[needed]]], axis=1)]


def _like_the_node(tokens: np.ndarray) -> np.ndarray:
    """Each set's average agreement with the others."""
    n, total = len(tokens), np.zeros(len(tokens))
    for c in range(tokens.shape[1]):
        _, where, count = np.unique(tokens[:, c], return_inverse=True, return_counts=True)
        total += count[where] - 1
    return total / (tokens.shape[1] * (n - 1))


def _heavy_pairs(tokens: np.ndarray, heavy: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Candidates of the heavy sets with all sets of a node, but for pairs that sure ones join already."""
    byte = mix(tokens.astype(np.uint64)).astype(np.uint8)  # equal tokens have equal bytes
    part, found = np.arange(len(tokens)), []

    def against(p: int, others: np.ndarray) -> None:
        """Compare one set with others that aren't in its part."""
        others = others[(byte[others] == byte[p]).sum(axis=1) >= lo]
        same = (tokens[others] == tokens[p]).sum(axis=1)
        others, same = others[same >= lo], same[same >= lo]
        for sure in (True, False):
            own = others[(same >= hi) == sure]
            own = own[part[own] != part[p]]
            if sure:
                own = own[np.unique(part[own], return_index=True)[1]]
                found.append(np.stack([np.full(len(own), p), own], axis=1))
                part[np.isin(part, part[own])] = part[p]
            else:
                found.append(np.stack([np.full(len(own), p), own], axis=1))

    # Pivots first: a large group is one part after a few of them.
    open_, pivot = heavy.copy(), np.zeros(len(tokens), dtype=bool)
    everyone = np.arange(len(tokens))
    while open_.any():
        p = int(np.argmax(open_))
        pivot[p] = True
        against(p, everyone[everyone != p])
        open_[p] = False
        open_ &= part != part[p]
    for p in np.flatnonzero(heavy & ~pivot).tolist():
        others = np.flatnonzero((part != part[p]) & ~pivot)
        if len(others):
            against(p, others)
    return found


def node_pairs(path: np.ndarray, u: np.ndarray, tokens: np.ndarray, threshold: float, small: int = SMALL) -> np.ndarray:
    """Candidate pairs (lesser set id, greater) of the sets in the same nodes."""
    lo, hi = bounds(threshold)
    found: list[np.ndarray] = []
    entry = np.arange(len(u))
    while len(path):
        order = np.lexsort((u[entry], path))
        path, entry = path[order], entry[order]
        new = np.concatenate([[True], (path[1:] != path[:-1]) | (u[entry[1:]] != u[entry[:-1]])])
        path, entry = path[new], entry[new]
        first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        size = np.diff(np.concatenate([first, [len(path)]]))
        fits = np.repeat((size > 1) & (size <= small), size)
        found += _small_pairs(path[fits], entry[fits], tokens, lo, hi)
        paths, entries = [], []
        for f, n in zip(first[size > small], size[size > small]):
            own = entry[f : f + n]
            heavy = _like_the_node(tokens[own]) >= 0.9 * threshold / INNER
            if heavy.any():
                found += [own[x] for x in _heavy_pairs(tokens[own], heavy, lo, hi)]
            rest = own[~heavy]
            if len(rest) <= small:
                paths.append(np.full(len(rest), path[f]))
                entries.append(rest)
            else:
                row, below = _children(path[f], tokens[rest], threshold)
                paths.append(below)
                entries.append(rest[row])
        path = np.concatenate([np.zeros(0, np.uint64), *paths])
        entry = np.concatenate([np.zeros(0, np.int64), *entries])
    pairs = u[np.concatenate([np.zeros((0, 2), np.int64), *found])]
    return np.unique(np.sort(pairs, axis=1), axis=0)


def _meetings(sigs: DataFrame, crowd: int) -> DataFrame:
    """(u, paths, crowds): of each set that meets another one at a root, the branches where it does, and those of over ``crowd`` sets."""
    kinds = {"path": np.dtype(np.uint64), "u": np.dtype(np.int64)}
    count = blocks.buckets(sigs)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column(0).to_numpy(zero_copy_only=False)
            path = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64)
            row = np.repeat(np.arange(len(u)), len(path) // max(len(u), 1))
            _, once = np.unique(np.stack([path, u[row].view(np.uint64)], axis=1), axis=0, return_index=True)
            yield blocks.pack(path[once], {"path": path[once], "u": u[row][once]}, count)

    def meet(x: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        order = np.lexsort((x["u"], x["path"]))
        path, u = x["path"][order], x["u"][order]
        new = np.concatenate([[True], (path[1:] != path[:-1]) | (u[1:] != u[:-1])])
        path, u = path[new], u[new]
        first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        size = np.diff(np.concatenate([first, [len(path)]]))
        size = np.repeat(size, size)
        path, u, size = path[size > 1], u[size > 1], size[size > 1]
        if not len(u):
            return None
        order = np.argsort(u, kind="stable")
        path, u, size = path[order], u[order], size[order]
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        last = np.concatenate([first[1:], [len(u)]])
        crowded = size > crowd
        return pa.RecordBatch.from_arrays([pa.array(u[first]), common.blobs([path[a:b][~crowded[a:b]].tobytes() for a, b in zip(first, last)]), common.blobs([path[a:b][crowded[a:b]].tobytes() for a, b in zip(first, last)])], ["u", "paths", "crowds"])

    packed = sigs.select("u", "paths").mapInArrow(spread, blocks.schema(kinds))
    met = blocks.per_bucket(packed, kinds, meet, "u bigint, paths binary, crowds binary")
    return met.groupBy("u").agg(F.collect_list("paths").alias("paths"), F.collect_list("crowds").alias("crowds"))


def candidates(sigs: DataFrame, threshold: float, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: set ids that some tree brought together and that look near."""
    count = blocks.buckets(sigs)
    kinds = {"path": np.dtype(np.uint64), "u": np.dtype(np.int64), "tokens": np.dtype((np.void, 2 * COORDINATES))}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                u = part.column(0).to_numpy(zero_copy_only=False)
                tokens = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)
                path, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for r, (plain, crowds) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    own = np.frombuffer(b"".join(plain), dtype=np.uint64)
                    path.append(own)
                    row.append(np.full(len(own), r))
                    for p in np.frombuffer(b"".join(crowds), dtype=np.uint64):
                        below = _children(p, tokens[r : r + 1], threshold)[1]
                        path.append(below)
                        row.append(np.full(len(below), r))
                path, row = np.concatenate(path), np.concatenate(row)
                yield blocks.pack(path, {"path": path, "u": u[row], "tokens": tokens[row].view(kinds["tokens"])[:, 0]}, count)

    def work(x: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        found = node_pairs(x["path"], x["u"], x["tokens"].view(np.uint16).reshape(-1, COORDINATES), threshold)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"]) if len(found) else None

    met = _meetings(sigs, crowd)
    whole = sigs.select("u", "tokens").join(met, "u").dropDuplicates(["u"])
    packed = whole.select("u", "tokens", "paths", "crowds").mapInArrow(spread, blocks.schema(kinds))
    return blocks.per_bucket(packed, kinds, work, "a bigint, b bigint").distinct()


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(u, shingles): the sorted distinct 3-gram hashes of the texts (d, h) in ``wanted``, by set id.

    A bit map of fixed size keeps most other texts from being cut up.  Set ids are
    made again from what passes, so the sets are shuffled once, by these; of the texts
    with one id, the least (d, h), which is in ``wanted``, stands for it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common.bit_map(wanted.select(F.xxhash64("d", "h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(common.in_bit_map(sent.value, batch.column(2).to_numpy(zero_copy_only=False))))
            for s in slices(batch.column(3), RAW):
                rows, tokens = embed(s)
                at = pa.array(rows + s.rows.start)
                sets = []
                for a, b in zip(s.first[rows].tolist(), s.first[rows + 1].tolist()):
                    sets.append(np.unique(grams(s.hashes[a:b], min(SHINGLE, b - a))).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (0, 1)), pa.array(set_ids(tokens)), common.blobs(sets)], ["d", "h", "u", "shingles"])

    d, h = _keyed(docs)
    rows = docs.select(d, h, F.col("text").cast("string").alias("text")).select("d", "h", F.xxhash64("d", "h").alias("k"), "text")
    found = rows.mapInArrow(run, "d bigint, h bigint, u bigint, shingles binary")
    return found.groupBy("u").agg(F.min_by("shingles", F.struct("d", "h")).alias("shingles"))


def verified(docs: DataFrame, sigs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets of 3-grams have a Jaccard similarity of at least the threshold."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    wanted = sigs.groupBy("u").agg(F.min(F.struct("d", "h")).alias("k")).join(ends, "u").select("k.d", "k.h")
    sets = _shingle_sets(docs, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def components(pairs: DataFrame) -> DataFrame:
    """(v, root): every vertex of (a, b) but the roots, with the least vertex of its component.

    Alternating large-star and small-star steps; each pair of steps is written to
    the shared folder, and the loop ends when nothing changes.
    """
    state = common.stored(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).filter("v <> root").distinct(), "edges")
    mark = None
    while True:
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return state
        mark = now
        both = state.unionByName(state.select(F.col("root").alias("v"), F.col("v").alias("root")))
        least = both.groupBy("v").agg(F.least(F.min("root"), F.col("v")).alias("m"))
        large = both.join(least, "v").filter("root > v").select(F.col("root").alias("v"), F.col("m").alias("root")).filter("v <> root").distinct()
        least = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("root").alias("v"), F.col("m").alias("root")), F.struct("v", F.col("m").alias("root")))).alias("e")).select("e.*").filter("v <> root").distinct()
        state = common.stored(small, "edges")


def groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(d, h, copies, root, keep_d, keep_h): each distinct row that is repeated or in a group, and the one of its group that stays."""
    sigs = common.stored(signatures(docs, threshold, trees_for(recall)), "signatures")
    pairs = common.stored(candidates(sigs, threshold), "candidates")
    roots = components(verified(docs, sigs, pairs, threshold))
    rows = sigs.groupBy("u", "d", "h").agg(F.count("*").alias("copies"))
    rooted = rows.join(roots.withColumnRenamed("v", "u"), "u", "left").select("d", "h", "copies", F.coalesce("root", "u").alias("root"))
    least = rooted.groupBy("root").agg(F.min(F.struct("d", "h")).alias("keep"), F.sum("copies").alias("size")).filter("size > 1")
    return common.stored(rooted.join(least, "root").select("d", "h", "copies", "root", F.col("keep.d").alias("keep_d"), F.col("keep.h").alias("keep_h")), "groups")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, duplicate_of): each document that is a near copy, and the document of its group that stays.

    The one with the least (doc_id, text hash) stays, a null doc_id before
    others.  Of rows that are alike one stays and each other gives a row with
    itself.  Texts without words (null, empty, white space) are never near
    copies; one of fewer than 3 words is a single shingle; a very long text is a
    set like any other; other columns are ignored; an empty table gives none.
    """
    g = groups(docs, threshold, recall)
    extra = F.when((F.col("d") == F.col("keep_d")) & (F.col("h") == F.col("keep_h")), F.col("copies") - 1).otherwise(F.col("copies"))
    null = lambda c: F.when(F.col(c) != common.NULL_ID, F.col(c))
    return g.withColumn("extra", extra).filter("extra > 0").select(null("d").alias("doc_id"), null("keep_d").alias("duplicate_of"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("extra"))).alias("_")).drop("_")


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each group of near copies, all columns as they are; cases as in `near_duplicates`."""
    g = groups(docs, threshold, recall)
    kept = (F.col("d") == F.col("keep_d")) & (F.col("h") == F.col("keep_h"))
    rows = docs.select(F.struct("*").alias("row"), *_keyed(docs))
    decided = rows.join(g.filter(~kept | (F.col("copies") > 1)).select("d", "h", kept.alias("once")), ["d", "h"], "left")
    out = decided.filter(F.col("once").isNull())
    repeated = decided.filter("once")
    if not g.filter(kept & (F.col("copies") > 1)).isEmpty():
        out = out.unionByName(repeated.dropDuplicates(["d", "h"]))
    return out.select("row.*")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
