"""Line deduplication: an exact set-similarity self-join of all lines.

A line is the set of its words.  Words are ordered by corpus frequency, rare
first (`frequency`), and two lines of Jaccard similarity at least ``t`` must
share a word of their prefixes (``n - ceil(t n) + 1`` rarest words each).

1. Lines of equal sets are collapsed to the earliest where they are read; the
   others are exact later matches.  What stays sends its prefix words, packed by
   bucket, each with the line's place, size, word position, set hash, a 128-bit
   parity bitmap of its words and some bits of the prefix words that follow.  A
   word of over ``HOT`` occurrences goes with each of the words that follow it, as
   two lines whose rarest common word it is share another one of these.
2. In a bucket, equal sets are collapsed again.  Pairs of the rest that share a
   word pass the length filter, the positional filter and the bitmap filter (the
   Hamming distance of bitmaps never exceeds the symmetric difference).  Where
   over ``SPLIT`` sets share it, they are compared by a second word that they share.
   A line takes ``FIRST`` earlier candidates at most.
3. These are verified on the words themselves: first each line with its earliest
   candidate, then, for lines that this doesn't settle, with the others.  Lines
   that had more candidates and still aren't settled are joined again, with all of
   theirs: no candidate is dropped unseen.
4. Matched lines are removed from their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common, frequency
from .words import RAW, Lines, Slice, mix, slices

THRESHOLD = Fraction(9, 10)
_HASH_BITS, _LEVEL_BITS = 42, 8
_WORD_BITS = _HASH_BITS + _LEVEL_BITS
_LINE_MOST = 1 << (64 - _WORD_BITS)
SEPARATORS = r"[\x00-\x20]+"
#: Occurrences over which a prefix word is joined with the next ones before it is shuffled.
HOT = 1 << 24
#: Sets with one word in common that are compared with each other at most, before a second common word is asked for.
SPLIT = 128
#: Candidates that a line takes before it is verified; for more there is a second join.
FIRST = 8
#: Longest prefix whose words are paired; the sets of longer ones are compared as they are.
PAIRED = 64

ENTRY = {"word": np.dtype(np.uint64), "doc": np.dtype(np.int64), "tag": np.dtype(np.int32), "line": np.dtype(np.int32), "size": np.dtype(np.int32), "at": np.dtype(np.int32), "set": np.dtype(np.uint64), "map1": np.dtype(np.uint64), "map2": np.dtype(np.uint64), "tails": np.dtype(np.int16)}
#: What a bucket gets: entries, the bits of the words after each, and lines that are known to go.
KINDS = ENTRY | {"tail": np.dtype(np.uint16), "gone_doc": np.dtype(np.int64), "gone_tag": np.dtype(np.int32), "gone_line": np.dtype(np.int32)}
PLACE = ("doc", "tag", "line")


def needed(sizes: np.ndarray, t: Fraction) -> np.ndarray:
    """Words that two lines of so many words together must share."""
    return -(-t.numerator * sizes // (t.numerator + t.denominator))


def _line_sets(s: Slice, level: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, line number, first word, size, words): the distinct words of lines, each line's in rare-first order."""
    if not len(s.hashes):
        return
    lines = Lines(s)
    new = np.concatenate([[True], lines.key[1:] != lines.key[:-1]])
    dense = np.cumsum(new) - 1
    row, number = lines.row[new], lines.number[new]
    word = (level[frequency.cells(s.hashes)].astype(np.uint64) << np.uint64(_HASH_BITS)) | (s.hashes & np.uint64((1 << _HASH_BITS) - 1))
    for lo in range(0, len(row), _LINE_MOST):
        a, b = np.searchsorted(dense, [lo, lo + _LINE_MOST])
        packed = np.sort(((dense[a:b] - lo).astype(np.uint64) << np.uint64(_WORD_BITS)) | word[a:b])
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
        own = (packed >> np.uint64(_WORD_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield row[lo : lo + _LINE_MOST], number[lo : lo + _LINE_MOST], first, np.diff(np.concatenate([first, [len(own)]])), packed & np.uint64((1 << _WORD_BITS) - 1)


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … for length[0], then start[1], …"""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def line_sets(s: Slice, level: np.ndarray, doc: np.ndarray, tag: np.ndarray, t: Fraction) -> Iterator[dict[str, np.ndarray]]:
    """PLACE, size, set, map1 and map2 of the lines of a slice, with their first ``keep`` words: the prefix and one more."""
    for row, number, first, size, words in _line_sets(s, level):
        bits = mix(words)
        one = np.uint64(1) << (bits >> np.uint64(58))
        upper = (bits >> np.uint64(57)) & np.uint64(1) == 1
        keep = np.minimum(prefix(size, t) + 1, size)
        yield {
            "doc": doc[row], "tag": tag[row], "line": number.astype(np.int32), "size": size.astype(np.int32), "set": np.add.reduceat(mix(words + np.uint64(1)), first),
            "map1": np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), one), first), "map2": np.bitwise_xor.reduceat(np.where(upper, one, np.uint64(0)), first), "keep": keep, "words": words[_spans(first, keep)],
        }


def prefix(size: np.ndarray, t: Fraction) -> np.ndarray:
    return size - -(-t.numerator * size // t.denominator) + 1


def _longest_paired(t: Fraction) -> int:
    """The least size whose prefix is longer than PAIRED."""
    if t >= 1:
        return 1 << 40
    size = int(PAIRED / (1 - t)) + 2
    while size and int(prefix(np.array(size), t)) > PAIRED:
        size -= 1
    return size + 1


def collapsed(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The earliest line of each set, and the places of the others (of none that is the same line)."""
    order = np.lexsort((x["line"], x["tag"], x["doc"], x["size"], x["set"]))
    new = np.concatenate([[True], (x["set"][order][1:] != x["set"][order][:-1]) | (x["size"][order][1:] != x["size"][order][:-1])])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    other = np.logical_or.reduce([x[k][order] != x[k][head] for k in PLACE])
    start = np.cumsum(x["keep"]) - x["keep"]
    lead = order[new]
    out = {k: v[lead] for k, v in x.items() if k != "words"}
    out["words"] = x["words"][_spans(start[lead], x["keep"][lead])]
    return out, {"gone_" + k: x[k][order[other]] for k in PLACE}


def prefix_entries(x: dict[str, np.ndarray], t: Fraction, hot: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """ENTRY of lines, and the tails.  ``at`` is twice the position, and one more in the first entry of a line."""
    size, keep, words = x["size"].astype(np.int64), x["keep"], x["words"]
    n = prefix(size, t)
    # Of lines that share two words with any partner, the second one is in both tails.  Others, and those
    # that may have a partner with too long a prefix, are also met by a single word.
    paired = (needed(size + -(-t.numerator * size // t.denominator), t) >= 2) & (size * t.denominator < _longest_paired(t) * t.numerator)
    line = np.repeat(np.arange(len(size)), n)
    at = _spans(np.zeros(len(size), np.int64), n)
    pos = (np.cumsum(keep) - keep)[line] + at
    after = keep[line] - at - 1
    key, first, begin, tails = words[pos], at == 0, pos + 1, np.where(paired[line], after, -1)
    heat = (n <= PAIRED)[line] & ((key >> np.uint64(_HASH_BITS)).astype(np.int64) >= hot)
    if heat.any():
        h = np.flatnonzero(heat)
        own, b = np.repeat(h, after[h]), _spans(begin[h], after[h])
        both = mix(key[own] * np.uint64(0x9E3779B97F4A7C15) ^ words[b])
        cold = np.flatnonzero(~heat | ~paired[line])
        first = np.concatenate([first[cold], first[own] & (b == begin[own]) & paired[line[own]]])
        key, line, at, begin, tails = (np.concatenate(v) for v in ((key[cold], both), (line[cold], line[own]), (at[cold], at[own]), (begin[cold], b), (tails[cold], np.full(len(own), -1))))
    own = {k: x[k][line] for k in ("doc", "tag", "line", "size", "set", "map1", "map2")}
    tail = words[_spans(begin, np.maximum(tails, 0))]
    return {"word": key, "at": (2 * at + first).astype(np.int32), "tails": tails.astype(np.int16)} | own, (mix(tail) >> np.uint64(48)).astype(np.uint16)


def _packed(held: list[dict[str, np.ndarray]], t: Fraction, hot: int, count: int) -> Iterator[pa.RecordBatch]:
    x, gone = collapsed({k: np.concatenate([h[k] for h in held]) for k in held[0]})
    entries, tail = prefix_entries(x, t, hot)
    begin = np.maximum(entries["tails"], 0).astype(np.int64)
    for batch in blocks.pack_ragged(entries["word"], {k: entries[k] for k in ENTRY}, {"tail": (tail, begin)}, count):
        none = common.blobs([b""] * batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, none, none, none], ["bucket", *KINDS])
    if len(gone["gone_doc"]):
        known = [common.blobs([np.ascontiguousarray(gone[k].astype(KINDS[k])).tobytes()]) if k in gone else common.blobs([b""]) for k in KINDS]
        yield pa.RecordBatch.from_arrays([pa.array([int(x["set"][0] % np.uint64(count))], pa.int32()), *known], ["bucket", *KINDS])


def _sweep(y: dict[str, np.ndarray], e: np.ndarray, group: np.ndarray, probe: np.ndarray, t: Fraction, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, more) candidates in groups of entries in the order of (group, size); ``more`` tells that a line stopped at ``most``."""
    size, at, rank = y["size"][e].astype(np.int64), (y["at"][e] >> 1).astype(np.int64), y["rank"][e]
    one, two, probe = y["map1"][e], y["map2"][e], probe[e]
    seen = np.zeros(len(e), dtype=np.int64)
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for way in (1, -1):
        live, d = np.flatnonzero(probe), way
        while len(live):
            live = live[(live + d < len(e)) & (live + d >= 0)]
            # Sizes rise in a group, so where one is too far from this one, all beyond are.
            small, large = (size[live], size[live + d]) if way > 0 else (size[live + d], size[live])
            live = live[(group[live] == group[live + d]) & (small * t.denominator >= large * t.numerator)]
            i = live[rank[live + d] < rank[live]]
            j = i + d
            a, b = size[i], size[j]
            need = needed(a + b, t)
            ok = np.minimum(at[i], at[j]) + np.minimum(a - at[i], b - at[j]) >= need
            ok &= a + b - np.bitwise_count(one[i] ^ one[j]) - np.bitwise_count(two[i] ^ two[j]) >= 2 * need
            i, j = i[ok], j[ok]
            later.append(i)
            earlier.append(j)
            seen[i] += 1
            if most is not None:
                live = live[seen[live] < most]
            d += way
        probe = probe & (seen < most) if most is not None else probe
    i, j = np.concatenate(later), np.concatenate(earlier)
    return e[i], e[j], seen[i] >= most if most is not None else np.zeros(len(i), dtype=bool)


def line_key(doc: np.ndarray, tag: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.uint64) ^ mix((tag.astype(np.int64).astype(np.uint64) << np.uint64(32)) + line.astype(np.uint64)))


def bucket_matches(x: dict[str, np.ndarray], t: Fraction, most: int | None = FIRST, bits: np.ndarray | None = None, split: int = SPLIT) -> pa.RecordBatch:
    """(PLACE, PLACE of the earlier line, same, more): later lines with earlier candidates, equal sets marked.

    With ``bits``, only lines in the bit map look for candidates.
    """
    start = np.cumsum(np.maximum(x["tails"], 0), dtype=np.int64) - np.maximum(x["tails"], 0)
    x = {k: x[k] for k in KINDS} | {"start": start}
    gone = [x.pop("gone_" + k).astype(np.int64) for k in PLACE]
    tail = x.pop("tail")
    order = np.lexsort((x["line"], x["tag"], x["doc"], x["set"], x["size"], x["word"]))
    x = {k: v[order] for k, v in x.items()}
    rank = np.empty(len(order), dtype=np.int64)
    rank[np.lexsort((x["line"], x["tag"], x["doc"]))] = np.arange(len(order))
    x["rank"] = rank
    equal = np.concatenate([[False], (x["word"][1:] == x["word"][:-1]) & (x["size"][1:] == x["size"][:-1]) & (x["set"][1:] == x["set"][:-1])])[: len(order)]
    head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(equal))))
    # Rows that are alike have the same place: they are one line, not a later match of it.
    other = np.flatnonzero(equal & (x["at"] & 1 == 1) & np.logical_or.reduce([x[k] != x[k][head] for k in PLACE]))
    # Sizes at which only equal sets are near enough need no more.
    size = x["size"].astype(np.int64)
    alone = (size * t.denominator // t.numerator == size) & (-(-t.numerator * size // t.denominator) == size)
    keep = np.flatnonzero(~equal & ~alone)
    y = {k: v[keep] for k, v in x.items()}
    probe = np.ones(len(keep), dtype=bool) if bits is None else common.in_bit_map(bits, line_key(*(y[k] for k in PLACE)))
    first = np.flatnonzero(np.concatenate([[True], y["word"][1:] != y["word"][:-1]]))[: len(keep)]
    size = np.diff(np.concatenate([first, [len(keep)]]))
    group = np.repeat(np.arange(len(first)), size)
    large = (size > split) & (np.minimum.reduceat(y["tails"], first) >= 0 if len(first) else True)
    entry, by = np.flatnonzero(~large[group]), group[~large[group]]
    found = [_sweep(y, entry, by, probe, t, most)]
    entry = np.flatnonzero(large[group])
    if len(entry):
        n = y["tails"][entry].astype(np.int64)
        second = tail[_spans(y["start"][entry], n)]
        entry = np.repeat(entry, n)
        order = np.lexsort((y["size"][entry], second, group[entry]))
        entry, by = entry[order], (group[entry].astype(np.int64) << 16 | second)[order]
        found.append(_sweep(y, entry, by, probe, t, most))
    i, j, more = (np.concatenate(v) for v in zip(*found))
    # Words that two lines share give the pair again; one is enough.
    rec = np.stack([y[k][i].astype(np.int64) for k in PLACE] + [y[k][j].astype(np.int64) for k in PLACE] + [more.astype(np.int64)], axis=1)
    rec = np.unique(rec, axis=0) if len(rec) else rec
    known = [np.concatenate([g, x[k][other].astype(np.int64)]) for g, k in zip(gone, PLACE)]
    columns = [np.concatenate([rec[:, c], known[c % 3]]) for c in range(6)]
    same = np.arange(len(columns[0])) >= len(rec)
    kinds = (pa.int64(), pa.int32(), pa.int32()) * 2
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(same), pa.array(np.concatenate([rec[:, 6] == 1, np.zeros(len(known[0]), bool)]))], ["doc", "tag", "line", "doc2", "tag2", "line2", "same", "more"])


_MATCH = "doc bigint, tag int, line int, doc2 bigint, tag2 int, line2 int, same boolean, more boolean"


def _place(docs: DataFrame) -> tuple:
    text = F.col("text").cast("string")
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(common.NULL_ID)).alias("doc"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("tag")


def _hot_level(hot: int) -> int:
    return int(frequency.levels(np.array([hot]))[0])


def _candidates(docs: DataFrame, t: Fraction, level, most: int | None = FIRST, bits=None, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    count, heat = blocks.buckets(docs), _hot_level(hot)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        words = 0
        for batch in batches:
            doc, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for s in slices(batch.column(2), RAW):
                here = slice(s.rows.start, s.rows.stop)
                for found in line_sets(s, level.value, doc[here], tag[here], t):
                    held.append(found)
                    words += len(found["words"])
                if words > 500_000:
                    yield from _packed(held, t, heat, count)
                    held, words = [], 0
        if held:
            yield from _packed(held, t, heat, count)

    packed = docs.select(*_place(docs), F.col("text").cast("string").alias("text")).mapInArrow(spread, blocks.schema(KINDS))
    return common.stored(blocks.per_bucket(packed, KINDS, lambda x: bucket_matches(x, t, most, bits.value if bits is not None else None, split), _MATCH), "lines")


def _words(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, tag, line, words): the distinct words of the lines in pairs; a text is split once, however many lines it has."""
    wanted = pairs.select(*PLACE).unionByName(pairs.select(F.col("doc2").alias("doc"), F.col("tag2").alias("tag"), F.col("line2").alias("line"))).distinct().groupBy("doc", "tag").agg(F.collect_list("line").alias("wanted"))
    text = docs.select(*_place(docs), F.col("text").cast("string").alias("text")).join(wanted, ["doc", "tag"]).dropDuplicates(["doc", "tag"])
    # The lines are bound to a lambda's variable: as a plain column, the split would be done again for each line.
    lines = F.flatten(F.transform(F.array(F.split("text", "\n", -1)), lambda ls: F.transform("wanted", lambda i: F.struct(i.alias("line"), F.get(ls, i).alias("t")))))
    found = text.select("doc", "tag", F.explode(lines).alias("l"))
    return common.stored(found.select("doc", "tag", "l.line", F.array_distinct(F.filter(F.split("l.t", SEPARATORS), lambda w: w != "")).alias("words")), "words")


def _verified(pairs: DataFrame, words: DataFrame, t: Fraction) -> DataFrame:
    """(doc, tag, line) of the pairs whose Jaccard similarity reaches t."""
    one = words.select("doc", "tag", "line", F.col("words").alias("w1"))
    two = words.select(F.col("doc").alias("doc2"), F.col("tag").alias("tag2"), F.col("line").alias("line2"), F.col("words").alias("w2"))
    both = F.size(F.array_intersect("w1", "w2"))
    return pairs.join(one, ["doc", "tag", "line"]).join(two, ["doc2", "tag2", "line2"]).withColumn("both", both).filter(F.col("both") * t.denominator >= (F.size("w1") + F.size("w2") - F.col("both")) * t.numerator).select("doc", "tag", "line").distinct()


def _removed(docs: DataFrame, t: Fraction, first: int = FIRST, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """(doc, tag, lines): the lines to take out of each document."""
    level = docs.sparkSession.sparkContext.broadcast(frequency.levels(frequency.word_counts(docs)))  # of fixed size
    found = _candidates(docs, t, level, first, None, hot, split)
    same = found.filter("same").select(*PLACE).distinct()
    near = common.stored(found.filter("NOT same").groupBy(*PLACE, "doc2", "tag2", "line2").agg(F.max("more").alias("more")).join(same, [*PLACE], "left_anti"), "pairs")
    words = _words(docs, near)
    earliest = near.groupBy(*PLACE).agg(F.min(F.struct("doc2", "tag2", "line2")).alias("e")).select(*PLACE, "e.*")
    settled = common.stored(_verified(earliest, words, t), "settled")
    rest = near.drop("more").join(settled, [*PLACE], "left_anti").join(earliest, [*PLACE, "doc2", "tag2", "line2"], "left_anti")
    gone = common.stored(settled.unionByName(_verified(rest, words, t)).distinct(), "settled")
    open_ = common.stored(near.filter("more").select(*PLACE).distinct().join(gone, [*PLACE], "left_anti"), "open")
    if not open_.isEmpty():  # all their candidates passed the filters and failed the words, and there are more
        keys = open_.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(line_key(*(b.column(c).to_numpy(zero_copy_only=False) for c in range(3))).view(np.int64))], ["k"]) for b in batches), "k bigint")
        bits = docs.sparkSession.sparkContext.broadcast(common.bit_map(keys))  # of fixed size
        every = _candidates(docs, t, level, None, bits, hot, split).filter("NOT same").drop("same", "more").distinct()
        every = common.stored(every.join(open_, [*PLACE], "left_semi").join(near, [*PLACE, "doc2", "tag2", "line2"], "left_anti"), "pairs")
        gone = gone.unionByName(_verified(every, _words(docs, every), t))
    return common.stored(same.unionByName(gone).distinct().groupBy("doc", "tag").agg(F.collect_list("line").alias("lines")), "gone")


def deduplicated(docs: DataFrame, threshold: Fraction = THRESHOLD, first: int = FIRST, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """docs with every later matching line taken out of the texts, all other columns as they are (n_chars follows).

    Lines are what newlines separate, in the order of (doc_id, hash of the text,
    line), a null doc_id first.  A line goes if *any* earlier line, gone or not,
    has a Jaccard similarity of at least ``threshold`` with it; the rest are
    joined again.  Lines without words never match and stay, as do null and empty
    texts; all rows stay, a text of which nothing is left is empty.  Rows alike in
    doc_id and text are one document: a line of one is no later match of the
    other's.  Very long texts and lines are joined whole.  Other columns may have
    any names; an empty table gives none.  ``first``, ``hot`` and ``split`` bear on
    the work, never on the result.
    """
    gone = _removed(docs, threshold, first, hot, split)
    doc, tag = _place(docs)
    rows = docs.select(F.struct("*").alias("row"), doc, tag).join(gone, ["doc", "tag"], "left")
    # As in _words: one split for each text.
    left = F.transform(F.array(F.split(F.col("row.text"), "\n", -1)), lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("lines")), lambda i: F.get(ls, i)))
    text = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(F.array_join(F.flatten(left), "\n"))
    out = rows.select("row", "lines", text.alias("text"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text").cast(docs.schema["text"].dataType).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("lines").isNull(), F.col("row").getField(c)).otherwise(F.length("text").cast(docs.schema[c].dataType)).alias(c))
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return out.select(*columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_chars) of every document without its later matching lines."""
    docs = common.table(spark, sf_dir, "documents")
    return deduplicated(docs.select("doc_id", "text", "n_chars"))


SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i AS line_no, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d)),
w AS (SELECT doc_id, line_no, list_distinct(list_filter(string_split_regex(line, '[\\x00-\\x20]+'), lambda x: x <> '')) AS ws FROM l),
u AS (SELECT doc_id, line_no, len(ws) AS n, ws FROM w WHERE len(ws) > 0),
f AS (SELECT word, count(*) AS c FROM (SELECT unnest(ws) AS word FROM u) GROUP BY word),
t AS (SELECT doc_id, line_no, n, word, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY c, word) AS pos
      FROM (SELECT doc_id, line_no, n, unnest(ws) AS word FROM u) JOIN f USING (word)),
p AS (SELECT * FROM t WHERE pos <= n - CAST(ceil(n * {THRESHOLD.numerator} / {THRESHOLD.denominator}.0 - 1e-9) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id, a.line_no, b.doc_id AS doc2, b.line_no AS line2 FROM p a JOIN p b
      ON a.word = b.word AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.line_no < a.line_no))
      AND a.n * {THRESHOLD.denominator} >= b.n * {THRESHOLD.numerator} AND b.n * {THRESHOLD.denominator} >= a.n * {THRESHOLD.numerator}),
m AS (SELECT DISTINCT c.doc_id, c.line_no FROM c JOIN u a ON a.doc_id = c.doc_id AND a.line_no = c.line_no JOIN u b ON b.doc_id = c.doc2 AND b.line_no = c.line2
      WHERE len(list_intersect(a.ws, b.ws)) * {THRESHOLD.denominator} >= (a.n + b.n - len(list_intersect(a.ws, b.ws))) * {THRESHOLD.numerator}),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.line_no) AS text FROM l ANTI JOIN m ON l.doc_id = m.doc_id AND l.line_no = m.line_no GROUP BY l.doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN documents.doc_id IN (SELECT doc_id FROM m) THEN coalesce(length(k.text), 0) ELSE documents.n_chars END AS n_chars
FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id"""
