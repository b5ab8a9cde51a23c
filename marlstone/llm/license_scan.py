"""License scan: an exact containment join of text blocks with templates.

Words are ordered by their frequency over all documents, rare first.  A block
contains a template if at least ``ceil(threshold * |template|)`` of the
template's distinct words are in it.  Such a block must have a word of the
template's prefix (its |T| - need + 1 rarest words), at least ``need`` distinct
words, and, from its first word in common on, room for ``need`` in both orders.
An inverted index leads from prefix words to the templates that have them, so the
work grows with the candidates and not with the number of templates.  Templates of
over ``MOST_WORDS`` words together are worked through in parts of that size, each a
pass over the documents, so no broadcast grows; documents are never shuffled.

Blocks are lines (`scan`) and, for notices that are wrapped, runs of lines whose
words are within ``STRETCH`` lengths of the template (`scan_wrapped`).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, frequency
from .words import FOLDED, Lines, Slice, slices

THRESHOLD = Fraction(4, 5)
#: Most words that all templates may have together, as every executor gets them.
MOST_WORDS = 4_000_000

TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0": "under the GNU General Public License, version 3",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "agpl-3.0-notice": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "isc-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide",
}


def _needed(size: int, threshold: Fraction) -> int:
    return max(1, -(-threshold.numerator * size // threshold.denominator))


class Templates:
    """Some templates: their words in the order of the documents' frequencies, and an inverted index of their prefixes."""

    def __init__(self, names: list[str], texts: list[str], threshold: Fraction, level: np.ndarray):
        every = [s.hashes for s in (next(slices(pa.array([t]), FOLDED)) for t in texts)]
        keep = [i for i, h in enumerate(every) if len(h)]
        self.names, self.level = [names[i] for i in keep], level
        words = [np.unique(every[i]) for i in keep]
        words = [w[np.lexsort((w, level[frequency.cells(w)]))] for w in words]
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.need = np.array([_needed(len(w), threshold) for w in words], dtype=np.int64)
        #: Most words from the first to the last one of a wrapped notice.
        self.reach = np.array([STRETCH * len(every[i]) for i in keep], dtype=np.int64)
        of = np.repeat(np.arange(len(words)), self.size)
        word = np.concatenate([np.zeros(0, np.uint64), *words])
        at = np.arange(len(word)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        # Which words of all templates a template has: (template, number of the word) as one integer.
        self.vocabulary = np.unique(word)
        self.member = np.sort(of * len(self.vocabulary) + np.searchsorted(self.vocabulary, word))
        first = at <= self.size[of] - self.need[of]
        order = np.argsort(word[first], kind="stable")
        self.prefix, self.template, self.position = word[first][order], of[first][order], at[first][order]
        self.quick = np.zeros(1 << 16, dtype=bool)
        self.quick[(self.prefix >> np.uint64(48)).astype(np.int64)] = True

    def contains(self, template: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether each word is one of the template's beside it."""
        if not len(self.member):
            return np.zeros(len(words), dtype=bool)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        code = template * len(self.vocabulary) + at
        place = np.minimum(np.searchsorted(self.member, code), len(self.member) - 1)
        return (self.vocabulary[at] == words) & (self.member[place] == code)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in hashes, template, position in it) of every word that is in a template's prefix."""
        maybe = np.flatnonzero(self.quick[(hashes >> np.uint64(48)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.prefix, hashes[maybe], side) for side in ("left", "right"))
        n = hi - lo
        k = _spans(lo, n)
        return np.repeat(maybe, n), self.template[k], self.position[k]

    def matches(self, hashes: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, words in common) of the blocks that contain a template; ``block`` numbers them, ascending."""
        place, _, _ = self.hits(hashes)
        wanted = np.unique(block[place])  # the others have no word of a prefix
        if not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = np.isin(block, wanted)
        hashes, block = hashes[own], block[own]
        order = np.lexsort((hashes, self.level[frequency.cells(hashes)], block))
        hashes, block = hashes[order], block[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (block[1:] != block[:-1])])
        hashes, block = hashes[new], block[new]  # distinct words, rare ones first
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        size = np.diff(np.concatenate([first, [len(block)]]))
        of = np.repeat(np.arange(len(first)), size)
        place, template, position = self.hits(hashes)
        b = of[place]
        # The first word in common of each pair; from it on, both must have room.
        order = np.lexsort((position, template, b))
        b, template, position, place = b[order], template[order], position[order], place[order]
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (template[1:] != template[:-1])])
        b, template, position, place = b[new], template[new], position[new], place[new]
        room = np.minimum(size[b] - (place - first[b]), self.size[template] - position)
        b, template = b[room >= self.need[template]], template[room >= self.need[template]]
        if not len(b):
            return b, template, b
        inside = self.contains(np.repeat(template, size[b]), hashes[_spans(first[b], size[b])])
        both = np.add.reduceat(inside.astype(np.int64), np.cumsum(size[b]) - size[b])
        ok = both >= self.need[template]
        return block[first[b[ok]]], template[ok], both[ok]


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def _parts(docs: DataFrame, templates: Mapping[str, str], threshold: Fraction) -> Iterator[Templates]:
    """The templates in parts of at most ``MOST_WORDS`` words."""
    level = frequency.levels(frequency.word_counts(docs, FOLDED))
    names, texts, words = [], [], 0
    for own, text in templates.items():
        n = len(np.unique(next(slices(pa.array([text]), FOLDED)).hashes))
        if n > MOST_WORDS:
            raise ValueError(f"the template {own!r} alone has over {MOST_WORDS} words")
        if words + n > MOST_WORDS:
            yield Templates(names, texts, threshold, level)
            names, texts, words = [], [], 0
        names, texts, words = [*names, own], [*texts, text], words + n
    yield Templates(names, texts, threshold, level)


_SCHEMA = "doc_id bigint, line_no bigint, license string, n_common bigint, n_template bigint"


def _scanned(docs: DataFrame, templates: Mapping[str, str], threshold: Fraction, find) -> DataFrame:
    """What find(slice, templates) yields, (row, line, template, words in common), over all parts and documents."""
    rows, found = common.id_and_text(docs), None
    for part in _parts(docs, templates, threshold):
        sent = docs.sparkSession.sparkContext.broadcast(part)  # at most MOST_WORDS words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(s.rows.start + row, line, sent.value.names[t], both, int(sent.value.size[t])) for s in slices(batch.column(1), FOLDED) for row, line, t, both in find(s, sent.value)]
                row, number, own, both, size = zip(*hits) if hits else ((),) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int64()), pa.array(own, pa.string()), pa.array(both, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "line_no", "license", "n_common", "n_template"])

        made = rows.mapInArrow(run, _SCHEMA)
        found = made if found is None else found.unionByName(made)
    return found


def _lines(s: Slice, templates: Templates) -> Iterator[tuple[int, int, int, int]]:
    lines = Lines(s)
    block, template, both = templates.matches(s.hashes, lines.key)
    at = np.searchsorted(lines.key, block)
    yield from zip(lines.row[at].tolist(), lines.number[at].tolist(), template.tolist(), both.tolist())


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, license, n_common, n_template): every line that contains a template to the threshold.

    Words are folded (ASCII case and punctuation don't count); lines count from
    0; a line may match several templates, and each counts.  Null and empty texts
    match nothing, very long texts and lines are read whole, a null doc_id stays
    null, repeated rows give repeated matches, a template without words never
    matches, other columns are ignored, an empty table gives none.
    """
    return _scanned(docs, templates, threshold, _lines)


#: Most words a wrapped notice may span, in lengths of its template.
STRETCH = 2


def scan_wrapped(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, license, n_common, n_template): every run of two or more lines that contains a template to the threshold.

    What ``scan`` can't see, as its blocks are single lines.  A run's words, from
    its first to its last one of the template, are at most ``STRETCH`` times the
    template's; a run is told by its first line, and runs don't overlap.  Folding,
    nulls, empty and very long texts, repeated rows, other columns and empty tables
    are as in ``scan``.
    """
    return _scanned(docs, templates, threshold, _wrapped)


def _wrapped(s: Slice, templates: Templates) -> Iterator[tuple[int, int, int, int]]:
    lines = Lines(s)
    # A row with a run has all of it, so only rows that contain a template are looked at.
    row, template, _ = templates.matches(s.hashes, lines.row)
    for r, t in zip(row.tolist(), template.tolist()):
        a, b = int(s.first[r]), int(s.first[r + 1])
        at = a + np.flatnonzero(templates.contains(np.full(b - a, t), s.hashes[a:b]))
        which = np.unique(s.hashes[at], return_inverse=True)[1]
        for x, both in _runs(at, which, lines.number, int(templates.need[t]), int(templates.reach[t])):
            yield r, int(lines.number[x]), t, both


def _runs(at: np.ndarray, word: np.ndarray, line: np.ndarray, need: int, reach: int) -> Iterator[tuple[int, int]]:
    """(first word, distinct words) of the stretches with ``need`` distinct words that cross a line."""
    at, word = at.tolist(), word.tolist()
    count: dict[int, int] = {}
    lo, skip = 0, 0
    for hi, w in enumerate(word):
        if hi < skip:
            continue
        count[w] = count.get(w, 0) + 1
        while at[hi] - at[lo] >= reach or count[word[lo]] > 1:
            count[word[lo]] -= 1
            if not count[word[lo]]:
                del count[word[lo]]
            lo += 1
        if len(count) >= need:
            crosses, skip = line[at[lo]] != line[at[hi]], hi + 1
            for j in range(hi + 1, len(at)):  # words still missing, within reach
                if at[j] - at[lo] >= reach:
                    break
                if word[j] not in count:
                    count[word[j]], skip = 1, j + 1
            if crosses:
                yield at[lo], len(count)
            count, lo = {}, skip


def op8_wrapped_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_wrapped(common.table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in TEMPLATES.items())
    fold = lambda x: f"list_distinct(list_filter(string_split_regex(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-/:-@\\[-`{{-\\x7f]+'), lambda w: w <> ''))"
    return f"""
WITH t AS (SELECT license, {fold("body")} AS tw FROM (VALUES {rows}) AS v(license, body)),
d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i AS line_no, {fold("ls[i + 1]")} AS bw FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d)),
m AS (SELECT doc_id, line_no, license, len(list_intersect(bw, tw)) AS n_common, len(tw) AS n_template FROM l, t)
SELECT doc_id, line_no, license, n_common, n_template FROM m
WHERE n_common * {THRESHOLD.denominator} >= n_template * {THRESHOLD.numerator} AND n_template > 0"""


SQL = _sql()
