"""Token counts with a whole-token shortcut.

Offline, on the driver, every vocabulary string that encodes alone as one token
is proven once (`vocabulary.prove_whole`).  Executors split each text into
pre-tokens; one that is in the proven set counts as one token at a look-up, and
only the rest run through the merges (remembered per worker, as words recur).
The scan is one narrow stage: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, vocabulary

#: Pieces whose merged length a worker remembers before it starts afresh; bounds memory, never the result.
REMEMBERED = 300_000
#: Longest piece, in characters, that is remembered; longer ones hardly recur.
LONGEST = 64
_WHOLE = 1 << 40


class _Lengths(dict):
    """Tokens of a pre-token; one proven whole also adds ``_WHOLE``."""

    def __init__(self, whole: list[str], path: str):
        super().__init__(dict.fromkeys(whole, _WHOLE + 1))
        self.merge = vocabulary.encoding(path)._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(piece.encode("utf-8")))
        if len(piece) <= LONGEST:
            self[piece] = n
        return n


_memo: dict[str, _Lengths] = {}


def count_tokens(docs: DataFrame, path: str = vocabulary.RANKS_PATH) -> DataFrame:
    """(doc_id, n_pretokens, n_whole, n_tokens), a row for each row of docs.

    ``n_whole`` pre-tokens were counted by the shortcut, ``n_tokens`` is the
    length of the whole text's encoding.  A null text gives nulls, an empty one
    zeros, a very long one is counted whole; a null doc_id stays null; repeated
    rows are counted each; other columns are ignored; an empty table gives none.
    """
    whole = docs.sparkSession.sparkContext.broadcast(sorted(vocabulary.prove_whole(path)))  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = vocabulary.splitter().findall
        for batch in batches:
            rows: list[list] = [[], [], []]
            for text in batch.column(1).to_pylist():
                lengths = _memo.get(path)
                if lengths is None or len(lengths) > REMEMBERED:
                    lengths = _memo[path] = _Lengths(whole.value, path)
                if text is None:
                    found: tuple = (None, None, None)
                else:
                    pieces = split(text)
                    both = sum(map(lengths.__getitem__, pieces))
                    found = (len(pieces), both // _WHOLE, both % _WHOLE)
                for to, x in zip(rows, found):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in rows)], ["doc_id", "n_pretokens", "n_whole", "n_tokens"])

    return common.id_and_text(docs).mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_whole bigint, n_tokens bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
