"""Full-text search with BM25 over a postings table."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable
from ..sources.shared import stored

K1, B = 1.2, 0.75
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def terms(text: Column, stop: bool = True) -> Column:
    """Lower-case runs of letters and digits, without English stop words."""
    return _terms_of(F.lower(text), stop)


def _runs(low: Column) -> Column:
    return F.split(low, r"[^\p{L}\p{N}]+")


def _skipped(stop: bool) -> list[str]:
    return ["", *(sorted(STOP_WORDS) if stop else [])]


def _terms_of(low: Column, stop: bool) -> Column:
    return F.filter(_runs(low), lambda t: ~t.isin(_skipped(stop)))


def _frequency(term: str) -> Column:
    """How often a document has a term; most have it nowhere, which takes no look at their term lists."""
    return F.when(F.col("low").contains(term), F.size(F.filter("ts", lambda t: t == term))).otherwise(0)


#: Runs that a worker counts at a time (those of one document at least), and terms that leave it at a time.
RUNS_AT_ONCE, TERMS_AT_ONCE = 1 << 22, 20_000


def _packed(batches: Iterable[pa.RecordBatch], stop: bool) -> Iterator[pa.RecordBatch]:
    """Of (id, runs): for each few documents a row with their lengths, and one for each of their terms, with who has it how often."""
    for batch in batches:
        runs = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)) // RUNS_AT_ONCE
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(runs)) + 1, [len(batch)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                yield from _counted(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), stop)


def _counted(ids: pa.Array, runs: pa.Array, stop: bool) -> Iterator[pa.RecordBatch]:
    n, coded = len(ids), runs.flatten().dictionary_encode()
    code, doc = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(n), runs.value_lengths().to_numpy(zero_copy_only=False))
    kept = ~pc.is_in(coded.dictionary, pa.array(_skipped(stop))).to_numpy(zero_copy_only=False)[code]
    code, doc = code[kept].astype(np.int64), doc[kept]
    dl = np.bincount(doc, minlength=n)
    yield _rows("lengths", pa.array([None], pa.string()), np.array([0, n]), ids, dl, None)
    pairs, tf = np.unique(code * n + doc, return_counts=True)
    code, doc = np.divmod(pairs, n)
    starts = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))
    for lo in range(0, len(starts) - 1, TERMS_AT_ONCE):
        own = starts[lo : lo + TERMS_AT_ONCE + 1]
        here = slice(own[0], own[-1])
        yield _rows("postings", coded.dictionary.take(pa.array(code[own[:-1]])), own - own[0], ids.take(pa.array(doc[here])), dl[doc[here]], tf[here])


def _rows(what: str, term: pa.Array, starts: np.ndarray, ids: pa.Array, dl: np.ndarray, tf: np.ndarray | None) -> pa.RecordBatch:
    lists = lambda x, at=starts: pa.ListArray.from_arrays(pa.array(at, pa.int32()), x)
    tfs = lists(pa.array([], pa.int32()), starts * 0) if tf is None else lists(pa.array(tf, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([what] * len(term)), term, lists(ids), lists(pa.array(dl, pa.int32())), tfs], ["what", "term", "ids", "dl", "tf"])


class TextIndex:
    """Term lists of documents (null texts aren't indexed), or, once saved, their postings by term.

    What a query finds in the texts is kept, and how many documents of what length
    there are: only texts with a term are taken apart by later ones.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, stop: bool = True):
        self.key, self.stop = key, stop
        low = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.lower(text).alias("low"))
        self.tokens = low.select("id", "low", _terms_of(F.col("low"), stop).alias("ts"))
        self.path, self.gone = None, None
        self.sizes, self.found = None, {}

    def save(self, path: str) -> TextIndex:
        """Store the postings, sorted by term, and the documents' lengths; a saved index reads only what a query asks for.

        Terms are counted in each batch of documents, so what is shuffled and stored is
        a row for each term and batch, not one for each term and document.
        """
        spark, path, stop = self.tokens.sparkSession, path.rstrip("/"), self.stop
        reachable(spark)
        runs = self.tokens.select("id", _runs(F.col("low")).alias("runs"))
        packed = runs.mapInArrow(lambda batches: _packed(batches, stop), f"what string, term string, ids array<{runs.schema['id'].dataType.simpleString()}>, dl array<int>, tf array<int>")
        placed = packed.repartition("what", F.coalesce(F.col("term"), F.get("ids", F.lit(0)).cast("string"))).sortWithinPartitions("what", "term")
        placed.write.partitionBy("what").parquet(path)
        return TextIndex.load(spark, path, self.key, self.stop)

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str, stop: bool = True) -> TextIndex:
        out = object.__new__(cls)
        out.key, out.stop, out.path, out.gone, out.tokens = key, stop, path.rstrip("/"), None, None
        out.sizes, out.found = None, {}
        out.spark = spark
        return out

    def delete(self, keys: DataFrame) -> TextIndex:
        """The index without some documents (a one-column DataFrame of keys)."""
        out = object.__new__(TextIndex)
        out.__dict__ |= self.__dict__ | {"sizes": None, "found": {}}
        gone = keys.toDF("id")
        if self.path:
            out.gone = gone if self.gone is None else self.gone.unionByName(gone)
        else:
            out.tokens = self.tokens.join(gone, "id", "left_anti")
        return out

    def _saved(self, what: str, wanted: list[str] | None = None) -> DataFrame:
        """(id, dl) of all documents, or (id, dl, tf, term) of those that have the wanted terms."""
        rows = self.spark.read.parquet(f"{self.path}/what={what}")
        if wanted is None:
            rows = rows.select(F.inline(F.arrays_zip("ids", "dl")))
        else:
            rows = rows.filter(F.col("term").isin(wanted)).select("term", F.inline(F.arrays_zip("ids", "dl", "tf")))
        rows = rows.withColumnRenamed("ids", "id")
        return rows if self.gone is None else rows.join(self.gone, "id", "left_anti")

    def count(self) -> int:
        return (self._saved("lengths") if self.path else self.tokens).count()

    def _matches(self, wanted: list[str]) -> tuple[DataFrame, dict]:
        """(id, dl, tf): documents with the frequencies of the wanted terms; and (n, avgdl, df) over all documents."""
        having = [F.count(F.when(F.col("tf")[i] > 0, 1)).alias(f"d{i}") for i in range(len(wanted))]
        if self.path:
            of = self._saved("postings", wanted)
            rows = of.groupBy("id", "dl").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)) for t in wanted)).alias("tf"))
            totals = self._saved("lengths").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
            counted = rows.agg(*having)
            return rows, totals.first().asDict() | counted.first().asDict()
        # One pass over the texts: what they become is as small as their lengths.
        if tuple(wanted) not in self.found:
            texts = self.tokens if self.sizes is None else self.tokens.filter(reduce(lambda x, y: x | y, [F.col("low").contains(t) for t in wanted]))
            rows = stored(texts.select("id", F.size("ts").alias("dl"), F.array(*map(_frequency, wanted)).alias("tf")), "matches")
            totals = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *having).first().asDict()
            self.sizes = self.sizes or {k: totals[k] for k in ("n", "avgdl")}
            self.found[tuple(wanted)] = rows, totals | self.sizes
        return self.found[tuple(wanted)]

    def scores(self, query: str) -> DataFrame:
        """(key, score) of all documents that have a term of the query."""
        spark = self.spark if self.path else self.tokens.sparkSession
        wanted = sorted(set(spark.range(1).select(terms(F.lit(query), self.stop)).first()[0]))  # the words of the query
        if not wanted:
            kind = (self._saved("lengths") if self.path else self.tokens).schema["id"].dataType.simpleString()
            return spark.createDataFrame([], f"`{self.key}` {kind}, score double")
        rows, all_ = self._matches(wanted)
        length = 1 - B + B * F.col("dl") / F.lit(float(all_["avgdl"] or 1))
        score = F.lit(0.0)
        for i in range(len(wanted)):
            df, tf = all_[f"d{i}"], F.col("tf")[i]
            score += F.lit(math.log(1 + (all_["n"] - df + 0.5) / (df + 0.5))) * tf * (K1 + 1) / (tf + K1 * length)
        return rows.filter(F.exists("tf", lambda n: n > 0)).select(F.col("id").alias(self.key), score.alias("score"))

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """The best documents, ties by key."""
        return self.scores(query).orderBy(F.desc("score"), self.key).limit(limit)

    def score(self, key, query: str) -> tuple[float, bool]:
        """A document's score and whether it matches at all."""
        row = self.scores(query).filter(F.col(self.key) == key).first()
        return (row["score"], True) if row else (0.0, False)
