"""Nearest neighbours over array columns.

Exact search keeps everything in the JVM: one pass of `aggregate(zip_with)` and
a top-k.  For many queries, blocks of pairs are excluded by a matrix product
first.  The approximate index hashes
vectors with random hyperplanes into a few tables; candidates in the query's
bucket, or in one across a single hyperplane, are ranked exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexer import SqlError
from ..session import reachable
from ..sources.shared import Files

METRICS = {"<->": "l2", "<=>": "cosine", "<#>": "inner", "l2": "l2", "cosine": "cosine", "inner": "inner"}


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """L2, cosine distance, or the negative inner product; null for vectors of other lengths, and for cosine with a vector of zeros."""
    kind = METRICS.get(metric)
    if kind is None:
        raise SqlError("22023", f"metric {metric!r} isn't known")
    if kind == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    if kind == "inner":
        return -_dot(a, b)
    return 1 - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a) * _dot(b, b)))


def checked(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """rows, failing on a vector that hasn't ``dims`` elements (null vectors pass and never match)."""
    return rows.withColumn(vector, F.when(F.col(vector).isNull() | (F.size(vector) == dims), F.col(vector)).otherwise(F.raise_error(F.lit(f"22000: a vector hasn't {dims} dimensions"))))


def search(rows: DataFrame, vector: str, query: Sequence[float], k: int, metric: str = "l2", key: str | None = None) -> DataFrame:
    """The k rows nearest to one query, with ``distance``; ties by ``key``.

    Rows without a distance never match: null vectors, those of another length, and
    vectors of zeros for cosine.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    found = rows.withColumn("distance", distance(F.col(vector), q, metric)).filter(F.col("distance").isNotNull())
    return found.orderBy("distance", *([key] if key else [])).limit(k)


#: Rows and queries that are multiplied at a time, elements of a pass over pairs; a cell's pairs (no fewer, unless cores would idle; no more) and bytes.
CHUNK, PART, PASS, FEW_PAIRS, MANY_PAIRS, CELL_BYTES = 1024, 4096, 1 << 20, 1 << 23, 1 << 33, 1 << 26


def search_many(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, query_key: str, query_vector: str, metric: str = "l2") -> DataFrame:
    """(query_key, key, distance, rank): the k nearest rows of each query, ties by ``key``.

    Every pair is looked at, in cells: a part of the queries with a part of the rows.  A
    task holds one cell's queries and a batch of its rows; only the k nearest rows of
    each query and cell are shuffled.  Pairs without a distance never match.
    """
    kind, spark = METRICS.get(metric), rows.sparkSession
    if kind is None:
        raise SqlError("22023", f"metric {metric!r} isn't known")
    reachable(spark)

    def side(df: DataFrame, own: str, v: str) -> DataFrame:
        as_is = df.select(v).schema[0].dataType.simpleString() == "array<float>"
        return df.select(F.col(own).alias("key"), (F.col(v) if as_is else F.col(v).cast("array<double>")).alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))

    a, b = side(rows, key, vector), side(queries, query_key, query_vector)
    (n, _), (m, dims) = (x.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first() for x in (a, b))
    across, down = _grid(n, m, 8 * (dims + 2 * k + 1), spark.sparkContext.defaultParallelism)
    place = lambda parts: F.pmod(F.xxhash64("key", "v"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    none = lambda x: F.lit(None).cast(x.schema["key"].dataType)
    left = a.select(every(down).alias("i"), place(across).alias("j"), F.lit(True).alias("is_row"), none(b).alias("query_key"), "key", "v")
    right = b.select(place(down).alias("i"), every(across).alias("j"), F.lit(False).alias("is_row"), F.col("key").alias("query_key"), none(a).alias("key"), "v")
    cells = left.unionByName(right).repartitionById(across * down, F.col("i") * across + F.col("j")).sortWithinPartitions("is_row", "key").drop("i", "j")
    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    found = cells.mapInArrow(lambda batches: _nearest(batches, k, kind), f"query_key {types['query_key']}, key {types['key']}, distance double")
    w = Window.partitionBy("query_key").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _grid(rows: int, queries: int, query_bytes: int, cores: int) -> tuple[int, int]:
    """Into how many parts the rows and the queries are cut."""
    pairs = rows * queries
    cells = max(1, -(-pairs // MANY_PAIRS), min(pairs // FEW_PAIRS, 8 * cores))
    down = max(1, round((cells * queries / max(1, rows)) ** 0.5), -(-queries * query_bytes // CELL_BYTES))
    return -(-cells // down), down


def _nearest(batches: Iterable[pa.RecordBatch], k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """A cell's result; its queries come first, then its rows in the order of their keys."""
    queries: list[pa.RecordBatch] = []
    groups: dict[int, _Nearest] | None = None
    for batch in batches:
        n = len(batch) - int(batch.column("is_row").to_numpy(zero_copy_only=False).sum())
        if n:
            queries.append(batch.slice(0, n))
        if n < len(batch) and groups is None:
            groups = {d: _Nearest(keys, x, k, kind) for d, keys, x in _by_length(queries, "query_key")}
            queries.clear()
        for lo in range(n, len(batch), CHUNK):
            for d, keys, x in _by_length([batch.slice(lo, CHUNK)], "key"):
                if d in groups:
                    groups[d].add(keys, x)
    for g in (groups or {}).values():
        yield from g.found()


def _by_length(batches: list[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, keys, vectors) of each length that occurs, in the order of the rows."""
    if not batches:
        return
    table = pa.Table.from_batches(batches).select([key, "v"]).combine_chunks()
    keys, vectors = (pa.concat_arrays(table[c].chunks) for c in (key, "v"))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for d in map(int, np.unique(lengths)):
        own = pa.array(np.flatnonzero(lengths == d))
        yield d, keys.take(own), vectors.take(own).flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)


class _Nearest:
    """The k nearest rows, so far, of queries of one length.

    A matrix product in single precision gives each pair a bound below its distance.
    Only pairs whose bound isn't over the query's k-th distance get the distance
    itself, in double precision and added up in the order in which ``distance`` does.
    """

    def __init__(self, keys: pa.Array, x: np.ndarray, k: int, kind: str):
        self.keys, self.x, self.k, self.kind = keys, x, k, kind
        self.left, self.base, self.plain = self._bounds(x, True)
        self.best = np.full((len(x), k), np.inf)
        self.at = np.full((len(x), k), -1)  # in the keys kept; they are in order for each query
        self.kept: list[pa.Array] = []
        self.size = 0

    def _bounds(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is multiplied, what a query adds, and which vectors are such that this gives a bound.

        A product of d elements is off by at most (d + 8) 2^-24 |q| |r|, and |q| |r| is at
        most half of |q|^2 + |r|^2.  Twice as much is taken off; a row's part of it stands
        in one more column.
        """
        wide = x.astype(np.float64)
        with np.errstate(all="ignore"):
            square = (wide * wide).sum(axis=1)
        plain = (square < 1e30) & ((square > 1e-24) | (square == 0))
        wide, square = np.where(plain[:, None], wide, 0), np.where(plain, square, 0)
        off = 2 * (x.shape[1] + 8) * 2.0**-24
        if self.kind == "cosine":
            wide, part = wide / np.sqrt(np.where(square > 0, square, 1))[:, None], np.full(len(x), 1 - off if query else -off)
        else:
            part = square * (1 - 2 * off) if self.kind == "l2" else square * -off
        if query:
            wide = wide * (-2 if self.kind == "l2" else -1)
        return np.column_stack([wide, np.ones(len(x)) if query else part]).astype(np.float32), part, plain

    def _distances(self, q: np.ndarray, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distances of pairs, and whether they have one."""
        out, there, step = np.zeros(len(q)), np.ones(len(q), bool), max(1, PASS // max(1, x.shape[1]))
        added = lambda t: 0.0 + np.add.accumulate(t, axis=1)[:, -1] if t.shape[1] else np.zeros(len(t))
        with np.errstate(all="ignore"):
            for lo in range(0, len(q), step):
                own = slice(lo, lo + step)
                a, b = x[r[own]].astype(np.float64), self.x[q[own]].astype(np.float64)
                if self.kind == "l2":
                    out[own] = np.sqrt(added((a - b) * (a - b)))
                elif self.kind == "inner":
                    out[own] = -added(a * b)
                else:
                    size = np.sqrt(added(a * a) * added(b * b))
                    out[own], there[own] = 1 - added(a * b) / size, size != 0
        return out, there

    def _limits(self, lo: int, low: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How low the bounds of pairs must be that may be among the k nearest."""
        own = slice(lo, lo + len(low))
        full = self.at[own, -1] >= 0
        worst = np.where(full & ~np.isnan(self.best[own, -1]), self.best[own, -1], np.inf)
        if not full.all() and len(x) > 4 * self.k:  # any k rows give a limit
            some = np.argpartition(low, self.k - 1, axis=1)[:, : self.k]
            d, there = self._distances(np.repeat(np.arange(lo, lo + len(low)), self.k), x, some.ravel())
            worst = np.minimum(worst, np.where(there & ~np.isnan(d), d, np.inf).reshape(-1, self.k).max(axis=1))
        with np.errstate(all="ignore"):
            worst = worst * worst * (1 + 1e-9) if self.kind == "l2" else worst + 1e-9 * np.maximum(1, np.abs(worst))
            return np.nextafter((worst - self.base[own]).astype(np.float32), np.float32(np.inf))

    def add(self, keys: pa.Array, x: np.ndarray) -> None:
        """More rows; their keys come after all before."""
        right, _, plain = self._bounds(x, False)
        for lo in range(0, len(self.x), PART):
            low = self.left[lo : lo + PART] @ right.T
            low[:, ~plain] = -np.inf
            low[~self.plain[lo : lo + PART]] = -np.inf
            q, r = np.nonzero(low <= self._limits(lo, low, x)[:, None])
            if not len(q):
                continue
            q += lo
            d, there = self._distances(q, x, r)
            rows, at = np.unique(r, return_inverse=True)
            self._merge(q[there], d[there], self.size + at[there])
            self.kept.append(keys.take(pa.array(rows)))
            self.size += len(rows)

    def _merge(self, q: np.ndarray, d: np.ndarray, at: np.ndarray) -> None:
        changed = np.unique(q)
        i, j = np.nonzero(self.at[changed] >= 0)
        q, d, at = np.concatenate([changed[i], q]), np.concatenate([self.best[changed[i], j], d]), np.concatenate([self.at[changed[i], j], at])
        order = np.lexsort((at, d, np.isnan(d), q))
        q, d, at = q[order], d[order], at[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        near = rank < self.k
        self.best[q[near], rank[near]], self.at[q[near], rank[near]] = d[near], at[near]

    def found(self) -> Iterator[pa.RecordBatch]:
        kept = pa.concat_arrays(self.kept) if self.kept else None
        for lo in range(0, len(self.x), PART):
            q, j = np.nonzero(self.at[lo : lo + PART] >= 0)
            if len(q):
                yield pa.RecordBatch.from_arrays([self.keys.take(pa.array(q + lo)), kept.take(pa.array(self.at[q + lo, j])), pa.array(self.best[q + lo, j])], ["query_key", "key", "distance"])


class HyperplaneIndex:
    """Approximate search: ``tables`` hash tables of ``bits`` hyperplanes through the middle of the data."""

    def __init__(self, rows: DataFrame, key: str, vector: str, dims: int, bits: int = 8, tables: int = 32, seed: int = 7):
        self.key, self.vector, self.dims = key, vector, dims
        self.planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
        known = rows.filter(F.size(vector) == dims)  # others never match
        middle = known.select(F.posexplode(vector)).groupBy("pos").agg(F.avg("col")).orderBy("pos").collect()  # one row a dimension
        self.middle = np.array([r[1] for r in middle] or [0.0] * dims)
        self.buckets = known.select("*", F.explode(self._hash(F.col(vector))).alias("bucket"))

    @classmethod
    def with_middle(cls, middle: np.ndarray, bits: int, tables: int, seed: int) -> HyperplaneIndex:
        """The hyperplanes alone, through a known middle."""
        out = object.__new__(cls)
        out.dims, out.middle = len(middle), middle
        out.planes = np.random.default_rng(seed).normal(size=(tables, bits, len(middle)))
        return out

    def _hash(self, v: Column) -> Column:
        """One bucket number for each table, by an Arrow-batched matrix product."""
        planes, middle = self.planes.reshape(-1, self.dims), self.middle
        tables, bits = self.planes.shape[:2]

        @F.pandas_udf("array<struct<t:int,b:int>>")
        def hashed(vectors: pd.Series) -> pd.Series:
            side = (np.stack(vectors.to_numpy()) - middle) @ planes.T > 0
            codes = (side.reshape(len(vectors), tables, bits) << np.arange(bits)).sum(axis=2)
            return pd.Series([[{"t": t, "b": int(b)} for t, b in enumerate(row)] for row in codes])

        return hashed(v)

    def _buckets(self, query: Iterable[float]) -> list[tuple[int, int]]:
        """In each table, the query's own bucket and those that differ in one bit."""
        side = self.planes @ (np.asarray(list(query)) - self.middle) > 0
        own = [(t, int((s << np.arange(len(s))).sum())) for t, s in enumerate(side)]
        return own + [(t, b ^ 1 << i) for t, b in own for i in range(side.shape[1])]

    def search(self, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
        at = [F.struct(F.lit(t).alias("t"), F.lit(b).alias("b")) for t, b in self._buckets(query)]
        near = self.buckets.filter(F.col("bucket").isin(at)).drop("bucket").dropDuplicates([self.key])
        return search(near, self.vector, query, k, metric, self.key)


class VectorTable:
    """A stored set of vectors of one length, by key, with its hyperplane buckets.

    Each upsert writes one more generation: its vectors, by hash table and sorted by
    bucket, and its keys.  A search reads only the buckets it looks at, and of a key
    only the last generation counts.  The hyperplanes go through the middle of the
    first generation.  ``snapshot`` and ``load`` are a copy of the folder and another
    object on it.
    """

    def __init__(self, spark: SparkSession, path: str, dims: int, bits: int = 8, tables: int = 32, seed: int = 7):
        self.spark, self.path, self.dims = spark, path.rstrip("/"), dims
        self.files = Files(spark, self.path)
        made = self.files.read("index") if self.files.names("") else None
        if made is None:
            self.index = None
            self.how = {"bits": bits, "tables": tables, "seed": seed}
        else:
            held = json.loads(made)
            if held["dims"] != dims:
                raise SqlError("22000", f"the vectors have {held['dims']} dimensions")
            self._use(held)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorTable:
        """What was stored, or copied by ``snapshot``, under a path."""
        text = Files(spark, path.rstrip("/")).read("index")
        if text is None:
            raise SqlError("58P01", f"there is no vector table in {path!r}")
        return cls(spark, path, json.loads(text)["dims"])

    def _use(self, held: dict) -> None:
        self.how = held["how"]
        self.index = HyperplaneIndex.with_middle(np.array(held["middle"]), **self.how)

    def upsert(self, rows: DataFrame, key: str = "key", vector: str = "vector") -> None:
        """Add vectors, or replace those of the same keys; 22000 if one has another length, and nothing is changed."""
        rows = rows.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
        if not rows.filter(F.col("key").isNull() | F.col("vector").isNull() | (F.size("vector") != self.dims) | F.exists("vector", lambda x: x.isNull())).isEmpty():
            raise SqlError("22000", f"a vector hasn't {self.dims} dimensions")
        if self.index is None:
            middle = rows.select(F.posexplode("vector")).groupBy("pos").agg(F.avg("col")).orderBy("pos").collect()  # one row a dimension
            held = {"dims": self.dims, "how": self.how, "middle": [r[1] for r in middle] or [0.0] * self.dims}
            self.files.create("index", json.dumps(held))
            self._use(json.loads(self.files.read("index")))
        n = max((int(g.removeprefix("keys-")) for g in self.files.names("") if g.startswith("keys-")), default=-1) + 1
        placed = rows.dropDuplicates(["key"]).select("key", "vector", F.explode(self.index._hash(F.col("vector"))).alias("at")).select("key", "vector", F.lit(n).alias("generation"), "at.t", "at.b")
        placed.repartition("t").sortWithinPartitions("t", "b").write.partitionBy("t").parquet(f"{self.path}/vectors-{n}")
        keys = self.spark.read.parquet(f"{self.path}/vectors-{n}").filter("t = 0").select("key", F.col("generation").alias("last"))
        keys.write.parquet(f"{self.path}/keys-{n}")  # what makes the generation count

    def _stored(self, what: str) -> list[str]:
        done = {g.removeprefix("keys-") for g in self.files.names("") if g.startswith("keys-") and "_SUCCESS" in self.files.names(g)}
        return [f"{self.path}/{what}-{n}" for n in sorted(done, key=int)]

    def rows(self) -> DataFrame:
        """(key, vector): every key's last vector."""
        if not self._stored("keys"):
            return self.spark.createDataFrame([], "key string, vector array<double>")
        return self._last(reduce(DataFrame.unionByName, [self.spark.read.parquet(p).filter("t = 0") for p in self._stored("vectors")])).select("key", "vector")

    def _last(self, found: DataFrame) -> DataFrame:
        keys = reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in self._stored("keys")]).groupBy("key").agg(F.max("last").alias("last"))
        return found.join(keys, "key").filter(F.col("generation") == F.col("last"))

    def search(self, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
        """(key, vector, distance): about the k nearest, from the buckets near the query."""
        if len(query) != self.dims:
            raise SqlError("22000", f"the query hasn't {self.dims} dimensions")
        if not self._stored("keys"):
            return self.rows().withColumn("distance", F.lit(None).cast("double"))
        near = {}
        for t, b in self.index._buckets(query):
            near.setdefault(t, []).append(b)
        wanted = reduce(lambda x, y: x | y, [(F.col("t") == t) & F.col("b").isin(bs) for t, bs in near.items()])
        found = reduce(DataFrame.unionByName, [self.spark.read.parquet(p).filter(wanted) for p in self._stored("vectors")])
        return search(self._last(found).select("key", "vector").dropDuplicates(["key"]), "vector", query, k, metric, "key")

    def snapshot(self, to: str) -> None:
        """Copy the table to another folder."""
        self.files.copy("", to)
