"""Search over many vectors and texts against plain versions."""

import math
import operator
from functools import reduce

import numpy as np
import pytest

from marlstone.operators import vector
from marlstone.plans import catalogue


def plain_nearest(rows, queries, k, kind):
    """(query_key, key, distance, rank) by a loop over all pairs; elements are added from first to last."""
    out = []
    added = lambda t: reduce(operator.add, t, 0.0)
    for qk, q in queries:
        own = []
        for key, v in rows:
            if q is None or v is None or len(q) != len(v) or None in q or None in v:
                continue
            if kind == "l2":
                d = math.sqrt(added((a - b) * (a - b) for a, b in zip(v, q)))
            elif kind == "inner":
                d = -added(a * b for a, b in zip(v, q))
            else:
                size = math.sqrt(added(a * a for a in v) * added(b * b for b in q))
                if size == 0:
                    continue
                d = 1 - added(a * b for a, b in zip(v, q)) / size
            own.append((math.isnan(d), 0.0 if math.isnan(d) else d, key))
        out += [(qk, key, "nan" if bad else d, i + 1) for i, (bad, d, key) in enumerate(sorted(own)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["l2", "cosine", "inner"])
@pytest.mark.parametrize("cells", [1, 12])
def test_nearest_of_many_queries(spark, monkeypatch, kind, cells):
    rng = np.random.default_rng(3)
    x = [[float(v) for v in r] for r in rng.normal(size=(150, 6))]
    x += x[:20] + [[v + 1e-9 for v in r] for r in x[:10]] + [[1000 + v for v in r] for r in x[:10]]  # ties, nearly ties, a long way off
    odd = [None, [], [1.0], [None] * 6, [0.0] * 6, [1e-170] * 6, [1e170] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1e25] * 6, [2.0]]
    rows = [(f"k{i * 37 % 251:03d}", v) for i, v in enumerate(x + odd)]
    monkeypatch.setattr(vector, "_grid", lambda *_: (cells // 3 or 1, min(cells, 3)))
    df = spark.createDataFrame(rows, "key string, v array<double>")
    got = vector.search_many(df, df, 4, "key", "v", "key", "v", kind)
    mine = sorted(((r.query_key, r.key, "nan" if math.isnan(r.distance) else r.distance, r["rank"]) for r in got.collect()), key=repr)
    assert mine == plain_nearest(rows, rows, 4, kind)


def test_nearest_of_many_queries_without_rows_or_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "key bigint, v array<double>")
    none = df.filter("key < 0")
    for a, b in ((df, none), (none, df), (none, none)):
        got = vector.search_many(a, b, 3, "key", "v", "key", "v")
        assert got.dtypes[:3] == [("query_key", "bigint"), ("key", "bigint"), ("distance", "double")] and got.collect() == []


def test_pairs_are_neither_joined_nor_shuffled(spark):
    x = np.random.default_rng(5).normal(size=(3000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, v array<float>")
    got = vector.search_many(df, df, 3, "key", "v", "key", "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    x = x.astype(np.float32).astype(float)
    want = {(i, int(j), r) for i, v in enumerate(x) for r, j in enumerate(np.argsort(((x - v) ** 2).sum(axis=1), kind="stable")[:3], 1)}
    assert {(r.query_key, r.key, r["rank"]) for r in got.collect()} == want


def test_cells_are_bounded():
    for rows, queries in ((10**6, 10**6), (10**9, 5), (5, 10**9), (10**7, 10**5)):
        across, down = vector._grid(rows, queries, 560, 12)
        assert queries / down * 560 <= vector.CELL_BYTES and rows / across * (queries / down) <= 1.01 * vector.MANY_PAIRS
    assert vector._grid(0, 0, 8, 12) == vector._grid(500, 500, 560, 12) == (1, 1)


def test_vector_table_where_the_added_number_is_an_id_already(spark, sf, tmp_path):
    import duckdb

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    e.unionByName(e.withColumn("vec_id", e.vec_id + 500)).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")  # every vector twice
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert con.sql("SELECT count(*) FROM embeddings WHERE vec_id = 777").fetchall() == [(1,)]
    got = catalogue.QUERIES["vector_table"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalogue.SQL["vector_table"]).fetchall())
