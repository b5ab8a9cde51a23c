"""Every catalogue query that has SQL gives DuckDB's rows at the smallest size."""

import decimal
import glob
import os

import duckdb
import pytest

from marlstone.plans import catalogue


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return float(v) if isinstance(v, decimal.Decimal) else v


#: One of each family; the driver compares all of them.
CHOSEN = [k for i, k in enumerate(catalogue.SQL) if i % 4 == 0 or k.startswith(("fn_", "knn", "bm25", "branch", "stream", "cte", "distinct", "constraint", "vector", "text", "spans"))]


@pytest.mark.parametrize("key", CHOSEN)
def test_rows(spark, sf, oracle, key):
    got = catalogue.QUERIES[key](spark, sf)
    want = oracle.sql(catalogue.SQL[key])
    assert sorted(got.columns) == sorted(want.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in want.columns)) for r in got.collect())
    assert mine == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())


def test_filters_reach_the_scan(spark, sf):
    plan = catalogue.QUERIES["filter_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_comment" not in plan


def test_approximate_search_recall(spark, sf):
    from marlstone.operators import vector

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    all_rows = e.collect()
    index = vector.HyperplaneIndex(e, "vec_id", "embedding", len(all_rows[0].embedding), bits=4)
    index.buckets = index.buckets.cache()
    hits = 0
    for q in all_rows[:5]:
        exact = {r.vec_id for r in vector.search(e, "embedding", q.embedding, 5, key="vec_id").collect()}
        near = [r.vec_id for r in index.search(q.embedding, 5).collect()]
        assert near[0] == q.vec_id
        hits += len(exact & set(near))
    assert hits >= 0.9 * 25


def test_recall_of_the_default_index_over_all_rows(spark, sf):
    import numpy as np

    from marlstone.operators import vector

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.collect()
    index = vector.HyperplaneIndex(e, "vec_id", "embedding", len(rows[0].embedding))
    members = {}
    for r in index.buckets.select("vec_id", "bucket.*").collect():
        members.setdefault((r.t, r.b), set()).add(r.vec_id)
    x = np.array([r.embedding for r in rows], dtype=float)
    hits = 0
    for r, v in zip(rows, x):
        exact = [rows[i].vec_id for i in np.argsort(((x - v) ** 2).sum(axis=1), kind="stable")[:10]]
        near = set().union(*(members.get(b, set()) for b in index._buckets(r.embedding)))
        hits += len(near.intersection(exact))
    assert hits >= 0.95 * 10 * len(rows)
