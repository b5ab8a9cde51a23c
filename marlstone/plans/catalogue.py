"""The registry of the engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.lexer import name
from ..operators.recursive import fixpoint
from ..session import prepare
from .parser import to_spark

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query in the engine's dialect over the Parquet tables in a folder."""
    prepare(spark)

    def resolve(table: str) -> str:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"t_{table}")
        return name(f"t_{table}")

    def types(table: str) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in spark.table(resolve(table)).schema}

    text, recursive = to_spark(sql, resolve=resolve, types=types)
    for r in recursive:
        base = spark.sql(r.base)
        base = base.toDF(*r.columns) if r.columns else base

        def step(work: DataFrame, r=r) -> DataFrame:
            work.createOrReplaceTempView(r.name)
            return spark.sql(r.step)

        fixpoint(base, step).createOrReplaceTempView(r.name)
    return spark.sql(text)


def dialect(key: str, sql: str, oracle: str | None = None) -> None:
    """Register a query of the dialect; DuckDB runs the same text, or ``oracle`` where it spells it otherwise."""
    QUERIES[key] = lambda spark, sf_dir: run(spark, sf_dir, sql)
    SQL[key] = oracle or sql


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


from . import queries_behaviour, queries_changes, queries_functions, queries_relational, queries_search  # noqa: E402, F401
