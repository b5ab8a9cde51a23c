"""JSON functions that Spark has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _load(text):
    return None if text is None else json.loads(text)


def _dump(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _path(path: str) -> list[str]:
    return [p.strip().strip('"') for p in path.strip("{}").split(",")] if path.strip("{}") else []


def set_at(doc, path: list[str], value, create: bool):
    """doc with value at path; missing steps of objects are added if ``create``."""
    if not path:
        return doc
    step, rest = path[0], path[1:]
    if isinstance(doc, dict):
        if step not in doc and not create:
            return doc
        return doc | {step: set_at(doc.get(step, {}), rest, value, create) if rest else value}
    if isinstance(doc, list) and step.lstrip("-").isdigit():
        i = int(step)
        i = i + len(doc) if i < 0 else i
        if 0 <= i < len(doc):
            return [*doc[:i], set_at(doc[i], rest, value, create) if rest else value, *doc[i + 1 :]]
        if create and not rest:
            return [*doc, value] if i >= len(doc) else [value, *doc]
    return doc


def contains(a, b) -> bool:
    """Whether a contains b, by structure."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(contains(x, y) for x in a) for y in b) if isinstance(b, list) else any(type(x) is type(b) and x == b for x in a)
    return type(a) is type(b) and a == b


def minus(doc, key: str, index: bool):
    if isinstance(doc, dict):
        return {k: v for k, v in doc.items() if k != key}
    if isinstance(doc, list):
        if index:
            i = int(key)
            i = i + len(doc) if i < 0 else i
            return [x for j, x in enumerate(doc) if j != i]
        return [x for x in doc if x != key]
    return doc


def register(spark: SparkSession) -> None:
    @F.pandas_udf("string")
    def pg_jsonb_set(doc: pd.Series, path: pd.Series, value: pd.Series, create: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or p is None or v is None else _dump(set_at(_load(d), _path(p), _load(v), bool(c))) for d, p, v, c in zip(doc, path, value, create)])

    @F.pandas_udf("boolean")
    def pg_jsonb_contains(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else contains(_load(x), _load(y)) for x, y in zip(a, b)], dtype="object")

    @F.pandas_udf("string")
    def pg_jsonb_minus(doc: pd.Series, key: pd.Series, index: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or k is None else _dump(minus(_load(d), k, bool(i))) for d, k, i in zip(doc, key, index)])

    @F.pandas_udf("string")
    def pg_jsonb_minus_keys(doc: pd.Series, keys: pd.Series) -> pd.Series:
        def less(d, ks):
            for k in ks:
                d = d if k is None else minus(d, k, False)
            return d

        return pd.Series([None if d is None or k is None else _dump(less(_load(d), k)) for d, k in zip(doc, keys)])

    @F.pandas_udf("string")
    def pg_json_typeof(doc: pd.Series) -> pd.Series:
        kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
        return pd.Series([None if d is None else kinds[type(_load(d))] for d in doc])

    for f in (pg_jsonb_set, pg_jsonb_contains, pg_jsonb_minus, pg_jsonb_minus_keys, pg_json_typeof):
        spark.udf.register(f.__name__ if hasattr(f, "__name__") else f.func.__name__, f)
