"""Versioned Parquet tables with branches.

A catalog is a JSON document per version (``catalog-<n>``); a commit creates
the next one, which fails if another writer did so first.  A table on a branch
is a list of Parquet folders.  On the main branch they hold all rows, and lists
of (file, row number) beside them tell which rows are gone: a change writes its
new rows and such a list, and what it doesn't touch stays where it is.  On another
branch the folders hold changed rows, with the keys of removed ones beside them,
and reading lays them over the parent's rows.  Tables without a primary key are
copied when a branch first writes to them.  Folders are never changed, so
readers keep their snapshot.
"""

from __future__ import annotations

import copy
import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexer import SqlError, name
from .shared import Files

MAIN = "main"
ABANDONED = 60
#: Where a stored row is.
PLACE = "struct<file:string,at:bigint>"
EMPTY = {"tables": {}, "data": {MAIN: {}}, "branches": {MAIN: {"parent": None, "base": {}}}, "views": {}, "sequences": {}, "types": {}}


class Store:
    """A database under ``root``; ``state`` is the snapshot this session works on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        self.refresh()

    def refresh(self) -> None:
        """The latest state.  A catalog that was never finished counts as nothing after ``ABANDONED`` seconds."""
        self.version = self.files.latest("catalog")
        for n in range(self.version, -1, -1):
            text = self.files.read(f"catalog-{n}")
            try:
                self.state = json.loads(text)
                return
            except (TypeError, ValueError):
                if self.files.age(f"catalog-{n}") < ABANDONED:
                    raise SqlError("40001", "another session is changing the database") from None
        self.state = copy.deepcopy(EMPTY)

    def commit(self) -> None:
        """Publish the state; SQLSTATE 40001 if the catalog changed since it was read."""
        if self.files.latest("catalog") != self.version or not self.files.create(f"catalog-{self.version + 1}", json.dumps(self.state)):
            self.refresh()
            raise SqlError("40001", "the database was changed by another session")
        self.version += 1

    # Tables

    def table(self, table: str) -> dict:
        if table not in self.state["tables"]:
            raise SqlError("42P01", f"relation {table!r} doesn't exist")
        return self.state["tables"][table]

    def schema(self, table: str) -> T.StructType:
        return T.StructType([T.StructField(c["name"], T._parse_datatype_string(c["type"]), True) for c in self.table(table)["columns"]])

    def key(self, table: str) -> list[str]:
        return self.table(table)["pk"]

    def write(self, df: DataFrame, kind: str = "rows") -> str:
        path = f"{self.root}/data/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def load(self, paths: list[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _full(self, layer: dict, schema: T.StructType, ids: bool = False) -> DataFrame:
        """The rows of a layer that holds all of them; with ``__id``, their places, if asked for."""
        if not layer["files"]:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumn("__id", F.lit(None).cast(PLACE)) if ids else rows
        rows = self.load(layer["files"], schema)
        if not ids and not layer["gone"]:
            return rows
        placed = rows.select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")).alias("__id"))
        if layer["gone"]:
            gone = self.load(layer["gone"], T.StructType([T.StructField("__id", T._parse_datatype_string(PLACE))]))
            placed = placed.join(gone, "__id", "left_anti")
        return placed.select(*map(name, schema.names), "__id") if ids else placed.select(*map(name, schema.names))

    def chain(self, branch: str) -> list[str]:
        """The branch, its parent, and so on to main."""
        out = []
        while branch is not None:
            if branch not in self.state["branches"]:
                raise SqlError("3D000", f"branch {branch!r} doesn't exist")
            out.append(branch)
            branch = self.state["branches"][branch]["parent"]
        return out

    def read(self, table: str, branch: str = MAIN, ids: bool = False) -> DataFrame:
        """The table's rows; with ``ids`` also ``__id``, which `change` knows them by."""
        whole = self._own(table, branch).get("full") if ids else False
        layers = []
        for b in self.chain(branch):
            own = self.state["data"].get(b, {}).get(table)
            if own is not None:
                layers.append(own)
                if own.get("full"):
                    break
        rows = self._laid(layers, table, ids and whole)
        return rows.withColumn("__id", F.struct(*map(name, self.key(table)))) if ids and not whole else rows

    def _laid(self, layers: list[dict], table: str, ids: bool = False) -> DataFrame:
        """Layers from the last to the first that holds all rows, laid over each other."""
        schema, key = self.schema(table), self.key(table)
        rows = self._full(layers[-1] if layers else {"files": [], "gone": []}, schema, ids)
        for layer in reversed(layers[:-1]):
            rows = overlay(rows, self.load(layer["files"], schema), self.load(layer["gone"], _only(schema, key)), key)
        return rows

    def append(self, table: str, branch: str, path: str) -> None:
        """Add a folder of rows, none of which has the key of another."""
        own, key = self._own(table, branch), self.key(table)
        if not own.get("full") and own["gone"]:  # a key that was removed may come back
            back = self.load([path], _only(self.schema(table), key))
            own["gone"] = [self.write(self.load(own["gone"], _only(self.schema(table), key)).join(back, key, "left_anti"), "gone")]
        own["files"].append(path)

    def change(self, table: str, branch: str, ids: DataFrame, path: str | None = None, same_keys: bool = False) -> None:
        """Take the rows with some ids (``__id``, of `read`) out, and add those of a folder.

        On the main branch, that writes the ids only; on another one, the changes
        that it has, and, unless the new rows have the ``same_keys``, the keys.
        """
        own, key, schema = self._own(table, branch), self.key(table), self.schema(table)
        if own.get("full"):
            own["gone"].append(self.write(ids.select("__id"), "gone"))
            own["files"] += [path] if path else []
            return
        hit = ids.select("__id.*")
        if own["files"]:
            rest = self.load(own["files"], schema).join(hit, key, "left_anti").select(*map(name, schema.names))
            own["files"] = [self.write(rest.unionByName(self.load([path], schema)) if path else rest, "delta")]
        else:
            own["files"] = [path] if path else []
        if same_keys:  # what is seen isn't gone, and stays so
            return
        gone = self.load(own["gone"], _only(schema, key)).unionByName(hit.select(*map(name, key))) if own["gone"] else hit.select(*map(name, key))
        if path:
            gone = gone.join(self.load([path], _only(schema, key)), key, "left_anti")
        own["gone"] = [self.write(gone.distinct(), "gone")]

    def replace(self, table: str, branch: str, rows: DataFrame) -> None:
        """All rows of the table on the branch become ``rows``."""
        own = self._own(table, branch)
        if own.get("full"):
            own["files"], own["gone"] = [self.write(rows)], []
            return
        key = self.key(table)
        parent = self.read(table, self.state["branches"][branch]["parent"])
        path = self.write(rows)  # what follows reads it twice
        now = self.load([path], self.schema(table))
        own["files"], own["gone"] = [self.write(now.exceptAll(parent), "delta")], [self.write(parent.select(key).exceptAll(now.select(key)), "gone")]

    def _own(self, table: str, branch: str) -> dict:
        data = self.state["data"].setdefault(branch, {})
        if table not in data:
            if branch == MAIN:
                data[table] = {"files": [], "gone": [], "full": True}
            elif self.key(table):
                data[table] = {"files": [], "gone": [], "full": False}
            else:
                data[table] = {"files": [self.write(self.read(table, self.state["branches"][branch]["parent"]))], "gone": [], "full": True}
        return data[table]

    def drop(self, table: str) -> None:
        self.table(table)
        del self.state["tables"][table]
        for data in self.state["data"].values():
            data.pop(table, None)

    # Branches

    def create_branch(self, branch: str, parent: str) -> None:
        if branch in self.state["branches"]:
            raise SqlError("42710", f"branch {branch!r} exists")
        self.chain(parent)
        seen = {t: [copy.deepcopy(self.state["data"].get(b, {}).get(t)) for b in self.chain(parent)] for t in self.state["tables"]}
        self.state["branches"][branch] = {"parent": parent, "base": seen}
        self.state["data"][branch] = {}

    def drop_branch(self, branch: str) -> None:
        if branch == MAIN:
            raise SqlError("0A000", "the main branch can't be dropped")
        self.chain(branch)
        if any(b["parent"] == branch for b in self.state["branches"].values()):
            raise SqlError("2BP01", f"other branches start from {branch!r}")
        del self.state["branches"][branch]
        self.state["data"].pop(branch, None)

    def merge_branch(self, branch: str, target: str) -> dict[str, int]:
        """Bring the branch's changes into its parent: rows changed by table.

        A key that both changed since the branch began, to different ends, is a
        conflict (40001) and nothing is merged.
        """
        info = self.state["branches"].get(branch)
        if info is None:
            raise SqlError("3D000", f"branch {branch!r} doesn't exist")
        if info["parent"] != target:
            raise SqlError("0A000", f"{branch!r} can only be merged into its parent {info['parent']!r}")
        merged, counts = {}, {}
        for table, own in self.state["data"].get(branch, {}).items():
            schema, key = self.schema(table), self.key(table)
            if not key:
                theirs = self.read(table, branch)
                counts[table] = theirs.count()
                merged[table] = lambda table=table, theirs=theirs: self.replace(table, target, theirs)
                continue
            delta, gone = self.load(own["files"], schema), self.load(own["gone"], _only(schema, key))
            changed = delta.select(*map(name, key)).unionByName(gone).distinct()
            base = info["base"].get(table)
            if base != [self.state["data"].get(b, {}).get(table) for b in self.chain(target)]:  # the parent has changed too
                theirs, ours, then = self.read(table, branch), self.read(table, target), self._at_base(table, base)
                moved = ours.exceptAll(then).select(key).unionByName(then.exceptAll(ours).select(key)).distinct()
                both = changed.join(moved, key)
                end = lambda rows: rows.join(both, key, "left_semi")  # noqa: B023, E731
                if not both.isEmpty() and not (end(theirs).exceptAll(end(ours)).isEmpty() and end(ours).exceptAll(end(theirs)).isEmpty()):
                    raise SqlError("40001", f"{table!r} has rows that both branches changed")
            counts[table] = changed.count()

            def bring(table: str = table, own: dict = own, changed: DataFrame = changed, key: list[str] = key, schema: T.StructType = schema) -> None:
                ids = self.read(table, target, ids=True).join(changed, key, "left_semi").select("__id")
                if self._own(table, target).get("full"):
                    self.change(table, target, ids)
                    self._own(table, target)["files"] += own["files"]
                else:
                    ids = changed.select(F.struct(*map(name, key)).alias("__id"))
                    self.change(table, target, ids, self.write(self.load(own["files"], schema), "delta"))

            merged[table] = bring
        for bring in merged.values():
            bring()
        self.state["data"][branch] = {}
        info["base"] = {t: [copy.deepcopy(self.state["data"].get(b, {}).get(t)) for b in self.chain(target)] for t in self.state["tables"]}
        return counts

    def _at_base(self, table: str, layers: list | None) -> DataFrame:
        return self._laid([x for x in layers or [] if x is not None], table)

    # Backup

    def backup(self, to: str) -> None:
        """Copy the whole database to another folder."""
        self.files.copy("", to)

    def restore(self, source: str) -> None:
        """Bring a backup's tables, views, branches and the rest back, as the next version of this database."""
        there = Files(self.spark, source.rstrip("/"))
        version = there.latest("catalog")
        if version < 0:
            raise SqlError("58P01", f"there is no backup in {source!r}")
        have = set(self.files.names("data"))
        for own in there.names("data"):
            if own not in have:
                there.copy(f"data/{own}", f"{self.root}/data/{own}")
        moved = re.sub(r'"[^"]*/data/(\w+-[0-9a-f]{32})"', lambda m: json.dumps(f"{self.root}/data/{m[1]}"), there.read(f"catalog-{version}"))
        self.refresh()
        self.state = json.loads(moved)
        self.commit()


def overlay(parent: DataFrame, delta: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Parent rows whose key is neither changed nor gone, and the changed rows."""
    hidden = delta.select(key).unionByName(gone.select(key))
    return parent.join(hidden, key, "left_anti").select(parent.columns).unionByName(delta)


def _only(schema: T.StructType, key: list[str]) -> T.StructType:
    return T.StructType([schema[k] for k in key])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def null_safe(a: DataFrame, b: DataFrame, columns: list[str]):
    return reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
