"""A database: statements in PostgreSQL's dialect over Spark."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexer import SqlError, name, quote
from ..operators.recursive import fixpoint
from ..session import prepare
from ..sources import copying, pgcatalog
from ..sources.shared import folder, stored
from ..sources.store import MAIN, Store
from ..streaming.spans import SpanTable
from .parser import Parser, Recursive
from .statements import StatementParser

#: SQLSTATEs of what Spark finds wrong in a statement, where its own differ.
ANALYSIS = {"NUM_COLUMNS_MISMATCH": "42601", "UNRESOLVED_COLUMN.WITH_SUGGESTION": "42703", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION": "42703", "TABLE_OR_VIEW_NOT_FOUND": "42P01", "UNRESOLVED_ROUTINE": "42883"}

__all__ = ["Database", "Result", "Session"]


@dataclass
class Result:
    """What a statement did: a tag, its rows if it has any, and how many it touched."""

    tag: str
    rows: DataFrame | None = None
    count: int | None = None


class Database:
    """Tables under a folder (by default a fresh one in the shared folder)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = prepare(spark)
        self.root = root or f"{folder(spark)}/database-{uuid.uuid4().hex}"
        self.listeners: dict[str, list[Callable[[str, str], None]]] = {}
        #: What SQL reads as the table ``spans``.
        self.spans = SpanTable(self.spark, f"{self.root.rstrip('/')}/spans")

    def session(self, user: str = "admin", branch: str = MAIN) -> Session:
        return Session(self, user, branch)


class Session:
    """One connection: its branch, user, settings, transaction, cursors and prepared statements."""

    def __init__(self, database: Database, user: str = "admin", branch: str = MAIN):
        self.database, self.spark, self.user, self.branch = database, database.spark, user, branch
        self.settings: dict[str, str] = {"timezone": "UTC", "search_path": "public", "server_version": "16.0", "client_encoding": "UTF8", "standard_conforming_strings": "on", "datestyle": "ISO, MDY", "transaction_isolation": "repeatable read"}
        self.store = Store(self.spark, database.root)
        self.views: dict[str, DataFrame] = {}
        self.made_views: list[str] = []
        self.open = self.failed = False
        self.deferred: set[str] = set()
        self.pending: list[tuple[str, dict]] = []
        self.cursors: dict[str, Iterator] = {}
        self.cursor_plans: dict[str, DataFrame] = {}
        self.prepared: dict[str, str] = {}
        self.currval: dict[str, int] = {}
        self.local: dict[str, str | None] = {}

    # Entry points

    def register(self, table: str, rows: DataFrame) -> None:
        """Make a DataFrame readable under a name in this session."""
        self.views[table] = rows

    def sql(self, text: str, *params: Any) -> DataFrame:
        """The rows of a query (or of a statement that returns rows)."""
        out = self.execute(text, *params)
        if out.rows is None:
            raise SqlError("02000", f"{out.tag} returns no rows")
        return out.rows

    def fetch(self, text: str, *params: Any) -> list:
        """The collected rows; what fails while they are made is an SqlError with its SQLSTATE, too."""
        try:
            return self.sql(text, *params).collect()
        except Py4JJavaError as e:
            raise SqlError("22023" if "MALFORMED_RECORD" in str(e) else "XX000", str(e).split("\n")[1]) from e
        except PySparkException as e:
            own = re.search(r"\b([0-9A-Z]{5}): ", str(e)) if "raise_error" in str(e) or "USER_RAISED" in str(e) else None
            state = own[1] if own else "22023" if "JSONDecodeError" in str(e) else e.getSqlState() or "XX000"
            raise SqlError(state, str(e).split("\n")[0]) from e

    def execute(self, text: str, *params: Any) -> Result:
        """Run one statement.  Outside a transaction it commits by itself."""
        if self.failed and not re.match(r"\s*(rollback|abort|commit|end)\b", text, re.I):
            raise SqlError("25P02", "the transaction is aborted")
        if not self.open:
            self.store.refresh()
        before = self.store.version
        try:
            try:
                out = self._run(text, list(params))
            except AnalysisException as e:
                raise SqlError(ANALYSIS.get(e.getCondition() or "", e.getSqlState() or "42601"), str(e).split("\n")[0]) from e
        except Exception:
            if self.open:
                self.failed = True
            else:
                self.store.refresh()
            raise
        finally:
            self._drop_views()
        changed = out.tag.split(" ")[0] not in ("SELECT", "EXPLAIN", "SHOW", "SET", "FETCH", "COPY", "DECLARE", "CLOSE", "BEGIN", "COMMIT", "ROLLBACK", "LISTEN", "NOTIFY", "PREPARE")
        if changed and not self.open and self.store.version == before:
            self._check_pending()
            self.store.commit()
        return out

    def prepare(self, text: str) -> Callable[..., Result]:
        """A statement with $1, $2, … to be called with their values."""
        return lambda *params: self.execute(text, *params)

    def copy_to(self, text: str) -> Iterator[str] | Iterator[bytes]:
        """The lines of a COPY … TO STDOUT, or the chunks of a binary one."""
        if not self.open:
            self.store.refresh()
        st = self._parse(text, [])
        rows = self._frame(st.query, st.recursive) if st.query else self._frame(f"SELECT {', '.join(map(name, st.columns)) if st.columns else '*'} FROM {self._resolve(st.table)}", [])
        if st.format == "binary":
            return copying.export_binary(rows)
        return copying.export(rows, st.format, st.delimiter, st.header)

    def copy_from(self, text: str, payload: str | bytes) -> Result:
        """A COPY … FROM STDIN of a payload, checked like an INSERT and all or nothing."""
        if not self.open:
            self.store.refresh()
        st = self._parse(text, [])
        columns = st.columns or [c["name"] for c in self.store.table(st.table)["columns"]]
        if st.format == "binary":
            types = [self.store.schema(st.table)[c] for c in columns]
            rows = copying.parse_binary(payload, types)
        else:
            types = None
            rows = copying.parse(payload, st.format, st.delimiter, st.header)
        if any(len(r) != len(columns) for r in rows):
            raise SqlError("22P04", "a line has another number of columns")
        frame = self.spark.createDataFrame([tuple(r) for r in rows], T.StructType(types) if types else ", ".join(f"{name(c)} string" for c in columns))
        out = self._insert(st.table, columns, frame)
        if not self.open:
            self._check_pending()
            self.store.commit()
        return Result("COPY", None, out.count)

    # Reading

    def _parse(self, text: str, params: list):
        return StatementParser(text, resolve=self._resolve, params=params, setting=self._setting, call=self._call, types=self._types).statement()

    def _parser(self, text: str) -> Parser:
        return Parser(text, resolve=self._resolve, params=[], setting=self._setting, call=self._call, types=self._types)

    def _expression(self, text: str) -> str:
        p = self._parser(text)
        out = p.expression()
        p.done()
        return out

    def _types(self, table: str) -> dict[str, str]:
        """What a table's columns are; JSON ones by that name."""
        table = table.lower()
        if table not in self.views and table in self.store.state["tables"]:
            return {c["name"]: "json" if c.get("pg_type") in ("json", "jsonb") else c["type"].lower() for c in self.store.state["tables"][table]["columns"]}
        return {f.name: f.dataType.simpleString() for f in self._rows_of(table).schema}

    def _setting(self, key: str) -> str | None:
        return self.settings.get(key.lower())

    def _call(self, f: str, args: list[str]) -> str | None:
        if f == "nextval":
            return str(self._next(args[0].strip("'")))
        if f == "currval":
            own = args[0].strip("'")
            if own not in self.currval:
                raise SqlError("55000", f"currval of {own!r} isn't defined in this session")
            return str(self.currval[own])
        if f == "lastval":
            return str(next(reversed(self.currval.values()), 1))
        if f == "setval":
            own = args[0].strip("'")
            held = self.store.state["sequences"].setdefault(own, {"next": 1, "step": 1})
            held["next"] = int(args[1]) + held["step"]
            self.currval[own] = int(args[1])
            self._save_if_alone()
            return args[1]
        if f in ("current_database", "current_catalog"):
            return "'marlstone'"
        if f == "current_schema":
            return "'public'"
        if f in ("current_user", "session_user", "user", "current_role"):
            return quote(self.user)
        if f == "set_config":
            key, value = args[0].strip("'").lower(), re.sub(r"\\(.)", r"\1", args[1][1:-1])
            if len(args) > 2 and args[2].lower() == "true" and self.open:  # until the transaction ends
                self.local.setdefault(key, self.settings.get(key))
            self.settings[key] = value
            return quote(value)
        return None

    def _end_local(self) -> None:
        """Settings of the transaction go back to what they were."""
        for key, value in self.local.items():
            if value is None:
                self.settings.pop(key, None)
            else:
                self.settings[key] = value
        self.local = {}

    def _next(self, sequence: str, n: int = 1) -> int:
        s = self.store.state["sequences"].get(sequence)
        if s is None:
            raise SqlError("42P01", f"sequence {sequence!r} doesn't exist")
        got = s["next"]
        s["next"] += n * s["step"]
        self.currval[sequence] = got
        self._save_if_alone()
        return got

    def _save_if_alone(self) -> None:
        if not self.open:
            self._dirty = True

    def _resolve(self, table: str) -> str:
        """A temporary view for what a name stands for."""
        return self._view(self._rows_of(table))

    def _view(self, rows: DataFrame) -> str:
        own = "v_" + uuid.uuid4().hex
        rows.createOrReplaceTempView(own)
        self.made_views.append(own)
        return name(own)

    def _drop_views(self) -> None:
        """A statement's rows are analysed by now and don't need its views any more."""
        while self.made_views:
            self.spark.catalog.dropTempView(self.made_views.pop())

    def _rows_of(self, table: str) -> DataFrame:
        table = table.lower()
        if table in self.views:
            return self.views[table]
        state = self.store.state
        if table in state["tables"]:
            return self._visible(table, self.store.read(table, self.branch), "SELECT")
        if table in state["views"]:
            v = state["views"][table]
            if v["path"]:
                return self.spark.read.parquet(v["path"])
            rows = self._query(v["text"])
            return rows.toDF(*v["columns"]) if v["columns"] else rows
        if table == "spans":
            return self.database.spans.read()
        found = pgcatalog.view(self.spark, self.store, table, self.settings, self.user)
        if found is not None:
            return found
        raise SqlError("42P01", f"relation {table!r} doesn't exist")

    def _query(self, text: str) -> DataFrame:
        p = self._parser(text)
        sql = p.query()
        p.done()
        return self._frame(sql, p.recursive)

    def _frame(self, sql: str, recursive: list[Recursive]) -> DataFrame:
        for r in recursive:
            base = self.spark.sql(r.base)
            base = base.toDF(*r.columns) if r.columns else base

            def step(work: DataFrame, r: Recursive = r) -> DataFrame:
                work.createOrReplaceTempView(r.name)
                return self.spark.sql(r.step)

            fixpoint(base, step).createOrReplaceTempView(r.name)
        return self.spark.sql(sql)

    # Row-level security

    def _policies(self, table: str, command: str) -> list[dict]:
        own = self.store.table(table)["policies"]
        return [p for p in own if p["command"] in ("ALL", command) and (not p["roles"] or "public" in p["roles"] or self.user in p["roles"])]

    def _guard(self, table: str, command: str, check: bool = False) -> str | None:
        """The combined predicate for a command; None where the table has no row-level security."""
        if not self.store.table(table)["rls"]:
            return None
        text = lambda p: (p.get("check") or p.get("using")) if check else p.get("using")
        found = self._policies(table, command)
        allow = [self._expression(text(p)) if text(p) else "true" for p in found if p["permissive"]]
        restrict = [self._expression(text(p)) if text(p) else "true" for p in found if not p["permissive"]]
        if not allow:
            return "false"
        return " AND ".join(["(" + " OR ".join(f"coalesce({x}, false)" for x in allow) + ")", *(f"coalesce({x}, false)" for x in restrict)])

    def _visible(self, table: str, rows: DataFrame, command: str) -> DataFrame:
        guard = self._guard(table, command)
        return rows if guard is None else rows.filter(guard)

    # Statements

    def _run(self, text: str, params: list) -> Result:
        st = self._parse(text, params)
        method = getattr(self, f"_do_{st.kind}")
        return method(st)

    def _do_query(self, st) -> Result:
        out = Result("SELECT", self._frame(st.sql, st.recursive))
        if getattr(self, "_dirty", False):  # it took sequence values
            self._dirty = False
            self.store.commit()
        return out

    def _do_explain(self, st) -> Result:
        plan = self._frame(st.sql, st.recursive)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return Result("EXPLAIN", self.spark.createDataFrame([(line,) for line in plan.split("\n")], "`QUERY PLAN` string"))

    def _do_ignored(self, st) -> Result:
        return Result("SET " + st.tag)

    def _do_insert(self, st) -> Result:
        meta = self.store.table(st.table)
        columns = st.columns if st.columns is not None else [c["name"] for c in meta["columns"]]
        if st.query is not None:
            rows = self._frame(st.query, st.recursive)
            columns = columns[: len(rows.columns)] if st.columns is None else columns
            if len(columns) != len(rows.columns):
                raise SqlError("42601", "INSERT has another number of expressions than of columns")
            rows = rows.toDF(*columns)
        else:
            width = max(map(len, st.rows))
            if any(len(r) != width for r in st.rows) or width > len(columns):
                raise SqlError("42601", "INSERT has another number of expressions than of columns")
            columns = columns[:width]
            parts = [", ".join(f"{x if x is not None else self._default(st.table, c) or 'NULL'} AS {name(c)}" for c, x in zip(columns, r)) or "1 AS `__none`" for r in st.rows]
            rows = self.spark.sql(" UNION ALL ".join(f"SELECT {p}" for p in parts))
            rows = rows.drop("__none")
        return self._insert(st.table, columns, rows, st.conflict, st.returning)

    def _column(self, table: str, column: str) -> dict:
        for c in self.store.table(table)["columns"]:
            if c["name"] == column:
                return c
        raise SqlError("42703", f"column {column!r} of {table!r} doesn't exist")

    def _default(self, table: str, column: str) -> str | None:
        c = self._column(table, column)
        if c["identity"]:
            return str(self._next(f"{table}_{column}_seq"))
        return self._expression(c["default"]) if c["default"] else None

    def _complete(self, table: str, columns: list[str], rows: DataFrame) -> DataFrame:
        """rows with all columns of the table: defaults, identities, generated columns, types; and ``__row``, which rises in their order."""
        for c in columns:
            self._column(table, c)
        generated = [c for c in self.store.table(table)["columns"] if c["identity"] and c["name"] not in columns]
        if generated:
            rows = self._numbered(rows)
        select = []
        for c in self.store.table(table)["columns"]:
            own = c["name"]
            if c["generated"]:
                continue
            if own in columns:
                x = name(own)
            elif c["identity"]:
                s = self.store.state["sequences"][f"{table}_{own}_seq"]
                x = f"{s['next']} + {s['step']} * `__number`"
            else:
                x = self._expression(c["default"]) if c["default"] else "NULL"
            select.append(F.expr(f"CAST({x} AS {c['type']}) AS {name(own)}"))
        row = F.col("__number") if generated else F.monotonically_increasing_id()
        out = self._regenerate(table, rows.select(*select, row.cast("bigint").alias("__row")))
        return out.select(*(name(c["name"]) for c in self.store.table(table)["columns"]), "__row")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """rows with `__number`, 0, 1, 2, …: by partition, from the partitions' counts."""
        held = stored(rows.withColumn("__m", F.monotonically_increasing_id()), "numbered")
        part = F.shiftright("__m", 33)
        counts = sorted((r[0], r[1]) for r in held.groupBy(part.alias("part")).count().collect())  # one row a partition
        offsets, total = [], 0
        for p, n in counts:
            offsets.append((p, total))
            total += n
        known = self.spark.createDataFrame(offsets, "`__part` bigint, `__offset` bigint")
        return held.join(F.broadcast(known), part == F.col("__part")).withColumn("__number", F.col("__offset") + F.col("__m").bitwiseAND((1 << 33) - 1))

    def _insert(self, table: str, columns: list[str], rows: DataFrame, conflict: dict | None = None, returning: list | None = None) -> Result:
        meta = self.store.table(table)
        path = self.store.write(self._complete(table, columns, rows))  # readers of the table don't see __row
        new = self.store.load([path], T.StructType([*self.store.schema(table), T.StructField("__row", T.LongType())]))
        for c in meta["columns"]:
            if c["identity"]:
                s, top = self.store.state["sequences"][f"{table}_{c['name']}_seq"], new.agg(F.max(c["name"])).first()[0]
                if top is not None and top >= s["next"]:
                    s["next"] = top + s["step"]
        count = self._check_rows(table, new, "INSERT")
        if conflict is not None:
            return self._upsert(table, new, conflict, returning)
        self._check_unique(table, new, self.store.read(table, self.branch))
        self.store.append(table, self.branch, path)
        self._check_references(table, new)
        return Result(f"INSERT 0 {count}", self._returning(table, new, "__row", returning), count)

    def _upsert(self, table: str, new: DataFrame, conflict: dict, returning: list | None) -> Result:
        meta = self.store.table(table)
        target = conflict["target"] or meta["pk"] or (meta["unique"] or [[]])[0]
        if not target or (sorted(target) not in [sorted(k) for k in [meta["pk"], *meta["unique"], *(i["columns"] for i in meta["indexes"] if i["unique"])] if k]):
            raise SqlError("42P10", "there is no unique constraint for ON CONFLICT")
        names = [c["name"] for c in meta["columns"]]
        current = self.store.read(table, self.branch, ids=True)
        numbered = new.withColumn("__n", F.row_number().over(Window.partitionBy(*map(name, target)).orderBy("__row")))
        once = numbered.filter("__n = 1").drop("__n")
        fresh = once.join(current, target, "left_anti").select(*map(name, names), "__row")
        if conflict["set"] is None:
            fresh = stored(fresh, "upsert")
            self._check_unique(table, fresh, current, skip=target)
            self.store.append(table, self.branch, self.store.write(fresh.drop("__row")))
            self._check_references(table, fresh)
            n = fresh.count()
            return Result(f"INSERT 0 {n}", self._returning(table, fresh, "__row", returning), n)
        if not numbered.filter("__n > 1").isEmpty():
            raise SqlError("21000", "ON CONFLICT DO UPDATE can't touch a row twice")
        both = current.alias(table).join(once.alias("excluded"), [F.col(f"{name(table)}.{name(c)}") == F.col(f"excluded.{name(c)}") for c in target])
        if conflict["where"]:
            both = both.filter(conflict["where"])
        sets = dict(conflict["set"])
        qualified = {c: re.sub(r"(?<![\w`.])`(" + "|".join(map(re.escape, names)) + r")`(?!\.)", lambda m: f"{name(table)}.{m[0]}", x or self._default(table, c) or "NULL") for c, x in sets.items()}
        updated = both.select("__id", "__row", *(F.expr(f"CAST({qualified[c['name']]} AS {c['type']})").alias(c["name"]) if c["name"] in sets else F.col(f"{name(table)}.{name(c['name'])}").alias(c["name"]) for c in meta["columns"]))
        updated = stored(self._regenerate(table, updated), "upsert")
        touched = stored(updated.select(*map(name, names), "__row").unionByName(fresh), "upsert")
        n = self._check_rows(table, touched, "UPDATE")
        self._check_unique(table, touched, current.join(updated, "__id", "left_anti"))
        self.store.change(table, self.branch, updated, self.store.write(touched.drop("__row")))
        self._check_references(table, touched)
        return Result(f"INSERT 0 {n}", self._returning(table, touched, "__row", returning), n)

    def _regenerate(self, table: str, rows: DataFrame) -> DataFrame:
        for c in self.store.table(table)["columns"]:
            if c["generated"]:
                rows = rows.withColumn(c["name"], F.expr(f"CAST({self._expression(c['generated'])} AS {c['type']})"))
        return rows

    def _returning(self, alias: str, rows: DataFrame, order: str, items: list | None) -> DataFrame | None:
        """The RETURNING list over rows, which come in the order of a column of theirs that isn't shown."""
        if items is None:
            return None
        shown = ", ".join(x + (f" AS {name(a)}" if a else "") for x, a in items)
        return self.spark.sql(f"SELECT {shown} FROM {self._view(rows.orderBy(order).drop(order))} AS {name(alias)}")

    def _touched(self, table: str, alias: str, extra: list[str], source: str | None, where: str | None, command: str) -> DataFrame:
        """``__id``, the old columns (``__old_…``) and extra expressions of the rows that a statement touches.

        Of several source rows that match, one counts (the least).
        """
        seen = self._visible(table, self._visible(table, self.store.read(table, self.branch, ids=True), "SELECT"), command)
        old = [f"{name(alias)}.{name(c['name'])} AS {name('__old_' + c['name'])}" for c in self.store.table(table)["columns"]]
        sql = f"SELECT {', '.join([f'{name(alias)}.`__id` AS `__id`', *old, *extra])} FROM {self._view(seen)} AS {name(alias)}" + (f" CROSS JOIN {source}" if source else "") + (f" WHERE {where}" if where else "")
        hit = self.spark.sql(sql)
        if source:
            values = [c for c in hit.columns if c != "__id"]
            hit = hit.groupBy("__id").agg(F.min(F.struct(*map(name, values))).alias("__v")).select("__id", *(F.col("__v").getField(c).alias(c) for c in values))
        return stored(hit, "touched")

    def _old(self, table: str, hit: DataFrame) -> DataFrame:
        return hit.select("__id", *(F.col(name("__old_" + c["name"])).alias(c["name"]) for c in self.store.table(table)["columns"]))

    def _do_update(self, st) -> Result:
        meta = self.store.table(st.table)
        for c, _ in st.set:
            if self._column(st.table, c)["generated"]:
                raise SqlError("428C9", f"column {c!r} is generated")
        sets = {c: f"CAST({x if x is not None else self._default(st.table, c) or 'NULL'} AS {self._column(st.table, c)['type']}) AS {name('__new_' + c)}" for c, x in st.set}
        hit = self._touched(st.table, st.alias, list(sets.values()), getattr(st, "from", None) if "from" in st.parts and st.parts["from"] else None, st.where, "UPDATE")
        names = [c["name"] for c in meta["columns"]]
        new = hit.select("__id", *(F.col(name(("__new_" if c in sets else "__old_") + c)).alias(c) for c in names))
        path = self.store.write(self._regenerate(st.table, new), "rows")  # readers of the table don't see __id
        new = self.spark.read.parquet(path)
        count = self._check_rows(st.table, new, "UPDATE")
        changed = set(sets) | {c["name"] for c in meta["columns"] if c["generated"]}
        if count:
            self._check_unique(st.table, new, self.store.read(st.table, self.branch, ids=True).join(hit, "__id", "left_anti"), changed=changed)
            self.store.change(st.table, self.branch, hit, path, same_keys=not changed & set(meta["pk"]))
            if any(changed & set(fk["columns"]) for fk in meta["fks"]):
                self._check_references(st.table, new)
            moved = self._old(st.table, hit).join(new.select("__id", *(F.col(name(c)).alias("__to_" + c) for c in names)), "__id")
            self._parent_changed(st.table, self._old(st.table, hit), "update", new=moved)
        return Result(f"UPDATE {count}", self._returning(st.alias, new, "__id", st.returning), count)

    def _do_delete(self, st) -> Result:
        hit = self._touched(st.table, st.alias, [], st.parts["from"], st.where, "DELETE")
        old, count = self._old(st.table, hit), hit.count()
        if count:
            self.store.change(st.table, self.branch, hit)
            self._parent_changed(st.table, old, "delete")
        return Result(f"DELETE {count}", self._returning(st.alias, old, "__id", st.returning), count)

    def _do_truncate(self, st) -> Result:
        for t in st.tables:
            self.store.replace(t, self.branch, self.spark.createDataFrame([], self.store.schema(t)))
        return Result("TRUNCATE TABLE")

    # Constraints

    def _check_rows(self, table: str, rows: DataFrame, command: str) -> int:
        """NOT NULL, CHECK, enum labels and WITH CHECK of new rows, and how many there are, in one pass."""
        meta = self.store.table(table)
        tests = [("23502", f"column {c['name']!r} mustn't be null", f"{name(c['name'])} IS NULL") for c in meta["columns"] if c["not_null"] or c["name"] in meta["pk"]]
        tests += [("23514", f"check {label!r} of {table!r} is violated", f"NOT ({self._expression(x)})") for label, x in meta["checks"]]
        for c in meta["columns"]:
            labels = self.store.state["types"].get(c.get("pg_type", ""), {}).get("labels")
            if labels:
                tests.append(("22P02", f"{c['name']!r} has a value that isn't a label", f"{name(c['name'])} NOT IN ({', '.join(map(quote, labels))})"))
        guard = self._guard(table, command, check=True)
        if guard is not None:
            tests.append(("42501", f"new row violates the policies of {table!r}", f"NOT coalesce({guard}, false)"))
        count, *found = rows.agg(F.count("*"), *(F.max(F.expr(f"CASE WHEN {x} THEN 1 ELSE 0 END")).alias(f"t{i}") for i, (_, _, x) in enumerate(tests))).first()
        for (state, message, _), bad in zip(tests, found):
            if bad:
                raise SqlError(state, message)
        return count

    def _check_unique(self, table: str, new: DataFrame, rest: DataFrame, skip: list[str] | None = None, changed: set[str] | None = None) -> None:
        """PRIMARY KEY, UNIQUE and unique indexes: among the new rows, and against the rest; nulls are distinct.

        Keys of columns only that aren't among the ``changed`` ones are still unique.
        """
        meta = self.store.table(table)
        keys: list[tuple[list[str], str | None]] = [(k, None) for k in [meta["pk"], *meta["unique"]] if k]
        keys += [(i["keys"], i["where"]) for i in meta["indexes"] if i["unique"]]
        for key, where in keys:
            if skip and sorted(key) == sorted(skip):
                continue
            if changed is not None and where is None and not changed & set(key) and set(key) <= {c["name"] for c in meta["columns"]}:
                continue
            texts = [self._expression(k) for k in key]
            columns = [F.expr(x).alias(f"k{i}") for i, x in enumerate(texts)]
            pick = lambda rows: (rows.filter(self._expression(where)) if where else rows).select(columns).dropna()  # noqa: B023, E731
            mine = pick(new)
            k = mine.columns
            if not mine.unionByName(pick(rest).join(mine, k, "left_semi")).groupBy(k).count().filter("count > 1").isEmpty():
                raise SqlError("23505", f"duplicate key ({', '.join(key)}) in {table!r}")

    def _check_references(self, table: str, new: DataFrame) -> None:
        """Foreign keys of new rows; deferred ones wait for the commit."""
        for fk in self.store.table(table)["fks"]:
            if self.open and (fk["name"] in self.deferred or (fk["deferred"] and "!" + fk["name"] not in self.deferred)):
                self.pending.append((table, fk))
            elif self._dangling(fk, new):
                raise SqlError("23503", f"foreign key {fk['name']!r} of {table!r} is violated")

    def _dangling(self, fk: dict, rows: DataFrame) -> bool:
        to = fk["to"] or self.store.key(fk["table"])
        mine = rows.select([F.col(name(c)).alias(f"k{i}") for i, c in enumerate(fk["columns"])]).dropna()
        theirs = self.store.read(fk["table"], self.branch).select([F.col(name(c)).alias(f"k{i}") for i, c in enumerate(to)])
        return not mine.join(theirs, mine.columns, "left_anti").isEmpty()

    def _check_pending(self) -> None:
        for table, fk in self.pending:
            if self._dangling(fk, self.store.read(table, self.branch)):
                self.pending = []
                raise SqlError("23503", f"foreign key {fk['name']!r} of {table!r} is violated")
        self.pending = []

    def _parent_changed(self, table: str, old: DataFrame, event: str, new: DataFrame | None = None, depth: int = 0) -> None:
        """Foreign-key actions after rows of a parent were deleted or updated."""
        if depth > 64:
            raise SqlError("54001", "foreign keys cascade too deep")
        for child, meta in self.store.state["tables"].items():
            for fk in meta["fks"]:
                if fk["table"] != table:
                    continue
                to = fk["to"] or self.store.key(table)
                keys = [f"k{i}" for i in range(len(to))]
                still = self.store.read(table, self.branch).select([F.col(name(c)).alias(k) for c, k in zip(to, keys)])
                gone = old.select([F.col(name(c)).alias(k) for c, k in zip(to, keys)]).dropna().join(still, keys, "left_anti").distinct()
                rows = self.store.read(child, self.branch, ids=True)
                own = [F.col(name(c)).alias(k) for c, k in zip(fk["columns"], keys)]
                hit = stored(rows.select("*", *own).join(gone, keys, "left_semi").drop(*keys), "children")
                if hit.isEmpty():
                    continue
                action = fk[event]
                names = [c["name"] for c in meta["columns"]]
                if action == "CASCADE" and event == "delete":
                    self.store.change(child, self.branch, hit)
                    self._parent_changed(child, hit, "delete", depth=depth + 1)
                elif action == "CASCADE" and new is not None:
                    moves = new.select([F.col(name(c)).alias(k) for c, k in zip(to, keys)] + [F.col(name("__to_" + c)).alias("n" + k) for c, k in zip(to, keys)]).distinct()
                    moved = hit.select("*", *own).join(moves, keys).select([F.col("n" + keys[fk["columns"].index(c)]).alias(c) if c in fk["columns"] else F.col(name(c)) for c in names])
                    self.store.change(child, self.branch, hit, self.store.write(moved))
                elif action in ("SET NULL", "SET DEFAULT"):
                    value = lambda c: (self._default(child, c) or "NULL") if action == "SET DEFAULT" else "NULL"  # noqa: B023, E731
                    changed = hit.select([F.expr(f"CAST({value(c)} AS {self._column(child, c)['type']})").alias(c) if c in fk["columns"] else F.col(name(c)) for c in names])
                    self._check_rows(child, changed, "UPDATE")
                    self.store.change(child, self.branch, hit, self.store.write(changed))
                elif self.open and (fk["name"] in self.deferred or (fk["deferred"] and "!" + fk["name"] not in self.deferred)):
                    self.pending.append((child, fk))
                else:
                    raise SqlError("23503", f"rows of {child!r} still refer to {table!r}")

    # Definitions

    def _do_create_table(self, st) -> Result:
        if st.table in self.store.state["tables"] or st.table in self.store.state["views"]:
            if st.absent:
                return Result("SET exists")
            raise SqlError("42P07", f"relation {st.table!r} exists")
        meta = st.meta
        for c in meta["columns"]:
            composite = self.store.state["types"].get(c["pg_type"], {}).get("fields")
            if composite:
                c["type"] = "STRUCT<" + ", ".join(f"{name(f)}: {t}" for f, t in composite) + ">"
            if c["identity"]:
                self.store.state["sequences"][f"{st.table}_{c['name']}_seq"] = {"next": 1, "step": 1}
        self.store.state["tables"][st.table] = meta
        for fk in meta["fks"]:
            self.store.table(fk["table"])
        return Result("CREATE TABLE")

    def _do_create_table_as(self, st) -> Result:
        if st.table in self.store.state["tables"]:
            if st.absent:
                return Result("SET exists")
            raise SqlError("42P07", f"relation {st.table!r} exists")
        rows = self._frame(st.query, st.recursive)
        columns = [{"name": f.name, "type": f.dataType.simpleString(), "not_null": False, "default": None, "generated": None, "identity": False, "pg_type": ""} for f in rows.schema]
        self.store.state["tables"][st.table] = {"columns": columns, "pk": [], "unique": [], "checks": [], "fks": [], "indexes": [], "rls": False, "force": False, "policies": []}
        path = self.store.write(rows)
        self.store.append(st.table, self.branch, path)
        return Result("CREATE TABLE AS", None, self.spark.read.parquet(path).count())

    def _do_create_view(self, st) -> Result:
        if st.view in self.store.state["tables"] or (st.view in self.store.state["views"] and not st.replace):
            if st.absent:
                return Result("SET exists")
            raise SqlError("42P07", f"relation {st.view!r} exists")
        rows = self._query(st.text)
        path = self.store.write(rows.toDF(*st.columns) if st.columns else rows, "view") if st.materialized else None
        self.store.state["views"][st.view] = {"text": st.text, "columns": st.columns, "path": path}
        return Result("CREATE VIEW")

    def _do_refresh(self, st) -> Result:
        v = self.store.state["views"].get(st.view)
        if v is None or not v["path"]:
            raise SqlError("42P01", f"materialized view {st.view!r} doesn't exist")
        rows = self._query(v["text"])
        v["path"] = self.store.write(rows.toDF(*v["columns"]) if v["columns"] else rows, "view")
        return Result("REFRESH MATERIALIZED VIEW")

    def _do_create_index(self, st) -> Result:
        meta = self.store.table(st.table)
        own = st.index or f"{st.table}_{len(meta['indexes']) + 1}_idx"
        if any(i["name"] == own for i in meta["indexes"]):
            if st.absent:
                return Result("SET exists")
            raise SqlError("42P07", f"index {own!r} exists")
        index = {"name": own, "keys": st.keys, "columns": [k.strip('"').lower() for k in st.keys], "unique": st.unique, "where": st.where}
        if st.unique:
            meta["indexes"].append(index)
            rows = self.store.read(st.table, self.branch)
            try:
                self._check_unique(st.table, rows, rows.limit(0))
            except SqlError:
                meta["indexes"].remove(index)
                raise
        else:
            meta["indexes"].append(index)
        return Result("CREATE INDEX")

    def _do_create_sequence(self, st) -> Result:
        if st.sequence in self.store.state["sequences"] and not st.absent:
            raise SqlError("42P07", f"sequence {st.sequence!r} exists")
        self.store.state["sequences"].setdefault(st.sequence, {"next": st.parts.get("start", 1), "step": st.parts.get("increment", 1)})
        return Result("CREATE SEQUENCE")

    def _do_create_type(self, st) -> Result:
        self.store.state["types"][st.type] = {"labels": st.labels} if "labels" in st.parts else {"fields": st.fields}
        return Result("CREATE TYPE")

    def _do_create_branch(self, st) -> Result:
        self.store.create_branch(st.branch, st.parent or self.branch)
        return Result("CREATE BRANCH")

    def _do_merge_branch(self, st) -> Result:
        counts = self.store.merge_branch(st.branch, st.target or self.store.state["branches"].get(st.branch, {}).get("parent"))
        return Result("MERGE BRANCH", None, sum(counts.values()))

    def _do_create_policy(self, st) -> Result:
        meta = self.store.table(st.table)
        if any(p["name"] == st.policy for p in meta["policies"]):
            raise SqlError("42710", f"policy {st.policy!r} exists")
        meta["policies"].append({"name": st.policy, "permissive": st.permissive, "command": st.command, "roles": st.parts.get("roles", []), "using": st.parts.get("using"), "check": st.parts.get("check")})
        return Result("CREATE POLICY")

    def _do_alter_policy(self, st) -> Result:
        for p in self.store.table(st.table)["policies"]:
            if p["name"] == st.policy:
                p.update(st.changes)
                return Result("ALTER POLICY")
        raise SqlError("42704", f"policy {st.policy!r} doesn't exist")

    def _do_drop(self, st) -> Result:
        state = self.store.state
        for own in st.names:
            try:
                if st.what == "TABLE":
                    self.store.table(own)
                    children = [t for t, m in state["tables"].items() if t != own and t not in st.names and any(f["table"] == own for f in m["fks"])]
                    if children and not st.parts.get("cascade"):
                        raise SqlError("2BP01", f"{children[0]!r} refers to {own!r}")
                    for t in children:
                        state["tables"][t]["fks"] = [f for f in state["tables"][t]["fks"] if f["table"] != own]
                    self.store.drop(own)
                elif st.what == "BRANCH":
                    self.store.drop_branch(own)
                elif st.what == "POLICY":
                    meta = self.store.table(st.table)
                    kept = [p for p in meta["policies"] if p["name"] != own]
                    if len(kept) == len(meta["policies"]):
                        raise SqlError("42704", f"policy {own!r} doesn't exist")
                    meta["policies"] = kept
                elif st.what == "INDEX":
                    owner = next((m for m in state["tables"].values() if any(i["name"] == own for i in m["indexes"])), None)
                    if owner is None:
                        raise SqlError("42704", f"index {own!r} doesn't exist")
                    owner["indexes"] = [i for i in owner["indexes"] if i["name"] != own]
                else:
                    kind = {"VIEW": "views", "SEQUENCE": "sequences", "TYPE": "types"}.get(st.what)
                    if kind is None or own not in state[kind]:
                        raise SqlError("42P01", f"{st.what.lower()} {own!r} doesn't exist")
                    del state[kind][own]
            except SqlError as e:
                if not st.exists or e.state == "2BP01":
                    raise
        return Result(f"DROP {st.what}")

    def _do_alter_table(self, st) -> Result:
        for action in st.actions:
            self._alter(st.table, *action)
        return Result("ALTER TABLE")

    def _alter(self, table: str, what: str, *args) -> None:
        meta, state = self.store.table(table), self.store.state
        branches = [b for b in state["data"] if table in state["data"][b]]

        def rewrite(change: Callable[[DataFrame], DataFrame], apply: Callable[[], None]) -> None:
            """Rewrite the table on every branch, parents first, under its new definition."""
            now = {b: stored(change(self.store.read(table, b)), "altered") for b in sorted(branches, key=lambda b: len(self.store.chain(b)))}
            apply()
            for b, rows in now.items():
                state["data"][b].pop(table)
                self.store.replace(table, b, rows)

        if what == "add":
            (extra,) = args
            for c in extra["columns"]:
                if any(x["name"] == c["name"] for x in meta["columns"]):
                    raise SqlError("42701", f"column {c['name']!r} exists")
                x = self._expression(c["default"]) if c["default"] else self._expression(c["generated"]) if c["generated"] else None
                if c["identity"]:
                    state["sequences"][f"{table}_{c['name']}_seq"] = {"next": 1, "step": 1}
                    x = "1 + monotonically_increasing_id()"
                if x is None:
                    meta["columns"].append(c)  # rows without it read as null
                else:
                    rewrite(lambda rows: rows.withColumn(c["name"], F.expr(f"CAST({x} AS {c['type']})")), lambda: meta["columns"].append(c))  # noqa: B023
            for kind in ("unique", "checks", "fks"):
                meta[kind] += extra[kind]
            meta["pk"] = extra["pk"] or meta["pk"]
            rows = self.store.read(table, self.branch)
            self._check_rows(table, rows, "ALTER")
            self._check_unique(table, rows, rows.limit(0))
            for fk in extra["fks"]:
                if self._dangling(fk, rows):
                    raise SqlError("23503", f"foreign key {fk['name']!r} is violated")
        elif what == "drop_column":
            column, exists = args
            if not any(c["name"] == column for c in meta["columns"]):
                if exists:
                    return
                raise SqlError("42703", f"column {column!r} doesn't exist")

            def drop() -> None:
                meta["columns"] = [c for c in meta["columns"] if c["name"] != column]
                meta["pk"] = [] if column in meta["pk"] else meta["pk"]
                meta["unique"] = [u for u in meta["unique"] if column not in u]
                meta["fks"] = [f for f in meta["fks"] if column not in f["columns"]]

            rewrite(lambda rows: rows.drop(column), drop)
        elif what == "rename_column":
            old, new = args
            self._column(table, old)
            swap = lambda xs: [new if x == old else x for x in xs]

            def rename() -> None:
                self._column(table, old)["name"] = new
                meta["pk"], meta["unique"] = swap(meta["pk"]), [swap(u) for u in meta["unique"]]
                for f in meta["fks"]:
                    f["columns"] = swap(f["columns"])
                meta["checks"] = [[label, re.sub(rf"\b{re.escape(old)}\b", new, x)] for label, x in meta["checks"]]

            rewrite(lambda rows: rows.withColumnRenamed(old, new), rename)
        elif what == "rename_table":
            (new,) = args
            if new in state["tables"]:
                raise SqlError("42P07", f"relation {new!r} exists")
            state["tables"][new] = state["tables"].pop(table)
            for data in state["data"].values():
                if table in data:
                    data[new] = data.pop(table)
            for m in state["tables"].values():
                for f in m["fks"]:
                    f["table"] = new if f["table"] == table else f["table"]
            for c in meta["columns"]:
                if c["identity"]:
                    state["sequences"][f"{new}_{c['name']}_seq"] = state["sequences"].pop(f"{table}_{c['name']}_seq")
        elif what == "type":
            column, kind, using = args
            c = self._column(table, column)
            rewrite(lambda rows: rows.withColumn(column, F.expr(f"CAST({using or name(column)} AS {kind})")), lambda: c.update(type=kind))
        elif what == "default":
            self._column(table, args[0])["default"] = args[1]
        elif what == "not_null":
            self._column(table, args[0])["not_null"] = args[1]
            self._check_rows(table, self.store.read(table, self.branch), "ALTER")
        elif what == "drop_constraint":
            (own,) = args
            meta["checks"] = [c for c in meta["checks"] if c[0] != own]
            meta["fks"] = [f for f in meta["fks"] if f["name"] != own]
        else:
            meta[what] = args[0]

    # Transactions, settings, cursors, channels

    def _do_begin(self, st) -> Result:
        if not self.open:
            self.store.refresh()
            self.open, self.deferred, self.pending = True, set(), []
        return Result("BEGIN")

    def _do_commit(self, st) -> Result:
        if self.failed:
            return self._do_rollback(st)
        self._end_local()
        if self.open:
            self.open = False
            try:
                self._check_pending()
            except SqlError:
                self.store.refresh()
                raise
            self.store.commit()
        return Result("COMMIT")

    def _do_rollback(self, st) -> Result:
        self.open = self.failed = False
        self.pending = []
        self._end_local()
        self.store.refresh()
        return Result("ROLLBACK")

    def _do_constraints(self, st) -> Result:
        names = st.names or [f["name"] for m in self.store.state["tables"].values() for f in m["fks"] if f["deferrable"]]
        for own in names:
            self.deferred.discard(own)
            self.deferred.discard("!" + own)
            self.deferred.add(own if st.deferred else "!" + own)
        if not st.deferred:
            self._check_pending()
        return Result("SET CONSTRAINTS")

    def _do_set(self, st) -> Result:
        if st.setting == "branch":
            self.store.chain(st.value)
            self.branch = st.value
        elif st.setting in ("role", "session_authorization"):
            self.user = st.value
        elif st.value is None:
            self.settings.pop(st.setting, None)
        else:
            self.settings[st.setting] = st.value
        return Result("SET")

    def _do_reset(self, st) -> Result:
        self.settings.pop(st.setting, None)
        return Result("SET RESET")

    def _do_show(self, st) -> Result:
        value = self.branch if st.setting == "branch" else self.settings.get(st.setting)
        return Result("SHOW", self.spark.createDataFrame([(value,)], f"{name(st.setting)} string"))

    def _do_declare(self, st) -> Result:
        self.cursor_plans[st.cursor] = self._frame(st.sql, st.recursive)
        return Result("DECLARE CURSOR")

    def _do_fetch(self, st) -> Result:
        if st.cursor not in self.cursor_plans:
            raise SqlError("34000", f"cursor {st.cursor!r} doesn't exist")
        plan = self.cursor_plans[st.cursor]
        at = self.cursors.setdefault(st.cursor, plan.toLocalIterator())
        rows = []
        while st.count is None or len(rows) < st.count:
            row = next(at, None)
            if row is None:
                break
            rows.append(row)
        return Result("FETCH", self.spark.createDataFrame(rows, plan.schema), len(rows))

    def _do_close(self, st) -> Result:
        self.cursor_plans.pop(st.cursor, None)
        self.cursors.pop(st.cursor, None)
        return Result("CLOSE CURSOR")

    def _do_listen(self, st) -> Result:
        self.database.listeners.setdefault(st.channel, []).append(self.notified)
        return Result("LISTEN")

    def _do_unlisten(self, st) -> Result:
        for channel in [st.channel] if st.channel != "*" else list(self.database.listeners):
            self.database.listeners[channel] = [f for f in self.database.listeners.get(channel, []) if f != self.notified]
        return Result("LISTEN")

    def _do_notify(self, st) -> Result:
        for f in self.database.listeners.get(st.channel, []):
            f(st.channel, st.payload)
        return Result("NOTIFY")

    def notified(self, channel: str, payload: str) -> None:
        """Called for each notification; they gather in ``notifications``."""
        self.__dict__.setdefault("notifications", []).append((channel, payload))

    def _do_prepare(self, st) -> Result:
        self.prepared[st.name] = st.text
        return Result("PREPARE")

    def _do_execute(self, st) -> Result:
        if st.name not in self.prepared:
            raise SqlError("26000", f"prepared statement {st.name!r} doesn't exist")
        values = self.spark.sql("SELECT " + (", ".join(f"{v} AS c{i}" for i, v in enumerate(st.values)) or "1")).first()
        return self._run(self.prepared[st.name], list(values) if st.values else [])

    def _do_copy(self, st) -> Result:
        raise SqlError("0A000", "COPY runs through copy_to() and copy_from()")
