"""What statements leave behind: constraints, transactions, indexes, cursors, copies, sequences, vectors, texts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexer import SqlError
from ..operators import fulltext, vector
from ..sources.shared import Files, folder
from ..streaming import spans
from .catalogue import query
from .queries_changes import _N, _NATION, _session


def _state(s, text: str) -> str:
    """The SQLSTATE of a statement that fails, or what a good one did."""
    try:
        out = s.execute(text)
        if out.rows is not None and out.tag == "SELECT":
            s.fetch(text)
        return out.tag
    except SqlError as e:
        return e.state


def _states(spark: SparkSession, s, cases: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, _state(s, t)) for k, t in cases.items()], "what string, state string")


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v({columns})"


@query(_values("what, state", "('same', '23505')", "('unique', '23505')", "('nulls', 'INSERT 0 2')", "('among', '23505')", "('update', '23505')", "('null', '23502')"))
def constraint_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION, "CREATE TABLE u (a int PRIMARY KEY, b text UNIQUE, c int)", "INSERT INTO u SELECT k, name, region FROM n")
    return _states(spark, s, {"same": "INSERT INTO u VALUES (1, 'x', 1)", "unique": "INSERT INTO u SELECT 100, name, 1 FROM n WHERE k = 7", "nulls": "INSERT INTO u VALUES (100, NULL, 1), (101, NULL, 1)", "among": "INSERT INTO u VALUES (200, 'y', 1), (201, 'y', 1)", "update": "UPDATE u SET a = 1 WHERE a = 2", "null": "INSERT INTO u (b) VALUES ('z')"})


@query("SELECT 'check' AS what, '23514' AS state UNION ALL SELECT 'null passes', 'INSERT 0 1' UNION ALL SELECT 'update', '23514' UNION ALL SELECT 'not null', '23502' UNION ALL SELECT 'all or nothing', '23514' UNION ALL SELECT 'count', CAST(count(*) + 1 AS VARCHAR) FROM nation")
def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION)
    out = _states(spark, s, {"check": "INSERT INTO n VALUES (100, 'x', -1)", "null passes": "INSERT INTO n VALUES (100, 'x', NULL)", "update": "UPDATE n SET region = region - 1", "not null": "INSERT INTO n VALUES (101, NULL, 1)", "all or nothing": "INSERT INTO n VALUES (101, 'fine', 1), (102, 'bad', -5)"})
    return out.unionByName(s.sql("SELECT 'count' AS what, count(*)::text AS state FROM n"))


@query(_values("what, state", "('no parent', '23503')", "('restrict', '23503')", "('key in use', '23503')", "('drop parent', '2BP01')", "('null', 'INSERT 0 1')", "('cascade', 'UPDATE 1')", "('drop cascade', 'DROP TABLE')"))
def constraint_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION, "CREATE TABLE c (id int PRIMARY KEY, n int REFERENCES n (k))", "CREATE TABLE m (k int PRIMARY KEY)", "INSERT INTO m VALUES (1), (2)", "CREATE TABLE d (id int PRIMARY KEY, m int REFERENCES m (k) ON UPDATE CASCADE)", "INSERT INTO c VALUES (1, 5)", "INSERT INTO d VALUES (1, 2)")
    return _states(spark, s, {"no parent": "INSERT INTO c VALUES (2, 500)", "restrict": "DELETE FROM n WHERE k = 5", "key in use": "UPDATE n SET k = 900 WHERE k = 5", "drop parent": "DROP TABLE n", "null": "INSERT INTO c VALUES (3, NULL)", "cascade": "UPDATE m SET k = 7 WHERE k = 2", "drop cascade": "DROP TABLE n CASCADE"})


@query(_values("what, state", "('early', 'INSERT 0 1')", "('parent', 'INSERT 0 1')", "('commit', 'COMMIT')", "('dangling', 'INSERT 0 1')", "('refused', '23503')", "('now', '23503')"))
def constraint_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "CREATE TABLE p (k int PRIMARY KEY)", "CREATE TABLE c (k int PRIMARY KEY, p int, CONSTRAINT fk FOREIGN KEY (p) REFERENCES p (k) DEFERRABLE INITIALLY DEFERRED)", "BEGIN")
    out = [(k, _state(s, t)) for k, t in (("early", "INSERT INTO c VALUES (1, 1)"), ("parent", "INSERT INTO p VALUES (1)"), ("commit", "COMMIT"))]
    s.execute("BEGIN")
    out += [("dangling", _state(s, "INSERT INTO c VALUES (2, 9)")), ("refused", _state(s, "COMMIT"))]
    s.execute("BEGIN")
    s.execute("SET CONSTRAINTS fk IMMEDIATE")
    out.append(("now", _state(s, "INSERT INTO c VALUES (3, 9)")))
    s.execute("ROLLBACK")
    return spark.createDataFrame(out, "what string, state string")


@query("SELECT 'rolled back' AS what, CAST(count(*) AS VARCHAR) AS state FROM nation UNION ALL SELECT 'failed', '23505' UNION ALL SELECT 'aborted', '25P02' UNION ALL SELECT 'committed', CAST(count(*) - 1 AS VARCHAR) FROM nation UNION ALL SELECT 'inside', CAST(count(*) - 1 AS VARCHAR) FROM nation UNION ALL SELECT 'outside', CAST(count(*) AS VARCHAR) FROM nation UNION ALL SELECT 'conflict', '40001'")
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION)
    other, count = s.database.session(), "SELECT count(*) AS c FROM n"
    out = []
    for t in ("BEGIN", "DELETE FROM n", "SAVEPOINT a", "ROLLBACK"):
        s.execute(t)
    out.append(("rolled back", str(s.fetch(count)[0].c)))
    s.execute("BEGIN")
    out += [("failed", _state(s, "INSERT INTO n VALUES (1, 'x', 1)")), ("aborted", _state(s, count))]
    for t in ("ROLLBACK", "BEGIN", "DELETE FROM n WHERE k = 0"):
        s.execute(t)
    out += [("inside", str(s.fetch(count)[0].c)), ("outside", str(other.fetch(count)[0].c))]
    other.execute("BEGIN")
    other.execute("UPDATE n SET region = 1 WHERE k = 1")
    s.execute("COMMIT")
    out += [("conflict", _state(other, "COMMIT")), ("committed", str(s.fetch(count)[0].c))]
    return spark.createDataFrame(out, "what string, state string")


@query("SELECT 'rows' AS what, CAST(count(*) AS VARCHAR) AS state FROM nation WHERE n_regionkey = 1 AND n_name > 'B' UNION ALL SELECT 'lower', CAST(count(*) AS VARCHAR) FROM nation WHERE lower(n_name) = 'china' UNION ALL SELECT 'partial', '23505' UNION ALL SELECT 'outside', 'INSERT 0 1' UNION ALL SELECT 'expression', '23505' UNION ALL SELECT 'exists', '42P07' UNION ALL SELECT 'dup', '23505' UNION ALL SELECT 'dropped', 'DROP INDEX' UNION ALL SELECT 'gone', '42704'")
def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION, "CREATE INDEX r ON n (region, name)", "CREATE INDEX part ON n (name) WHERE region = 1", "CREATE UNIQUE INDEX one ON n (name) WHERE region < 3", "CREATE UNIQUE INDEX low ON n (lower(name))")
    out = [("rows", str(s.fetch("SELECT count(*) AS c FROM n WHERE region = 1 AND name > 'B'")[0].c)), ("lower", str(s.fetch("SELECT count(*) AS c FROM n WHERE lower(name) = 'china'")[0].c))]
    cases = {"partial": "INSERT INTO n SELECT 100, name, 2 FROM n WHERE region < 3 LIMIT 1", "expression": "INSERT INTO n SELECT 101, lower(name), 4 FROM n WHERE k = 9", "outside": "INSERT INTO n VALUES (102, 'ELSEWHERE', 4)", "exists": "CREATE INDEX r ON n (k)", "dup": "CREATE UNIQUE INDEX bad ON n (region)", "dropped": "DROP INDEX low", "gone": "DROP INDEX low"}
    return spark.createDataFrame(out + [(k, _state(s, t)) for k, t in cases.items()], "what string, state string")


@query("SELECT 'first' AS what, n_nationkey AS k FROM nation WHERE n_nationkey < 2 UNION ALL SELECT 'then', n_nationkey FROM nation WHERE n_nationkey BETWEEN 2 AND 4 UNION ALL SELECT 'closed', 34000")
def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION, "DECLARE c CURSOR FOR SELECT k FROM n ORDER BY k")
    out = [("first", r.k) for r in s.sql("FETCH 2 FROM c").collect()] + [("then", r.k) for r in s.sql("FETCH 3 FROM c").collect()]
    s.execute("CLOSE c")
    return spark.createDataFrame([*out, ("closed", int(_state(s, "FETCH 1 FROM c")))], "what string, k int")


@query(f"SELECT 'binary' AS what, * FROM ({_N}) UNION ALL SELECT 'text', * FROM ({_N}) WHERE region = 1 UNION ALL SELECT 'columns', k, name, NULL FROM ({_N})")
def copy_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION, *(f"CREATE TABLE {t} (k int PRIMARY KEY, name text, region int)" for t in ("b", "t", "c")))
    s.copy_from("COPY b FROM STDIN WITH (FORMAT binary)", b"".join(s.copy_to("COPY n TO STDOUT WITH (FORMAT binary)")))
    s.copy_from("COPY t FROM STDIN", "\n".join(s.copy_to("COPY (SELECT * FROM n WHERE region = 1) TO STDOUT")))
    s.copy_from("COPY c (k, name) FROM STDIN", "\n".join(s.copy_to("COPY n (k, name) TO STDOUT")))
    return s.sql("SELECT 'binary' AS what, b.* FROM b UNION ALL SELECT 'text', t.* FROM t UNION ALL SELECT 'columns', c.* FROM c")


@query(f"SELECT 'restored' AS what, count(*) AS n FROM ({_N}) UNION ALL SELECT 'view', count(*) FROM ({_N}) WHERE region = 1 UNION ALL SELECT 'branch', count(*) - 1 FROM ({_N})")
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION, "CREATE VIEW v AS SELECT * FROM n WHERE region = 1", "CREATE BRANCH dev FROM main", "SET branch = dev", "DELETE FROM n WHERE k = 3", "SET branch = main")
    to = f"{folder(spark)}/backup-{uuid.uuid4().hex}"
    s.store.backup(to)
    s.execute("DELETE FROM n")
    again = _session(spark, sf_dir)
    again.store.restore(to)
    out = again.sql("SELECT 'restored' AS what, count(*) AS n FROM n UNION ALL SELECT 'view', count(*) FROM v")
    again.execute("SET branch = dev")
    return out.unionByName(again.sql("SELECT 'branch' AS what, count(*) AS n FROM n"))


@query(_values("what, v", "('next', 10)", "('again', 15)", "('curr', 15)", "('last', 15)", "('set', 100)", "('after', 105)", "('default', 1)", "('default', 2)", "('unknown', 42)", "('early', 55)"))
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "CREATE SEQUENCE q START 10 INCREMENT BY 5")
    one = lambda text: int(s.fetch(f"SELECT {text} AS v")[0].v)
    out = [("early", int(_state(s, "SELECT currval('q')")[:2])), ("next", one("nextval('q')")), ("again", one("nextval('q')")), ("curr", one("currval('q')")), ("last", one("lastval()")), ("set", one("setval('q', 100)")), ("after", one("nextval('q')")), ("unknown", int(_state(s, "SELECT nextval('zz')")[:2]))]
    s.execute("CREATE TABLE t (id serial PRIMARY KEY, x int)")
    out += [("default", r.id) for r in s.sql("INSERT INTO t (x) VALUES (7), (8) RETURNING id").collect()]
    return spark.createDataFrame(out, "what string, v int")


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey < 2 THEN 'low' ELSE 'high' END AS lvl, n_name AS street, n_regionkey AS nr, 'bad label 22P02' AS bad FROM nation")
def types_enum_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION, "CREATE TYPE lvl AS ENUM ('low', 'high')", "CREATE TYPE addr AS (street text, nr int)", "CREATE TABLE t (k int PRIMARY KEY, lvl lvl, a addr)", "INSERT INTO t SELECT k, CASE WHEN region < 2 THEN 'low' ELSE 'high' END, ROW(name, region) FROM n")
    state = _state(s, "INSERT INTO t VALUES (1000, 'middle', NULL)")
    return s.sql(f"SELECT k, lvl, (a).street AS street, (a).nr AS nr, 'bad label {state}' AS bad FROM t")


@query(_values("what, state", "('own', 'INSERT 0 1')", "('other', '42501')", "('move', '42501')", "('change', 'UPDATE 1')", "('seen', '1')", "('as b', '1')", "('missing', '42704')", "('may miss', 'SELECT')"))
def rls_with_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "CREATE TABLE d (id int PRIMARY KEY, tenant text, body text)", "INSERT INTO d VALUES (1, 'b', 'of b')", "CREATE POLICY p ON d USING (tenant = current_setting('app.tenant')) WITH CHECK (tenant = current_setting('app.tenant'))", "ALTER TABLE d ENABLE ROW LEVEL SECURITY", "SELECT set_config('app.tenant', 'a', false)")
    out = [(k, _state(s, t)) for k, t in (("own", "INSERT INTO d VALUES (2, 'a', 'x')"), ("other", "INSERT INTO d VALUES (3, 'b', 'x')"), ("move", "UPDATE d SET tenant = 'b'"), ("change", "UPDATE d SET body = 'y'"))]
    out.append(("seen", str(s.fetch("SELECT count(*) AS c FROM d")[0].c)))
    for t in ("BEGIN", "SELECT set_config('app.tenant', 'b', true)"):
        s.execute(t)
    out.append(("as b", str(s.fetch("SELECT count(*) AS c FROM d WHERE body = 'of b'")[0].c)))
    s.execute("COMMIT")
    out += [("missing", _state(s, "SELECT current_setting('no.such') AS v")), ("may miss", _state(s, "SELECT current_setting('no.such', true) AS v"))]
    return spark.createDataFrame(out, "what string, state string")


@query(_values("what, v", "('heard', 'ch:hello')", "('user', 'ann')", "('database', 'marlstone')", "('schema', 'public')", "('show', '7')", "('reset', 'none')", "('ignored', 'SET')", "('arity', '42601')", "('zero', '22012')", "('column', '42703')", "('table', '42P01')"))
def session_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION).database.session("ann")
    for t in ("LISTEN ch", "NOTIFY ch, 'hello'", "UNLISTEN ch", "NOTIFY ch, 'unheard'", "SET app.x = '7'"):
        s.execute(t)
    out = [("heard", ",".join(f"{c}:{p}" for c, p in s.notifications)), ("show", s.fetch("SELECT current_setting('app.x') AS v")[0].v)]
    r = s.fetch("SELECT current_user AS u, current_database() AS d, current_schema() AS c")[0]
    s.execute("RESET app.x")
    out += [("user", r.u), ("database", r.d), ("schema", r.c), ("reset", s.fetch("SELECT current_setting('app.x', true) AS v")[0].v or "none"), ("ignored", s.execute("COMMENT ON TABLE n IS 'x'").tag.split()[0])]
    out += [("arity", _state(s, "SELECT k FROM n UNION SELECT k, name FROM n")), ("zero", _state(s, "SELECT k / (region - region) AS x FROM n")), ("column", _state(s, "SELECT nothing FROM n")), ("table", _state(s, "SELECT * FROM nowhere"))]
    return spark.createDataFrame(out, "what string, v string")


@query("SELECT 'kept' AS what, count(*) - 2 AS n FROM nation UNION ALL SELECT 'dropped', 0 UNION ALL SELECT 'view', count(*) FROM nation WHERE n_regionkey = 0")
def drop_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION, "DELETE FROM n WHERE k IN (1, 2)", "CREATE TABLE gone (k int)", "DROP TABLE gone", "DROP TABLE IF EXISTS gone", "CREATE VIEW v AS SELECT * FROM n", "DROP VIEW v", "CREATE VIEW v AS SELECT * FROM n WHERE region = 0", "CREATE SEQUENCE q", "DROP SEQUENCE q")
    return s.sql("SELECT 'kept' AS what, count(*) AS n FROM n UNION ALL SELECT 'view', count(*) FROM v UNION ALL SELECT 'dropped', count(*) FROM information_schema.tables WHERE table_name = 'gone'")


@query("SELECT * FROM (VALUES ('tables', 'c'), ('tables', 'n'), ('views', 'v'), ('pk', 'n.k'), ('fk', 'c->n'), ('index', 'by_region'), ('sequence', 'q')) AS v(what, name)")
def catalog_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, _NATION[0], "CREATE TABLE c (id int PRIMARY KEY, n int REFERENCES n (k))", "CREATE VIEW v AS SELECT * FROM n", "CREATE INDEX by_region ON n (region)", "CREATE SEQUENCE q")
    return s.sql(
        "SELECT 'tables' AS what, table_name AS name FROM information_schema.tables WHERE table_type = 'BASE TABLE' AND table_schema = 'public' UNION ALL SELECT 'views', viewname FROM pg_catalog.pg_views UNION ALL SELECT 'sequence', sequencename FROM pg_catalog.pg_sequences"
        " UNION ALL SELECT 'index', indexname FROM pg_catalog.pg_indexes WHERE indexname = 'by_region'"
        " UNION ALL SELECT 'pk', k.table_name || '.' || k.column_name FROM information_schema.key_column_usage k JOIN information_schema.table_constraints t ON t.constraint_name = k.constraint_name AND t.table_name = k.table_name WHERE t.constraint_type = 'PRIMARY KEY' AND k.table_name = 'n'"
        " UNION ALL SELECT 'fk', t.table_name || '->n' FROM information_schema.table_constraints t WHERE t.constraint_type = 'FOREIGN KEY'"
    )


_CATALOG = "information_schema.applicable_roles information_schema.columns information_schema.constraint_column_usage information_schema.enabled_roles information_schema.key_column_usage information_schema.referential_constraints information_schema.role_column_grants information_schema.role_table_grants information_schema.role_usage_grants information_schema.table_constraints information_schema.tables pg_catalog.pg_am pg_catalog.pg_attrdef pg_catalog.pg_attribute pg_catalog.pg_class pg_catalog.pg_constraint pg_catalog.pg_description pg_catalog.pg_enum pg_catalog.pg_extension pg_catalog.pg_index pg_catalog.pg_indexes pg_catalog.pg_locks pg_catalog.pg_namespace pg_catalog.pg_policies pg_catalog.pg_proc pg_catalog.pg_roles pg_catalog.pg_sequences pg_catalog.pg_settings pg_catalog.pg_shdescription pg_catalog.pg_stat_activity pg_catalog.pg_stat_user_tables pg_catalog.pg_statio_user_tables pg_catalog.pg_tables pg_catalog.pg_type pg_catalog.pg_user pg_catalog.pg_views".split()


@query(_values("name", *(f"('{c}')" for c in _CATALOG)))
def catalog_every_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All catalog views can be read."""
    s = _session(spark, sf_dir, _NATION[0], "CREATE TYPE mood AS ENUM ('a')", "CREATE INDEX i ON n (region)")
    return s.sql(" UNION ALL ".join(f"SELECT '{c}' AS name FROM (SELECT count(*) AS c FROM {c}) x" for c in _CATALOG))


def _request(*own: tuple) -> str:
    made = [{"traceId": t, "spanId": s, "parentSpanId": "", "name": n, "startTimeUnixNano": str(a), "endTimeUnixNano": str(a + ms * 1_000_000), "status": {"code": c}, "attributes": [{"key": k, "value": {"stringValue": v}} for k, v in more]} for t, s, n, a, ms, c, more in own]
    return json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]}, "scopeSpans": [{"spans": made}]}]})


_NOW = 1_750_000_000 * 10**9


def _ingested(spark: SparkSession, table: spans.SpanTable, root: str, *requests: str) -> None:
    """Each request by a stream of its own into one table."""
    for i, text in enumerate(requests):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/in{i}")
        table.ingest(f"{root}/in{i}", f"{root}/checkpoint{i}").awaitTermination()


@query("SELECT 'span ' || i AS span, n_name AS nation, CASE WHEN i % 2 = 0 THEN 'ERROR' ELSE 'OK' END AS status FROM range(20) r(i) JOIN nation ON n_nationkey = i WHERE i % 2 = 0")
def spans_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that streams bring in, read as a table and joined to a relation through their attributes."""
    s = _session(spark, sf_dir, *_NATION)
    root = f"{folder(spark)}/spans-{uuid.uuid4().hex}"
    half = lambda lo, hi: _request(*(("t", f"s{i}", f"span {i}", _NOW + i, 5, 2 if i % 2 == 0 else 1, [("nation", "999"), ("nation", str(i))]) for i in range(lo, hi)))
    _ingested(spark, s.database.spans, root, half(0, 10), half(10, 20))
    return s.sql("SELECT p.span_name AS span, n.name AS nation, p.status FROM spans p JOIN n ON n.k = CAST(p.attributes ->> 'nation' AS int) WHERE p.status = 'ERROR'")


@query(_values("trace_id, span_id, duration_ms", "('t0', 'a', CAST(1 AS BIGINT))", "('t1', 'a', 9)", "('t1', 'b', 3)", "('t2', 'a', 4)"))
def stream_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three streams into one table: each keeps its spans, and of one that comes again the later counts."""
    root = f"{folder(spark)}/spans-{uuid.uuid4().hex}"
    table = spans.SpanTable(spark, f"{root}/table")
    _ingested(spark, table, root, _request(("t0", "a", "x", _NOW, 1, 1, []), ("t1", "a", "x", _NOW, 2, 1, [])), _request(("t1", "a", "x", _NOW, 9, 1, []), ("t1", "b", "x", _NOW, 3, 1, [("k", "1"), ("k", "2")])), _request(("t2", "a", "x", _NOW, 4, 1, [])))
    return table.read().select("trace_id", "span_id", "duration_ms")


_KNN = "SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 4) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 5"


@query(f"SELECT 'l2' AS metric, * FROM ({_KNN}) UNION ALL SELECT 'cosine', * FROM (SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 4) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 5)")
def knn_malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, short, long and zero vectors among the rows never match."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = e.filter("vec_id = 3").first()["embedding"]
    bad = spark.createDataFrame([(-1, None), (-2, [1.0]), (-3, [0.5] * (len(q) + 1)), (-4, [])], "vec_id bigint, embedding array<double>")
    zero = spark.createDataFrame([(-5, [0.0] * len(q))], "vec_id bigint, embedding array<double>")
    found = lambda rows, metric: vector.search(rows, "embedding", q, 5, metric, "vec_id").select(F.lit(metric).alias("metric"), "vec_id", F.round("distance", 4).alias("distance"))
    return found(e.unionByName(bad), "l2").unionByName(found(e.unionByName(bad).unionByName(zero), "cosine"))


@query("SELECT q.vec_id AS query_key, e.vec_id AS key, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS INTEGER) AS rank FROM embeddings e, embeddings q QUALIFY rank <= 3")
def knn_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest rows of every row."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector.search_many(e, e, 3, "vec_id", "embedding", "vec_id", "embedding").select("query_key", "key", "rank")


@query("SELECT 'found' AS what, '3' AS v UNION ALL SELECT 'moved', '777' UNION ALL SELECT 'count', CAST(count(*) + 1 AS VARCHAR) FROM embeddings UNION ALL SELECT 'short', '22000' UNION ALL SELECT 'loaded', '777' UNION ALL SELECT 'unchanged', '3'")
def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts, a snapshot and what is loaded from it.

    The row added has a key that no row of the table has, whatever the table's size, and keys are in the order of their numbers.
    """
    own = lambda i: f"row {i:020d}"
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.format_string("row %020d", "vec_id").alias("key"), F.col("embedding").alias("vector"))
    q = e.filter(F.col("key") == own(3)).first()["vector"]
    root = f"{folder(spark)}/vectors-{uuid.uuid4().hex}"
    table = vector.VectorTable(spark, f"{root}/a", len(q), bits=4, tables=8)
    table.upsert(e)
    nearest = lambda t: str(int(t.search(q, 1).first()["key"].split()[1]))
    out = [("found", nearest(table))]
    table.snapshot(f"{root}/before")
    far = [-5.0 * x for x in q]
    table.upsert(spark.createDataFrame([(own(3), far), ("new 777", [float(x) for x in q])], "key string, vector array<double>"))
    try:
        table.upsert(spark.createDataFrame([(own(9), [1.0])], "key string, vector array<double>"))
    except SqlError as error:
        out.append(("short", error.state))
    table.snapshot(f"{root}/after")
    out += [("moved", nearest(table)), ("count", str(table.rows().count())), ("loaded", nearest(vector.VectorTable.load(spark, f"{root}/after"))), ("unchanged", nearest(vector.VectorTable.load(spark, f"{root}/before")))]
    return spark.createDataFrame(out, "what string, v string")


_HITS = "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])licensed([^\\p{L}\\p{N}]|$)')"


@query(f"SELECT 'matches' AS what, count(*) AS n FROM ({_HITS}) UNION ALL SELECT 'stored', count(*) FROM ({_HITS}) UNION ALL SELECT 'deleted', count(*) - 1 FROM ({_HITS}) UNION ALL SELECT 'documents', count(*) - 1 FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'score', 1 UNION ALL SELECT 'no match', 0 UNION ALL SELECT 'no words', 0")
def text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, stored and reduced indexes, a document's score, and the number of documents."""
    index = fulltext.TextIndex(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    stored = index.save(f"{folder(spark)}/text-{uuid.uuid4().hex}")
    best = index.search("licensed", 1).first()["doc_id"]
    less = stored.delete(spark.createDataFrame([(best,)], "id bigint"))
    same = {tuple(r) for r in index.scores("licensed version").select("doc_id", F.round("score", 6)).collect()} == {tuple(r) for r in stored.scores("licensed version").select("doc_id", F.round("score", 6)).collect()}
    out = [("matches", index.scores("licensed").count()), ("stored", stored.scores("licensed").count() if same else -1), ("deleted", less.scores("licensed").count()), ("documents", less.count()), ("score", int(index.score(best, "licensed")[1] and index.score(best, "licensed")[0] > 0)), ("no match", int(index.score(best, "qqqqzzzz")[1])), ("no words", index.scores("the of").count())]
    return spark.createDataFrame(out, "what string, n bigint")


@query(_values("what, n", "('row', CAST(25 AS BIGINT))", "('kept', 24)", "('data', 2)"))
def dml_small_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of one row writes that row and the place of the old one; nothing else is written again."""
    s = _session(spark, sf_dir, *_NATION)
    before = set(Files(spark, s.database.root).names("data"))
    s.execute("UPDATE n SET name = 'x' WHERE k = 3")
    written = [f"{s.database.root}/data/{d}" for d in set(Files(spark, s.database.root).names("data")) - before]
    n = sum(spark.read.parquet(p).count() for p in written)
    return spark.createDataFrame([("row", s.fetch("SELECT count(*) AS c FROM n")[0].c), ("kept", s.fetch("SELECT count(*) AS c FROM n WHERE name <> 'x'")[0].c), ("data", n)], "what string, n bigint")
