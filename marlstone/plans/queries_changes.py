"""DML, constraints, branches, row-level security, views and COPY on copies of the small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalogue import query


def _session(spark: SparkSession, sf_dir: str, *statements: str):
    from .engine import Database

    s = Database(spark).session()
    for t in ("region", "nation", "customer", "supplier"):
        s.register(f"src_{t}", spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    for text in statements:
        s.execute(text)
    return s


_NATION = ("CREATE TABLE n (k int PRIMARY KEY, name text NOT NULL, region int CHECK (region >= 0))", "INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM src_nation")
_N = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation"


@query(f"{_N} UNION ALL SELECT 100, 'NEW', 1 UNION ALL SELECT 101, 'NEWER', 2")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "INSERT INTO n VALUES (100, 'NEW', 1), (101, 'NEWER', 2)").sql("SELECT * FROM n")


@query("SELECT 100 AS k, 'new' AS l UNION ALL SELECT 101, 'newer'")
def dml_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION).sql("INSERT INTO n VALUES (100, 'NEW', 1), (101, 'NEWER', 2) RETURNING k, lower(name) AS l")


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_regionkey = 1 THEN n_regionkey + 10 ELSE n_regionkey END AS region FROM nation")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "UPDATE n SET name = lower(name), region = region + 10 WHERE region = 1").sql("SELECT * FROM n")


@query("SELECT n_nationkey AS k, r_name AS name, n_regionkey AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey >= 2")
def dml_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "UPDATE n SET name = r.r_name FROM src_region r WHERE n.region = r.r_regionkey AND r.r_regionkey < 2").sql("SELECT * FROM n")


@query(f"{_N} WHERE n_regionkey <> 3")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "DELETE FROM n WHERE region = 3").sql("SELECT * FROM n")


@query(f"{_N} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def dml_delete_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "DELETE FROM n USING src_supplier s WHERE n.k = s.s_nationkey AND s.s_acctbal < 0").sql("SELECT * FROM n")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN n_name || '+three' ELSE n_name END AS name, n_regionkey AS region FROM nation UNION ALL SELECT 77, 'added', 4")
def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "INSERT INTO n VALUES (3, '+three', 9), (77, 'added', 4) ON CONFLICT (k) DO UPDATE SET name = n.name || EXCLUDED.name").sql("SELECT * FROM n")


@query(f"{_N} UNION ALL SELECT 77, 'added', 4")
def dml_upsert_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "INSERT INTO n VALUES (3, 'x', 9), (77, 'added', 4) ON CONFLICT DO NOTHING").sql("SELECT * FROM n")


@query("SELECT CAST(0 AS BIGINT) AS n")
def dml_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "TRUNCATE TABLE n").sql("SELECT count(*) AS n FROM n")


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER) AS id, r_name AS name, 'open' AS st, upper(r_name) || '!' AS shout FROM region")
def dml_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "CREATE TABLE d (id serial PRIMARY KEY, name text, st text DEFAULT 'open', shout text GENERATED ALWAYS AS (upper(name) || '!') STORED)", "INSERT INTO d (name) SELECT r_name FROM src_region ORDER BY r_regionkey").sql("SELECT * FROM d")


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN NULL ELSE s_nationkey END AS nation FROM supplier WHERE s_nationkey <> 7")
def dml_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "CREATE TABLE a (s_suppkey bigint PRIMARY KEY, nation int REFERENCES n (k) ON DELETE SET NULL, twin int REFERENCES n (k) ON DELETE CASCADE)", "INSERT INTO a SELECT s_suppkey, CASE WHEN s_nationkey <> 7 THEN s_nationkey END, CASE WHEN s_nationkey = 7 THEN 7 END FROM src_supplier", "DELETE FROM n WHERE k < 5 OR k = 7").sql("SELECT s_suppkey, nation FROM a")


_BRANCHED = (*_NATION, "CREATE BRANCH dev FROM main", "SET branch = dev", "UPDATE n SET name = 'changed' WHERE k = 1", "DELETE FROM n WHERE k = 2", "INSERT INTO n VALUES (200, 'added', 0)")
_DEV = "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 1 THEN 'changed' ELSE n_name END AS name, n_regionkey AS region FROM nation WHERE n_nationkey <> 2 UNION ALL SELECT 200, 'added', 0"


@query(f"SELECT 'dev' AS b, * FROM ({_DEV}) UNION ALL SELECT 'main' AS b, * FROM ({_N})")
def branch_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_BRANCHED)
    dev = s.sql("SELECT 'dev' AS b, n.* FROM n")
    s.execute("SET branch = main")
    return dev.unionByName(s.sql("SELECT 'main' AS b, n.* FROM n"))


@query(_DEV)
def branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_BRANCHED, "SET branch = main", "MERGE BRANCH dev INTO main", "DROP BRANCH dev").sql("SELECT * FROM n")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def rls_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(
        spark, sf_dir, "CREATE TABLE c (c_custkey bigint PRIMARY KEY, c_mktsegment text, c_acctbal float8)", "INSERT INTO c SELECT c_custkey, c_mktsegment, c_acctbal FROM src_customer",
        "CREATE POLICY own ON c USING (c_mktsegment = current_setting('app.segment'))", "CREATE POLICY never ON c FOR SELECT TO nobody USING (true)", "CREATE POLICY positive ON c AS RESTRICTIVE USING (c_acctbal > 0)",
        "ALTER TABLE c ENABLE ROW LEVEL SECURITY", "SET app.segment = 'BUILDING'",
    ).sql("SELECT c_custkey, c_mktsegment FROM c")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE false")
def rls_default_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "CREATE TABLE c AS SELECT c_custkey, c_mktsegment FROM src_customer", "ALTER TABLE c ENABLE ROW LEVEL SECURITY").sql("SELECT * FROM c")


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY n_regionkey")
def view_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "CREATE VIEW v (region, n) AS SELECT region, count(*) FROM n GROUP BY region").sql("SELECT * FROM v")


@query("SELECT 'before' AS at, CAST(25 AS BIGINT) AS n UNION ALL SELECT 'after', 24")
def materialized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION, "CREATE MATERIALIZED VIEW m AS SELECT * FROM n", "DELETE FROM n WHERE k = 0")
    before = s.sql("SELECT 'before' AS at, count(*) AS n FROM m")
    s.execute("REFRESH MATERIALIZED VIEW m")
    return before.unionByName(s.sql("SELECT 'after' AS at, count(*) AS n FROM m"))


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
def ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "CREATE TABLE t AS SELECT s_nationkey, count(*) AS n FROM src_supplier GROUP BY s_nationkey").sql("SELECT * FROM t")


@query("SELECT n_nationkey AS key, CAST(n_regionkey AS BIGINT) AS region, 'x' AS extra FROM nation")
def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "ALTER TABLE n DROP COLUMN name", "ALTER TABLE n ADD COLUMN extra text DEFAULT 'x'", "ALTER TABLE n RENAME COLUMN k TO key", "ALTER TABLE n ALTER COLUMN region TYPE bigint").sql("SELECT key, region, extra FROM n")


@query("SELECT * FROM (VALUES ('k', 'integer', 'NO'), ('name', 'text', 'NO'), ('region', 'integer', 'YES')) AS v(column_name, data_type, is_nullable)")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, _NATION[0]).sql("SELECT column_name, data_type, is_nullable FROM information_schema.columns WHERE table_name = 'n'")


@query(_N)
def copy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, *_NATION, "CREATE TABLE again (k int PRIMARY KEY, name text, region int)")
    s.copy_from("COPY again FROM STDIN WITH (FORMAT csv, HEADER)", "\n".join(s.copy_to("COPY n TO STDOUT WITH (FORMAT csv, HEADER)")))
    return s.sql("SELECT * FROM again")


@query("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2")
def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, *_NATION, "PREPARE q AS SELECT k FROM n WHERE region = $1").sql("EXECUTE q(2)")
