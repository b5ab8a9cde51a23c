"""Scans, filters, joins, aggregates, windows, sorting, set operations, CTEs."""

from __future__ import annotations

from .catalogue import dialect

dialect(
    "join_json_key",
    "SELECT e.event_id, e.user_id, u.c_name FROM events e JOIN customer u ON u.c_custkey = CAST(e.props ->> 'k' AS BIGINT) WHERE e.event_type = 'error'",
)

# Scans and filters
dialect("scan_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem")
dialect("filter_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07")
dialect("filter_point", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
dialect("filter_composite", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 1 AND l_linenumber = 2")
dialect("filter_expression", "SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building'")
dialect("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%BRASS%' OR p_name ILIKE '%a%' AND p_brand NOT LIKE '%3'")
dialect("filter_regex", "SELECT p_partkey FROM part WHERE p_brand ~ '[13]$' AND NOT p_type ~ '^S'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '[13]$') AND NOT regexp_matches(p_type, '^S')")
dialect("filter_similar", "SELECT n_nationkey, n_name FROM nation WHERE n_name SIMILAR TO '(A|B)%'", "SELECT n_nationkey, n_name FROM nation WHERE regexp_full_match(n_name, '(?:(A|B).*)')")
dialect("filter_null", "SELECT nullif(o_orderstatus, 'F') AS st, o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL")
dialect("three_valued_logic", "SELECT count(*) AS n FROM orders WHERE NOT (nullif(o_orderstatus, 'F') = 'O')")
dialect("in_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (1, 2, 3)")
dialect("row_in_list", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'F'))")
dialect("row_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ROW(l_orderkey, l_linenumber) < ROW(10, 3)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey < 10 OR (l_orderkey = 10 AND l_linenumber < 3)")
dialect("quantified_any", "SELECT n_name FROM nation WHERE n_regionkey = ANY(ARRAY[1, 3])")
dialect("quantified_all", "SELECT n_name FROM nation WHERE n_regionkey <> ALL(ARRAY[1, 3])")
dialect("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done FROM orders")
dialect("cast_types", "SELECT o_orderkey::text AS t, round(o_totalprice)::bigint AS b, '2024-02-29'::date AS d, '12.50'::numeric(10,2) AS n, (o_orderkey > 5)::int AS i FROM orders")
dialect("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
dialect("scalar_subquery_list", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
dialect("exists_subquery", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
dialect("not_exists_subquery", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
dialect("in_subquery", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
dialect("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
dialect("array_subquery", "SELECT array_to_string(ARRAY(SELECT r_name FROM region WHERE r_regionkey < 1), ',') AS names")
dialect("constant_row", "SELECT 1 + 1 AS a, 'x' || 'y' AS b, NULL::int AS c WHERE 2 > 1")

# Joins
dialect("join_inner", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
dialect("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'")
dialect("join_right", "SELECT n.n_name, s.s_suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
dialect("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 10) a FULL OUTER JOIN (SELECT s_nationkey AS k FROM supplier WHERE s_suppkey < 20) b ON a.k = b.k")
dialect("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
dialect("join_comma", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE n.n_regionkey = r.r_regionkey")
dialect("join_using", "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'P') o USING (l_orderkey) GROUP BY l_orderkey")
dialect("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
dialect("join_star", "SELECT r.r_name, n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name")
dialect("lateral_topk", "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) o ON true")
dialect("comma_lateral", "SELECT n.n_name, x.m FROM nation n, LATERAL (SELECT max(s_acctbal) AS m FROM supplier WHERE s_nationkey = n.n_nationkey) x")

# Aggregates
dialect("agg_basic", "SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS open, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS lo, max(o_orderdate) AS hi FROM orders")
dialect("agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
dialect("agg_group", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2")
dialect("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
dialect("having_without_group", "SELECT count(*) AS n FROM orders HAVING count(*) > 10")
dialect("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
dialect("agg_filter", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'X') AS x FROM orders GROUP BY o_custkey")
dialect("agg_bool", "SELECT o_custkey, bool_and(o_totalprice > 20000) AS every_one, bool_or(o_totalprice > 400000) AS any_one FROM orders GROUP BY o_custkey")
dialect("agg_string", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
dialect("agg_array", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name DESC), ';') AS names FROM nation GROUP BY n_regionkey")
dialect("agg_json", "SELECT r_regionkey, json_agg(r_name) AS j FROM region GROUP BY r_regionkey", "SELECT r_regionkey, '[\"' || r_name || '\"]' AS j FROM region")
dialect("agg_json_object", "SELECT r_regionkey, json_object_agg(r_name, r_regionkey) AS j FROM region GROUP BY r_regionkey", "SELECT r_regionkey, '{\"' || r_name || '\":' || r_regionkey || '}' AS j FROM region")
dialect("agg_percentile_cont", "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS median FROM events GROUP BY event_type")
dialect("agg_percentile_disc", "SELECT event_type, percentile_disc(0.25) WITHIN GROUP (ORDER BY value) AS q1 FROM events GROUP BY event_type")
dialect("agg_mode", "SELECT mode() WITHIN GROUP (ORDER BY x) AS m FROM (SELECT CASE WHEN n_nationkey < 20 THEN 1 ELSE n_nationkey END AS x FROM nation) t", "SELECT mode(x) AS m FROM (SELECT CASE WHEN n_nationkey < 20 THEN 1 ELSE n_nationkey END AS x FROM nation) t")
dialect("agg_rollup", "SELECT r.r_name, n.n_name, count(*) AS n, grouping(n.n_name) AS g FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ROLLUP (r.r_name, n.n_name)", "SELECT r.r_name, n.n_name, count(*) AS n, CAST(grouping(n.n_name) AS INTEGER) AS g FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ROLLUP (r.r_name, n.n_name)")
dialect("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
dialect("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
dialect("agg_ordinal", "SELECT upper(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, s")
dialect("agg_statistics", "SELECT o_orderstatus, round(stddev(o_totalprice), 2) AS sd, round(corr(o_totalprice, o_custkey), 6) AS c FROM orders GROUP BY o_orderstatus")

# Windows
dialect("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
dialect("win_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS d FROM lineitem")
dialect("win_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders")
dialect("win_partition", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS mean, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders")
dialect("win_named", "SELECT n_name, rank() OVER w AS r, count(*) OVER w AS n FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)")
dialect("win_offsets", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS q FROM orders")
dialect("win_frames", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first FROM orders")

# Sorting, limits, distinct, set operations
dialect("sort_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st FROM orders ORDER BY st DESC, o_orderkey LIMIT 50", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st FROM orders ORDER BY st DESC NULLS FIRST, o_orderkey LIMIT 50")
dialect("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
dialect("fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 7 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
dialect("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
dialect("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
dialect("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
for _key, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    dialect(f"set_{_key}", f"SELECT c_nationkey AS k FROM customer WHERE c_custkey < 60 {_op} SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 20")
dialect("set_precedence", "SELECT 1 AS x UNION ALL SELECT 2 INTERSECT SELECT 2 ORDER BY x DESC LIMIT 5")

# CTEs, views, series
dialect("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000), per (custkey, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) SELECT c.c_name, p.n FROM per p JOIN customer c ON c.c_custkey = p.custkey WHERE p.n > 2")
dialect("cte_recursive_all", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS s FROM t")
dialect("cte_recursive_distinct", "WITH RECURSIVE t(n) AS (SELECT 1 UNION SELECT (n * 2) % 7 FROM t) SELECT n FROM t")
dialect("derived_table", "SELECT q.s, max(q.n) AS m FROM (SELECT o_orderstatus AS s, o_custkey, count(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) q GROUP BY q.s")
dialect("generate_series", "SELECT CAST(g.n AS BIGINT) AS n FROM generate_series(0, 20, 5) AS g(n)")
dialect("generate_series_join", "SELECT n.n_name, CAST(g.i AS BIGINT) AS i FROM nation n, generate_series(1, 3) AS g(i)")
dialect("unnest_array", "SELECT u.x FROM unnest(ARRAY[3, 1, 2]) AS u(x)")
dialect("json_elements", """SELECT j.x FROM jsonb_array_elements('[1, {"a": 2}, "z"]') AS j(x)""", """SELECT unnest(['1', '{"a":2}', 'z']) AS x""")
