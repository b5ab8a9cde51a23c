"""Scalar functions and operators of the dialect, over real columns where they can be."""

from __future__ import annotations

from .catalogue import dialect

dialect("fn_math", "SELECT o_orderkey, abs(-o_orderkey) AS a, ceil(o_totalprice) AS c, floor(o_totalprice) AS f, round(o_totalprice / 7, 2) AS r, round(sqrt(o_totalprice), 6) AS s, mod(o_orderkey, 7) AS m, o_orderkey % 5 AS p, round(power(o_custkey, 2), 2) AS w, sign(o_totalprice - 100000) AS g, round(ln(o_totalprice), 6) AS l, round(exp(1), 6) AS e, round(pi(), 6) AS pi, greatest(o_orderkey, o_custkey) AS hi, least(o_orderkey, NULL, o_custkey) AS lo FROM orders",
        "SELECT o_orderkey, abs(-o_orderkey) AS a, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f, round(o_totalprice / 7, 2) AS r, round(sqrt(o_totalprice), 6) AS s, mod(o_orderkey, 7) AS m, o_orderkey % 5 AS p, round(power(o_custkey, 2), 2) AS w, CAST(sign(o_totalprice - 100000) AS DOUBLE) AS g, round(ln(o_totalprice), 6) AS l, round(exp(1), 6) AS e, round(pi(), 6) AS pi, greatest(o_orderkey, o_custkey) AS hi, least(o_orderkey, NULL, o_custkey) AS lo FROM orders")
dialect("fn_math_more", "SELECT 2 ^ 10 AS p, trunc(-3.7::float8) AS t, div(17, 5) AS d, round(log(1000), 6) AS l, 17 / 5 AS q, -5 AS neg, ceiling(1.2::float8) AS c", "SELECT CAST(1024 AS DOUBLE) AS p, CAST(-3 AS BIGINT) AS t, CAST(3 AS BIGINT) AS d, 3.0::DOUBLE AS l, CAST(3 AS BIGINT) AS q, -5 AS neg, CAST(2 AS BIGINT) AS c")
dialect("fn_string", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, length(c_name) AS n, substring(c_name, 3, 4) AS s, left(c_name, 3) AS le, right(c_name, 4) AS ri, lpad(c_name, 5, '*') AS lp, rpad(c_mktsegment, 12, '.') AS rp, replace(c_name, 'Cus', 'X') AS re, reverse(c_name) AS rv, strpos(c_name, '#') AS po, split_part(c_name, '#', 2) AS sp, repeat('ab', 2) AS rt, translate(c_name, 'abc', 'xyz') AS tr, concat(c_name, NULL, '!') AS cc, trim('  x ') AS tm, ascii(c_name) AS asc_ FROM customer",
        "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, CAST(length(c_name) AS INTEGER) AS n, substring(c_name, 3, 4) AS s, left(c_name, 3) AS le, right(c_name, 4) AS ri, lpad(c_name, 5, '*') AS lp, rpad(c_mktsegment, 12, '.') AS rp, replace(c_name, 'Cus', 'X') AS re, reverse(c_name) AS rv, CAST(strpos(c_name, '#') AS INTEGER) AS po, split_part(c_name, '#', 2) AS sp, repeat('ab', 2) AS rt, translate(c_name, 'abc', 'xyz') AS tr, concat(c_name, NULL, '!') AS cc, trim('  x ') AS tm, ascii(c_name) AS asc_ FROM customer")
dialect("fn_string_more", "SELECT left('hello', -2) AS a, right('hello', -2) AS b, substring('hello', 0, 3) AS c, initcap('big table') AS d, overlay('Txxxxas' PLACING 'hom' FROM 2 FOR 4) AS e, octet_length('é') AS f, bit_length('ab') AS g, quote_literal('it''s') AS h, format('%s is %L', 'x', 'y') AS i, chr(233) AS j, position('b' IN 'abc') AS k, btrim('xxaxx', 'x') AS l", "SELECT 'hel' AS a, 'llo' AS b, 'he' AS c, 'Big Table' AS d, 'Thomas' AS e, 2 AS f, 16 AS g, '''it''''s''' AS h, 'x is ''y''' AS i, 'é' AS j, 2 AS k, 'a' AS l")
dialect("fn_regexp", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '-') AS one, regexp_replace(p_type, '[AEIOU]', '-', 'g') AS every_one, regexp_replace(p_brand, '#([0-9])', '<\\1>') AS ref FROM part", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '-') AS one, regexp_replace(p_type, '[AEIOU]', '-', 'g') AS every_one, regexp_replace(p_brand, '#([0-9])', '<\\1>') AS ref FROM part")
dialect("fn_encode", "SELECT encode('abc'::bytea, 'hex') AS h, encode('abc'::bytea, 'base64') AS b, get_byte('abc'::bytea, 1) AS g", "SELECT '616263' AS h, 'YWJj' AS b, 98 AS g")
dialect("fn_null", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, num_nulls(NULL, 1, nullif(o_orderstatus, 'F')) AS n, num_nonnulls(1, NULL) AS m FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, 1 + CAST(o_orderstatus = 'F' AS INTEGER) AS n, 1 AS m FROM orders")
dialect("fn_date", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, date_trunc('week', o_orderdate) AS w, date_part('year', o_orderdate) AS y, date_part('dow', o_orderdate) AS dow, date_part('doy', o_orderdate) AS doy, extract(quarter FROM o_orderdate) AS q, extract(century FROM o_orderdate) AS c, extract(decade FROM o_orderdate) AS d, o_orderdate + INTERVAL '1 day' AS n, CAST(o_orderdate AS DATE) AS dd, to_char(o_orderdate, 'YYYY-MM-DD') AS s FROM orders",
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS w, CAST(date_part('year', o_orderdate) AS INTEGER) AS y, CAST(date_part('dow', o_orderdate) AS INTEGER) AS dow, CAST(date_part('doy', o_orderdate) AS INTEGER) AS doy, CAST(extract(quarter FROM o_orderdate) AS INTEGER) AS q, CAST(extract(century FROM o_orderdate) AS INTEGER) AS c, CAST(extract(decade FROM o_orderdate) AS INTEGER) AS d, o_orderdate + INTERVAL 1 DAY AS n, CAST(o_orderdate AS DATE) AS dd, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders")
dialect("fn_date_more", "SELECT date_trunc('decade', TIMESTAMP '2024-05-06 07:08:09') AS d, extract(epoch FROM TIMESTAMP '2024-05-06 07:08:09.5') AS e, make_date(2024, 2, 29) AS m, to_timestamp(86400)::timestamp AS t, to_date('2024-03-04', 'YYYY-MM-DD') AS o", "SELECT TIMESTAMP '2020-01-01 00:00:00' AS d, CAST(1714979289.5 AS DOUBLE) AS e, DATE '2024-02-29' AS m, TIMESTAMP '1970-01-02 00:00:00' AS t, DATE '2024-03-04' AS o")
dialect("fn_array", "SELECT n_nationkey, array_length(ARRAY[n_nationkey, 1, 2], 1) AS n, array_position(ARRAY[5, n_regionkey], n_regionkey) AS p, ARRAY[1, 2] && ARRAY[n_regionkey] AS o, array_to_string(array_append(ARRAY[1], n_regionkey), '-') AS a, array_to_string(string_to_array('x,y', ','), '|') AS s, (ARRAY[10, 20, 30])[2] AS e FROM nation",
        "SELECT n_nationkey, 3 AS n, CAST(2 AS INTEGER) AS p, n_regionkey IN (1, 2) AS o, '1-' || n_regionkey AS a, 'x|y' AS s, 20 AS e FROM nation")
dialect("fn_array_contains", "SELECT n_nationkey, ARRAY[1, 2, 3] @> ARRAY[n_regionkey] AS c, ARRAY[n_regionkey] <@ ARRAY[0, 4] AS d FROM nation", "SELECT n_nationkey, n_regionkey IN (1, 2, 3) AS c, n_regionkey IN (0, 4) AS d FROM nation")
dialect("fn_json", "SELECT event_id, props ->> 'k' AS k, CAST(props ->> 'k' AS BIGINT) * 2 AS twice, props #>> '{k}' AS path, props ->> 'missing' AS none FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS twice, json_extract_string(props, '$.k') AS path, CAST(NULL AS VARCHAR) AS none FROM events")
dialect("fn_json_build", """SELECT r_regionkey, json_build_object('k', r_regionkey, 'n', r_name) AS o, json_build_array(r_regionkey, r_name, NULL) AS a, to_json(r_name) AS j FROM region""", """SELECT r_regionkey, '{"k":' || r_regionkey || ',"n":"' || r_name || '"}' AS o, '[' || r_regionkey || ',"' || r_name || '",null]' AS a, '"' || r_name || '"' AS j FROM region""")
dialect("fn_jsonb_edit", """SELECT jsonb_set('{"a":{"b":1},"c":[1,2]}', '{a,b}', '9') AS s, jsonb_set('{"a":1}', '{z}', '2') AS created, jsonb_set('{"a":1}', '{z}', '2', false) AS kept, '{"a":{"b":1}}'::jsonb @> '{"a":{}}'::jsonb AS inside, '{"a":1}'::jsonb ? 'a' AS has, ('{"a":{"b":1,"c":2}}'::jsonb -> 'a') - 'b' AS less""",
        """SELECT '{"a":{"b":9},"c":[1,2]}' AS s, '{"a":1,"z":2}' AS created, '{"a":1}' AS kept, true AS inside, true AS has, '{"c":2}' AS less""")  # fmt: skip
dialect("fn_typed", "SELECT int4('7') + 1 AS i, float8('1.5') AS f, bool('true') AS b, pg_typeof(1) AS t", "SELECT 8 AS i, CAST(1.5 AS DOUBLE) AS f, true AS b, 'integer' AS t")
dialect("fn_random", "SELECT n_nationkey, random() >= 0 AND random() < 1 AS ok, gen_random_uuid() IS NOT NULL AS u FROM nation", "SELECT n_nationkey, true AS ok, true AS u FROM nation")

# Over columns with NULLs: customers whose segment or balance is left out.
_C = "(SELECT c_custkey AS k, c_name AS name, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS nat FROM customer)"
dialect("fn_typeof", f"SELECT k, pg_typeof(k) AS a, pg_typeof(seg) AS b, pg_typeof(bal) AS c, pg_typeof(ARRAY[nat]) AS d, pg_typeof(nat::numeric(9,2)) AS e, pg_typeof(nat IS NULL) AS f, pg_typeof(TIMESTAMP '2024-01-01 00:00:00') AS g, pg_typeof(DATE '2024-01-01') AS h FROM {_C} c",
        f"SELECT k, 'bigint' AS a, 'text' AS b, 'double precision' AS c, 'integer[]' AS d, 'numeric' AS e, 'boolean' AS f, 'timestamp without time zone' AS g, 'date' AS h FROM {_C} c")
dialect("fn_regexp_groups", f"SELECT k, (regexp_match(name, '^(.)[a-z]*#0*([0-9]+)$'))[1] AS one, (regexp_match(name, '^(.)[a-z]*#0*([0-9]+)$'))[2] AS two, array_length(regexp_match(name, '(o)(m)(e)'), 1) AS n, (regexp_matches(seg, '[AEIOU]'))[1] AS whole, regexp_match(seg, 'xyz') IS NULL AS none, substring(seg FROM '[AEIOU](.)') AS part, name ~* 'CUSTOMER' AS ci, seg !~ 'A' AS nota FROM {_C} c",
        f"SELECT k, regexp_extract(name, '^(.)[a-z]*#0*([0-9]+)$', 1) AS one, regexp_extract(name, '^(.)[a-z]*#0*([0-9]+)$', 2) AS two, 3 AS n, CASE WHEN regexp_matches(seg, '[AEIOU]') THEN regexp_extract(seg, '[AEIOU]') END AS whole, true AS none, CASE WHEN regexp_matches(seg, '[AEIOU](.)') THEN regexp_extract(seg, '[AEIOU](.)', 1) END AS part, true AS ci, NOT regexp_matches(seg, 'A') AS nota FROM {_C} c")
dialect("fn_int_division", f"SELECT k, k / 7 AS a, (nat - 20) / 3 AS b, k / nullif(nat, 0) AS c, c.k / 2.0::float8 AS d, bal / 2 AS e FROM {_C} c", f"SELECT k, k // 7 AS a, CAST(trunc((nat - 20) / 3) AS BIGINT) AS b, k // nullif(nat, 0) AS c, k / 2.0::DOUBLE AS d, bal / 2 AS e FROM {_C} c")
dialect("fn_array_literal", f"SELECT k, ('{{5,NULL,7}}'::int[])[3] AS a, nat = ANY('{{1,2,3}}'::int[]) AS b, array_length('{{\"x, y\",z}}'::text[], 1) AS c, ('{{\"x, y\",z}}'::text[])[1] AS d, array_to_string(ARRAY[nat] || 9, '-') AS e, array_to_string(8 || ARRAY[nat, 1], '-') AS f, array_length('{{}}'::int[], 1) AS g, (ARRAY[nat, 2, 3])[2:3] = ARRAY[2, 3] AS h FROM {_C} c",
        f"SELECT k, 7 AS a, nat IN (1, 2, 3) AS b, 2 AS c, 'x, y' AS d, concat_ws('-', nat, 9) AS e, concat_ws('-', 8, nat, 1) AS f, CAST(NULL AS INTEGER) AS g, true AS h FROM {_C} c")
dialect("fn_jsonb_minus", "SELECT event_id, (props::jsonb - 'k')::text AS none, (jsonb_set(props::jsonb, '{z}', '1') - ARRAY['k', 'q'])::text AS z, (jsonb_set(props::jsonb, '{z}', '1') - '{k,z}'::text[])::text AS gone, ('[1,2,3]'::jsonb - 1)::text AS two, (jsonb_set(nullif(props, '{\"k\": 3}')::jsonb, '{a,b}', '5') -> 'a' ->> 'b') AS deep FROM events",
        "SELECT event_id, '{}' AS none, '{\"z\":1}' AS z, '{}' AS gone, '[1,3]' AS two, CASE WHEN props <> '{\"k\": 3}' THEN '5' END AS deep FROM events")
dialect("fn_row_json", "SELECT r.r_regionkey AS k, row_to_json(r) AS j, to_json(r) ->> 'r_name' AS n FROM region r", """SELECT r_regionkey AS k, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS j, r_name AS n FROM region""")
_O = "(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS d FROM orders)"
dialect("fn_intervals", f"SELECT k, d + make_interval(years => 1, months => 2) AS a, d + make_interval(0, 0, 1, 3) AS b, d - INTERVAL '1 month 2 days' AS c, d + INTERVAL '1 hour' - INTERVAL '30 minutes' AS e, d::date - DATE '2020-01-01' AS days, d::date + 5 AS later, d + make_interval(days => 1, hours => 2, secs => 1.5) AS f FROM {_O} o",
        f"SELECT k, d + INTERVAL 14 MONTH AS a, d + INTERVAL 10 DAY AS b, d - INTERVAL 1 MONTH - INTERVAL 2 DAY AS c, d + INTERVAL 30 MINUTE AS e, CAST(date_diff('day', DATE '2020-01-01', d::date) AS INTEGER) AS days, d::date + 5 AS later, d + INTERVAL 1 DAY + INTERVAL 2 HOUR + INTERVAL 1500 MILLISECOND AS f FROM {_O} o")
dialect("fn_age", f"SELECT k, CAST(age(TIMESTAMP '2024-03-01 12:00:00', d) AS text) IS NULL AS missing, TIMESTAMP '2024-03-01 12:00:00' - (d + age(TIMESTAMP '2024-03-01 12:00:00', d)) = INTERVAL '0 days' AS adds_up, CAST(age(TIMESTAMP '2024-03-01 00:00:00', TIMESTAMP '2024-01-31 00:00:00') AS text) AS a FROM {_O} o",
        f"SELECT k, d IS NULL AS missing, CASE WHEN d IS NOT NULL THEN true END AS adds_up, '1 months 1 days' AS a FROM {_O} o")
dialect("fn_time_zones", f"SELECT k, (d AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS a, (d AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS b, timezone('Europe/Berlin', timezone('UTC', d)) AS c, (TIMESTAMP '2024-01-01 00:00:00' AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS e FROM {_O} o",
        f"SELECT k, (d AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS a, d + INTERVAL 9 HOUR AS b, (d AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS c, TIMESTAMP '2024-01-01 05:00:00' AS e FROM {_O} o")
dialect("fn_to_char", f"SELECT k, to_char(d, 'YYYY/MM/DD HH24:MI:SS') AS a, to_char(d, 'DD Mon YY') AS b, to_date(to_char(d, 'DD.MM.YYYY'), 'DD.MM.YYYY') AS c FROM {_O} o", f"SELECT k, strftime(d, '%Y/%m/%d %H:%M:%S') AS a, strftime(d, '%d %b %y') AS b, d::date AS c FROM {_O} o")
dialect("fn_now", "SELECT r_regionkey AS k, now() = transaction_timestamp() AS a, clock_timestamp() >= statement_timestamp() AS b, current_date = now()::date AS c, length(current_time) > 7 AS d, localtimestamp <= now()::timestamp + INTERVAL '1 day' AS e, length(timeofday()) > 20 AS f, current_timestamp > TIMESTAMP '2020-01-01 00:00:00' AS g FROM region", "SELECT r_regionkey AS k, true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, true AS g FROM region")
dialect("fn_casts", f"SELECT k, bal::int AS a, (nat / 2.0)::int AS b, (numeric '1.5' + 1)::numeric(20,4) AS c, int '7' AS d, bool 't' AS e, (k::text || '.5')::float8 AS f, initcap(lower(seg) || '-and more') AS g, quote_ident(name) AS h, quote_ident('plain') AS i FROM {_C} c",
        f"SELECT k, CAST(round_even(bal, 0) AS INTEGER) AS a, CAST(round(nat / 2.0, 0) AS INTEGER) AS b, CAST(2.5 AS DECIMAL(20,4)) AS c, 7 AS d, true AS e, k + 0.5::DOUBLE AS f, seg[1] || lower(seg[2:]) || '-And More' AS g, '\"' || name || '\"' AS h, 'plain' AS i FROM {_C} c")
dialect("fn_strings_of_columns", f"SELECT k, left(seg, -2) AS a, right(seg, 3) AS b, overlay(name PLACING 'X' FROM 2 FOR 3) AS c, octet_length(seg) AS d, bit_length(name) AS e, quote_literal(seg) AS f, quote_nullable(seg) AS g, format('%s=%s', k, seg) AS h, position('a' IN lower(seg)) AS i, btrim(seg, 'AE') AS j, chr(64 + nat) AS l, array_to_string(string_to_array(seg, NULL), '.') AS m FROM {_C} c",
        f"SELECT k, left(seg, -2) AS a, right(seg, 3) AS b, name[1] || 'X' || name[5:] AS c, CAST(length(seg) AS INTEGER) AS d, CAST(8 * length(name) AS INTEGER) AS e, chr(39) || seg || chr(39) AS f, coalesce(chr(39) || seg || chr(39), 'NULL') AS g, k || '=' || coalesce(seg, '') AS h, CAST(instr(lower(seg), 'a') AS INTEGER) AS i, trim(seg, 'AE') AS j, chr(64 + nat) AS l, array_to_string(string_split(seg, ''), '.') AS m FROM {_C} c")
dialect("fn_bytes_of_columns", f"SELECT k, encode(seg::bytea, 'hex') AS h, encode(name::bytea, 'base64') AS b, get_byte(name::bytea, 1) AS g, encode(set_byte(seg::bytea, 0, 65), 'hex') AS s, CAST(decode(encode(seg::bytea, 'hex'), 'hex') AS text) AS d FROM {_C} c", f"SELECT k, lower(hex(seg)) AS h, base64(name::blob) AS b, 117 AS g, '41' || lower(hex(seg[2:])) AS s, seg AS d FROM {_C} c")
dialect("fn_unnest_scalar", "SELECT r_regionkey AS k, unnest(ARRAY[r_regionkey, 10]) AS v FROM region", "SELECT r_regionkey AS k, unnest([r_regionkey, 10]) AS v FROM region")
dialect("fn_catalog", "SELECT r_regionkey AS k, length(version()) > 5 AS a, pg_is_in_recovery() AS b, pg_backend_pid() AS c, obj_description(1) IS NULL AS d, pg_get_constraintdef(1) IS NULL AS e, pg_encoding_to_char(6) AS f, txid_current() > 0 AS g, pg_postmaster_start_time() <= now() AS h FROM region", "SELECT r_regionkey AS k, true AS a, false AS b, 1 AS c, true AS d, true AS e, 'UTF8' AS f, true AS g, true AS h FROM region")
dialect("fn_privileges", "SELECT r_regionkey AS k, pg_try_advisory_lock(r_regionkey) AS a, has_table_privilege('region', 'SELECT') AS b, pg_has_role('x', 'USAGE') AS c, pg_table_size('region') AS d, pg_size_pretty(pg_database_size('x')) AS e FROM region", "SELECT r_regionkey AS k, true AS a, true AS b, true AS c, CAST(0 AS BIGINT) AS d, '0 bytes' AS e FROM region")
dialect("agg_first_last", "SELECT s_nationkey AS n, first(s_nationkey) AS a, last(s_nationkey) AS b, first_value(s_nationkey) AS c, last_value(s_nationkey) AS d FROM supplier GROUP BY s_nationkey", "SELECT s_nationkey AS n, s_nationkey AS a, s_nationkey AS b, s_nationkey AS c, s_nationkey AS d FROM supplier GROUP BY s_nationkey")
dialect("agg_json_many", "SELECT n_regionkey AS k, json_array_length(json_agg(n_name)) AS n, json_array_length(jsonb_agg(nullif(n_name, 'CHINA'))) AS m, count(*) FILTER (WHERE n_name IS NULL) AS z FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, CAST(count(*) AS INTEGER) AS n, CAST(count(*) AS INTEGER) AS m, CAST(0 AS BIGINT) AS z FROM nation GROUP BY n_regionkey")
dialect("win_aggregates", "SELECT n_nationkey AS k, array_to_string(array_agg(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), ',') AS a, bool_and(n_nationkey > 2) OVER (PARTITION BY n_regionkey) AS b, bool_or(n_nationkey > 20) OVER (PARTITION BY n_regionkey) AS c, stddev_pop(n_nationkey) OVER (PARTITION BY n_regionkey) > 0 AS d FROM nation",
        "SELECT n_nationkey AS k, array_to_string(array_agg(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), ',') AS a, bool_and(n_nationkey > 2) OVER (PARTITION BY n_regionkey) AS b, bool_or(n_nationkey > 20) OVER (PARTITION BY n_regionkey) AS c, true AS d FROM nation")
dialect("sort_nulls_spelt", "SELECT k, row_number() OVER (ORDER BY seg NULLS FIRST, k) AS a, row_number() OVER (ORDER BY seg DESC NULLS LAST, k) AS b FROM (SELECT c_custkey AS k, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) c ORDER BY seg ASC NULLS FIRST, k LIMIT 40", "SELECT k, row_number() OVER (ORDER BY seg NULLS FIRST, k) AS a, row_number() OVER (ORDER BY seg DESC NULLS LAST, k) AS b FROM (SELECT c_custkey AS k, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) c ORDER BY seg ASC NULLS FIRST, k LIMIT 40")
dialect("sort_ordinal", "SELECT n_regionkey AS r, n_name AS n FROM nation ORDER BY 1 DESC, 2 LIMIT 7", "SELECT n_regionkey AS r, n_name AS n FROM nation ORDER BY 1 DESC, 2 LIMIT 7")
