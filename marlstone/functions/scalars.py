"""PostgreSQL's scalar functions and types as Spark SQL text.

Each entry takes the rewritten argument texts.  A function that isn't here has
the same name and meaning in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .lexer import SqlError, quote

Template = Callable[[list[str]], str]

TYPES = {
    "smallint": "SMALLINT", "int2": "SMALLINT", "int": "INT", "integer": "INT", "int4": "INT", "serial": "INT", "bigint": "BIGINT", "int8": "BIGINT", "bigserial": "BIGINT", "smallserial": "SMALLINT", "serial4": "INT", "serial8": "BIGINT",
    "real": "FLOAT", "float4": "FLOAT", "float": "DOUBLE", "float8": "DOUBLE", "double": "DOUBLE", "numeric": "DECIMAL(38,10)", "decimal": "DECIMAL(38,10)", "boolean": "BOOLEAN", "bool": "BOOLEAN",
    "bytea": "BINARY", "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "oid": "BIGINT", "interval": "INTERVAL DAY TO SECOND",
}
#: Types that are only names for text here, as they have no operators.
TEXT_TYPES = frozenset("text varchar char bpchar character name uuid json jsonb time timetz xml money inet cidr macaddr macaddr8 tsvector tsquery jsonpath bit varbit point line lseg box path polygon circle int4range int8range numrange tsrange tstzrange daterange int4multirange int8multirange nummultirange tsmultirange tstzmultirange datemultirange regclass regtype regproc citext string".split())


def spark_type(base: str, args: list[str], arrays: int = 0) -> str:
    """The Spark type of a PostgreSQL type name; names that aren't known are text."""
    low = base.lower()
    if low in ("numeric", "decimal") and args:
        kind = f"DECIMAL({args[0]},{args[1] if len(args) > 1 else 0})"
    else:
        kind = TYPES.get(low, "STRING")
    for _ in range(arrays):
        kind = f"ARRAY<{kind}>"
    return kind


def array_literal(text: str, kind: str) -> str:
    """A quoted '{…}' as an array of a Spark type; in it, NULL is null and quotes and backslashes protect."""
    body = re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.S).strip()  # Spark's quoting
    if not (body.startswith("{") and body.endswith("}")):
        raise SqlError("22P02", f"malformed array literal {body!r}")
    items, at, end = [], 1, len(body) - 1
    while at < end:
        if body[at] in " ,\t\n":
            at += 1
        elif body[at] == "{":
            depth, start = 0, at
            while True:
                depth += (body[at] == "{") - (body[at] == "}")
                at += 1
                if not depth:
                    break
            items.append(array_literal(quote(body[start:at]), re.sub(r"^ARRAY<(.*)>$", r"\1", kind)))
        elif body[at] == '"':
            m = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S).match(body, at)
            if not m:
                raise SqlError("22P02", f"malformed array literal {body!r}")
            items.append(f"CAST({quote(re.sub(r'\\(.)', r'\1', m[1], flags=re.S))} AS {kind})")
            at = m.end()
        else:
            m = re.compile(r"[^,{}]+").match(body, at)
            if not m:
                raise SqlError("22P02", f"malformed array literal {body!r}")
            x = m[0].strip()
            items.append(f"CAST(NULL AS {kind})" if x.upper() == "NULL" else f"CAST({quote(x)} AS {kind})")
            at = m.end()
    return f"array({', '.join(items)})" if items else f"CAST(array() AS ARRAY<{kind}>)"


def interval_of(parts: list[str]) -> str:
    """Years, months, weeks, days, hours, minutes and seconds as the narrowest of Spark's interval types."""
    years, months, weeks, days, hours, minutes, seconds = parts
    if years == months == "0":
        return f"make_dt_interval({days if weeks == '0' else f'({weeks}) * 7 + ({days})'}, {hours}, {minutes}, {seconds})"
    if all(p == "0" for p in parts[2:]):
        return f"make_ym_interval({years}, {months})"
    return f"make_interval({', '.join(parts)})"


def _age(a: list[str]) -> str:
    """Whole months between, then what is left over in days and less; an interval in Spark's mixed type."""
    x, y = a if len(a) > 1 else ["current_date()", a[0]]
    x, y = (f"CAST({v} AS TIMESTAMP_NTZ)" for v in (x, y))

    def later(p: str, q: str) -> str:
        months = f"((year({p}) - year({q})) * 12 + month({p}) - month({q}))"
        whole = f"({months} - CASE WHEN {q} + make_ym_interval(0, {months}) > {p} OR (day({q}) > day({p}) AND {q} + make_ym_interval(0, {months}) >= {p}) THEN 1 ELSE 0 END)"
        rest = f"({p} - ({q} + make_ym_interval(0, {whole})))"
        return f"make_interval(0, {whole}, 0, CAST(extract(DAY FROM {rest}) AS INT), CAST(extract(HOUR FROM {rest}) AS INT), CAST(extract(MINUTE FROM {rest}) AS INT), extract(SECOND FROM {rest}))"

    return f"CASE WHEN {x} >= {y} THEN {later(x, y)} ELSE - {later(y, x)} END"


def _groups(a: list[str]) -> str:
    """The groups of the first match (the whole match of a pattern without any), as an array; null if there is none."""
    flags = a[2].strip("'") if len(a) > 2 else ""
    pattern = f"concat('(?i)', {a[1]})" if "i" in flags else a[1]
    n = re.compile(re.sub(r"\\(.)", r"\1", a[1][1:-1], flags=re.S)).groups if a[1].startswith("'") else 0
    found = [f"regexp_extract({a[0]}, {pattern}, {i})" for i in (range(1, n + 1) if n else [0])]
    return f"CASE WHEN {a[0]} RLIKE {pattern} THEN array({', '.join(found)}) END"


_NAMES = {"int": "integer", "string": "text", "double": "double precision", "float": "real", "timestamp_ntz": "timestamp without time zone", "timestamp": "timestamp with time zone", "binary": "bytea", "void": "unknown"}


def _typeof(x: str) -> str:
    """PostgreSQL's name of a value's type."""
    base = f"regexp_replace(regexp_replace(typeof({x}), '^(?:array<)+|>+$', ''), '\\\\(.*', '')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items())
    return f"concat(CASE WHEN typeof({x}) LIKE 'interval%' THEN 'interval' WHEN typeof({x}) LIKE 'struct%' THEN 'record' WHEN {base} = 'decimal' THEN 'numeric' ELSE CASE {base} {cases} ELSE {base} END END, CASE WHEN typeof({x}) LIKE 'array<%' THEN '[]' ELSE '' END)"


def _pg_regex(a: list[str]) -> str:
    """All matches with the flag g, else the first one only; back-references are \\1 in PostgreSQL, $1 here."""
    flags = a[3].strip("'") if len(a) > 3 else ""
    pattern = f"concat('(?i)', {a[1]})" if "i" in flags else a[1]
    new = re.sub(r"\\\\(\d)", r"$\1", a[2])
    if "g" in flags:
        return f"regexp_replace({a[0]}, {pattern}, {new})"
    at, match = f"regexp_instr({a[0]}, {pattern})", f"regexp_substr({a[0]}, {pattern})"
    return f"CASE WHEN {at} > 0 THEN concat(substring({a[0]}, 1, {at} - 1), regexp_replace({match}, {pattern}, {new}), substring({a[0]}, {at} + length({match}))) ELSE {a[0]} END"


def _dates(f: str, a: str) -> str:
    f = f.strip("'").lower().rstrip("s") if f.strip("'").lower() not in ("microseconds", "milliseconds") else f.strip("'").lower()
    year = f"year({a})"
    whole = {"dow": f"(dayofweek({a}) - 1)", "isodow": f"(weekday({a}) + 1)", "century": f"CAST(floor(({year} + 99) / 100) AS INT)", "decade": f"CAST(floor({year} / 10) AS INT)", "millennium": f"CAST(floor(({year} + 999) / 1000) AS INT)", "doy": f"dayofyear({a})", "isoyear": f"extract(YEAROFWEEK FROM {a})", "year": year, "quarter": f"quarter({a})", "month": f"month({a})", "week": f"weekofyear({a})", "day": f"dayofmonth({a})", "hour": f"hour({a})", "minute": f"minute({a})"}
    if f in whole:
        return whole[f]
    micros = f"CAST(extract(SECOND FROM {a}) * 1000000 AS BIGINT)"
    fine = {"epoch": f"(unix_micros(CAST({a} AS TIMESTAMP)) / 1000000D)", "second": f"CAST(extract(SECOND FROM {a}) AS DOUBLE)", "milliseconds": f"({micros} / 1000D)", "microseconds": micros}
    if f in fine:
        return fine[f]
    raise SqlError("22023", f"unit {f!r} isn't known")


def _trunc(a: list[str]) -> str:
    f, x = a[0].strip("'").lower(), a[1]
    if f in ("decade", "century", "millennium"):
        n = {"decade": 10, "century": 100, "millennium": 1000}[f]
        first = f"year({x}) - year({x}) % 10" if n == 10 else f"CAST(floor((year({x}) - 1) / {n}) * {n} + 1 AS INT)"
        return f"CAST(make_date({first}, 1, 1) AS TIMESTAMP_NTZ)"
    return f"CAST(date_trunc({a[0]}, {x}) AS TIMESTAMP_NTZ)"


_FORMATS = (("HH24", "HH"), ("HH12", "hh"), ("YYYY", "yyyy"), ("YY", "yy"), ("Month", "MMMM"), ("Mon", "MMM"), ("MM", "MM"), ("DD", "dd"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("HH", "hh"), ("Day", "EEEE"), ("Dy", "EEE"), ("AM", "a"), ("PM", "a"), ("TZ", "z"))


def _format(literal: str) -> str:
    out, rest = "", literal[1:-1]
    while rest:
        for pg, java in _FORMATS:
            if rest.startswith(pg):
                out, rest = out + java, rest[len(pg) :]
                break
        else:
            out, rest = out + (rest[0] if not rest[0].isalpha() else f"\\'{rest[0]}\\'"), rest[1:]
    return f"'{out}'"


def _slice(a: list[str]) -> str:
    """Positions before the first count against the length, as in the standard; a quoted second argument is a pattern."""
    if len(a) == 2 and a[1].startswith("'"):
        return f"try_element_at({_groups(a)}, 1)"
    if len(a) == 2:
        return f"substring({a[0]}, greatest({a[1]}, 1))"
    return f"substring({a[0]}, greatest({a[1]}, 1), greatest({a[2]} + least({a[1]}, 1) - 1, 0))"


def _pg_format(a: list[str]) -> str:
    parts, i, args = [], 0, a[1:]
    body = a[0][1:-1]
    for piece in re.split(r"(%[sIL%])", body):
        if piece == "%%":
            parts.append("'%'")
        elif re.fullmatch("%[sIL]", piece):
            x = f"CAST({args[i]} AS STRING)"
            i += 1
            parts.append({"s": f"coalesce({x}, '')", "I": f"concat('\"', {x}, '\"')", "L": f"coalesce(concat('\\'', replace({x}, '\\'', '\\'\\''), '\\''), 'NULL')"}[piece[1]])
        elif piece:
            parts.append(f"'{piece}'")
    return f"concat({', '.join(parts) or chr(39) * 2})"


def _json_object(a: list[str]) -> str:
    pairs = ", ".join(f"{k}, {v}" for k, v in zip(a[::2], a[1::2]))
    return f"to_json(named_struct({pairs}), map('ignoreNullFields', 'false'))" if a else "'{}'"


FUNCTIONS: dict[str, Template] = {
    "concat": lambda a: f"concat_ws('', {', '.join(a)})",
    "char_length": lambda a: f"length({a[0]})",
    "character_length": lambda a: f"length({a[0]})",
    "substr": _slice,
    "substring": _slice,
    "left": lambda a: f"substring({a[0]}, 1, CASE WHEN {a[1]} >= 0 THEN {a[1]} ELSE greatest(length({a[0]}) + {a[1]}, 0) END)",
    "right": lambda a: f"CASE WHEN {a[1]} >= 0 THEN right({a[0]}, {a[1]}) ELSE substring({a[0]}, 1 - {a[1]}) END",
    "btrim": lambda a: f"trim(BOTH {a[1]} FROM {a[0]})" if len(a) > 1 else f"trim({a[0]})",
    "ltrim": lambda a: f"trim(LEADING {a[1]} FROM {a[0]})" if len(a) > 1 else f"ltrim({a[0]})",
    "rtrim": lambda a: f"trim(TRAILING {a[1]} FROM {a[0]})" if len(a) > 1 else f"rtrim({a[0]})",
    "strpos": lambda a: f"instr({a[0]}, {a[1]})",
    "position": lambda a: f"instr({a[0]}, {a[1]})",
    "string_to_array": lambda a: f"split({a[0]}, '')" if a[1] == "NULL" else f"split({a[0]}, concat('\\\\Q', {a[1]}, '\\\\E'))",
    "array_to_string": lambda a: f"array_join({', '.join(a)})",
    "chr": lambda a: f"decode(unhex(lpad(hex({a[0]}), 8, '0')), 'UTF-32')",
    "quote_ident": lambda a: f"CASE WHEN {a[0]} RLIKE '^[a-z_][a-z0-9_$]*$' THEN {a[0]} ELSE concat('\"', replace({a[0]}, '\"', '\"\"'), '\"') END",
    "quote_literal": lambda a: f"concat('\\'', replace({a[0]}, '\\'', '\\'\\''), '\\'')",
    "quote_nullable": lambda a: f"coalesce(concat('\\'', replace({a[0]}, '\\'', '\\'\\''), '\\''), 'NULL')",
    "format": _pg_format,
    "regexp_replace": _pg_regex,
    "regexp_match": _groups,
    "regexp_matches": _groups,
    "encode": lambda a: f"lower(hex({a[0]}))" if a[1].lower() == "'hex'" else f"base64({a[0]})",
    "decode": lambda a: f"unhex({a[0]})" if a[1].lower() == "'hex'" else f"unbase64({a[0]})",
    "get_byte": lambda a: f"CAST(conv(hex(substring({a[0]}, {a[1]} + 1, 1)), 16, 10) AS INT)",
    "set_byte": lambda a: f"unhex(concat(hex(substring({a[0]}, 1, {a[1]})), lpad(hex({a[2]}), 2, '0'), hex(substring({a[0]}, {a[1]} + 2))))",
    "bytea": lambda a: f"CAST({a[0]} AS BINARY)",
    "pow": lambda a: f"power({a[0]}, {a[1]})",
    "log": lambda a: f"log10({a[0]})" if len(a) == 1 else f"log({a[0]}, {a[1]})",
    "trunc": lambda a: f"(CASE WHEN {a[0]} < 0 THEN ceil({', '.join(a)}) ELSE floor({', '.join(a)}) END)",
    "random": lambda a: "rand()",
    "setseed": lambda a: "CAST(NULL AS STRING)",
    "div": lambda a: f"({a[0]} div {a[1]})",
    "num_nulls": lambda a: "(" + " + ".join(f"CAST(({x}) IS NULL AS INT)" for x in a) + ")",
    "num_nonnulls": lambda a: "(" + " + ".join(f"CAST(({x}) IS NOT NULL AS INT)" for x in a) + ")",
    "pg_typeof": lambda a: _typeof(a[0]),
    "initcap": lambda a: f"array_join(transform(split(lower({a[0]}), '(?<=[^\\\\p{{L}}\\\\p{{N}}])'), w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), '')",
    "format_type": lambda a: f"CAST({a[0]} AS STRING)",
    "now": lambda a: "current_timestamp()",
    "transaction_timestamp": lambda a: "current_timestamp()",
    "statement_timestamp": lambda a: "current_timestamp()",
    "clock_timestamp": lambda a: "current_timestamp()",
    "timeofday": lambda a: "date_format(current_timestamp(), 'EEE MMM dd HH:mm:ss.SSSSSS yyyy z')",
    "date_trunc": _trunc,
    "date_part": lambda a: _dates(a[0], a[1]),
    "extract": lambda a: _dates(a[0], a[1]),
    "age": _age,
    "to_char": lambda a: f"date_format({a[0]}, {_format(a[1])})",
    "to_timestamp": lambda a: f"timestamp_seconds({a[0]})" if len(a) == 1 else f"to_timestamp({a[0]}, {_format(a[1])})",
    "to_date": lambda a: f"to_date({a[0]}, {_format(a[1])})" if len(a) > 1 else f"to_date({a[0]})",
    "make_interval": lambda a: interval_of([*a, *["0"] * 7][:7]),
    "timezone": lambda a: f"convert_timezone('UTC', {a[0]}, CAST({a[1]} AS TIMESTAMP_NTZ))",
    "array_length": lambda a: f"nullif(size({a[0]}), 0)",
    "cardinality": lambda a: f"size({a[0]})",
    "array_position": lambda a: f"CAST(nullif(array_position({a[0]}, {a[1]}), 0) AS INT)",
    "array_prepend": lambda a: f"array_prepend({a[1]}, {a[0]})",
    "array_cat": lambda a: f"concat({a[0]}, {a[1]})",
    "json_build_object": _json_object,
    "jsonb_build_object": _json_object,
    "json_build_array": lambda a: f"concat('[', concat_ws(',', {', '.join(_json_value(x) for x in a)}), ']')" if a else "'[]'",
    "jsonb_build_array": lambda a: FUNCTIONS["json_build_array"](a),
    "row_to_json": lambda a: f"to_json({a[0]}, map('ignoreNullFields', 'false'))",
    "to_json": lambda a: _json_value(a[0]),
    "to_jsonb": lambda a: _json_value(a[0]),
    "jsonb_set": lambda a: f"pg_jsonb_set({', '.join([*a, 'true'][:4])})",
    "jsonb_set_lax": lambda a: f"pg_jsonb_set({', '.join([*a, 'true'][:4])})",
    "json_array_length": lambda a: f"json_array_length({a[0]})",
    "jsonb_array_length": lambda a: f"json_array_length({a[0]})",
    "jsonb_typeof": lambda a: f"pg_json_typeof({a[0]})",
    "json_typeof": lambda a: f"pg_json_typeof({a[0]})",
    "gen_random_uuid": lambda a: "uuid()",
    "uuid_generate_v4": lambda a: "uuid()",
    "every": lambda a: f"bool_and({a[0]})",
    "array_agg": lambda a: f"nullif(collect_list({a[0]}), array())",
    "json_agg": lambda a: f"concat('[', array_join(collect_list({_json_value(a[0])}), ','), ']')",
    "jsonb_agg": lambda a: f"concat('[', array_join(collect_list({_json_value(a[0])}), ','), ']')",
    "json_object_agg": lambda a: _object_agg(a),
    "jsonb_object_agg": lambda a: _object_agg(a),
    "first": lambda a: f"first({a[0]}, true)",
    "last": lambda a: f"last({a[0]}, true)",
    "unnest": lambda a: f"explode({a[0] if len(a) == 1 else 'concat(' + ', '.join(f'coalesce({x}, array())' for x in a) + ')'})",
    "json_array_elements": lambda a: f"explode(CAST(CAST(parse_json({a[0]}) AS ARRAY<VARIANT>) AS ARRAY<STRING>))",
    "jsonb_array_elements": lambda a: f"explode(CAST(CAST(parse_json({a[0]}) AS ARRAY<VARIANT>) AS ARRAY<STRING>))",
    "json_array_elements_text": lambda a: f"explode(CAST(CAST(parse_json({a[0]}) AS ARRAY<VARIANT>) AS ARRAY<STRING>))",
    "jsonb_array_elements_text": lambda a: f"explode(CAST(CAST(parse_json({a[0]}) AS ARRAY<VARIANT>) AS ARRAY<STRING>))",
    "generate_series": lambda a: _series(a),
    "version": lambda a: "'PostgreSQL 16 compatible, on Spark'",
    "pg_backend_pid": lambda a: "1",
    "txid_current": lambda a: "1L",
    "pg_current_xact_id": lambda a: "1L",
    "pg_is_in_recovery": lambda a: "false",
    "pg_postmaster_start_time": lambda a: "current_timestamp()",
    "pg_conf_load_time": lambda a: "current_timestamp()",
    "pg_sleep": lambda a: "''",
    "pg_size_pretty": lambda a: f"concat({a[0]}, ' bytes')",
    "pg_encoding_to_char": lambda a: "'UTF8'",
    "l2_distance": lambda a: _zip_sum("(x - y) * (x - y)", a, "sqrt({})"),
    "inner_product": lambda a: _zip_sum("x * y", a, "{}"),
    "cosine_distance": lambda a: f"(1 - try_divide({_zip_sum('x * y', a, '{}')}, sqrt({_zip_sum('x * y', [a[0], a[0]], '{}')} * {_zip_sum('x * y', [a[1], a[1]], '{}')})))",
}
for _n in ("pg_advisory_lock", "pg_advisory_xact_lock", "pg_advisory_unlock", "pg_try_advisory_lock", "pg_try_advisory_xact_lock", "pg_advisory_unlock_all", "has_table_privilege", "has_schema_privilege", "has_database_privilege", "has_column_privilege", "has_any_column_privilege", "has_function_privilege", "has_sequence_privilege", "pg_has_role"):
    FUNCTIONS[_n] = lambda a: "true"
for _n in ("obj_description", "col_description", "shobj_description", "pg_get_constraintdef", "pg_get_expr", "pg_get_indexdef", "pg_get_serial_sequence"):
    FUNCTIONS[_n] = lambda a: "CAST(NULL AS STRING)"
for _n in ("pg_relation_size", "pg_total_relation_size", "pg_database_size", "pg_table_size", "pg_indexes_size"):
    FUNCTIONS[_n] = lambda a: "0L"
for _n, _t in (("int2", "SMALLINT"), ("int4", "INT"), ("int8", "BIGINT"), ("float4", "FLOAT"), ("float8", "DOUBLE"), ("numeric", "DECIMAL(38,10)"), ("bool", "BOOLEAN"), ("text", "STRING")):
    FUNCTIONS[_n] = lambda a, t=_t: f"CAST({a[0]} AS {t})"


def _json_value(x: str) -> str:
    """x as JSON text: to_json of a one-field struct, without the braces around it."""
    return f"coalesce(regexp_replace(to_json(struct({x} AS v)), '^\\\\{{\"v\":|\\\\}}$', ''), 'null')".replace("coalesce(regexp_replace(", "coalesce(nullif(regexp_replace(").replace(", ''), 'null')", ", ''), '{'), 'null')")


def _object_agg(a: list[str]) -> str:
    return f"to_json(map_from_entries(collect_list(CASE WHEN {a[0]} IS NOT NULL THEN struct({a[0]}, {a[1]}) END)), map('ignoreNullFields', 'false'))"


def _series(a: list[str]) -> str:
    lo, hi, step = a[0], a[1], a[2] if len(a) > 2 else "1"
    empty = f"CASE WHEN ({step}) = 0 THEN raise_error('22023: step size cannot be zero') WHEN (({hi}) - ({lo})) * sign({step}) >= 0 THEN sequence({lo}, {hi}, {step}) ELSE array() END"
    return f"explode({empty})"


def _zip_sum(body: str, a: list[str], outer: str) -> str:
    pair = f"zip_with({a[0]}, {a[1]}, (p, q) -> named_struct('x', CAST(p AS DOUBLE), 'y', CAST(q AS DOUBLE)))"
    body = body.replace("x", "e.x").replace("y", "e.y")
    return outer.format(f"aggregate({pair}, 0D, (s, e) -> s + {body})")  # null if one is longer


CONSTANTS = {
    "current_timestamp": "current_timestamp()", "current_date": "current_date()", "current_time": "date_format(current_timestamp(), 'HH:mm:ss.SSSSSS')", "localtime": "date_format(current_timestamp(), 'HH:mm:ss.SSSSSS')", "localtimestamp": "localtimestamp()",
    "current_user": "current_user()", "session_user": "current_user()", "user": "current_user()", "current_role": "current_user()",
}


def json_path(path: str) -> str:
    """A PostgreSQL path literal '{a,0,b}' as a JSON path literal."""
    steps = [p.strip().strip('"') for p in path.strip("{}").split(",") if p.strip()]
    return quote("$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in steps))
