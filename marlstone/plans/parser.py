"""A recursive-descent parser from PostgreSQL-flavoured SQL to Spark SQL.

Queries come out as Spark SQL text, with each table name passed to a resolver
(which answers with a view name).  Other statements come out as `Statement`s
whose parts are already Spark SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..functions import scalars
from ..functions.lexer import SqlError, Token, name, quote, tokens, unquote


@dataclass
class Statement:
    kind: str
    parts: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, key: str) -> Any:
        try:
            return self.__dict__["parts"][key]
        except KeyError:
            raise AttributeError(key) from None


@dataclass
class Recursive:
    """A recursive CTE with UNION (distinct), to be run as a fixpoint before the query."""

    name: str
    columns: list[str]
    base: str
    step: str


CLAUSES = frozenset("FROM WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH UNION INTERSECT EXCEPT WINDOW ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL RETURNING SET VALUES WHEN THEN ELSE END AND OR NOT AS ASC DESC NULLS FOR LATERAL IS IN BETWEEN LIKE ILIKE SIMILAR ROWS RANGE PARTITION FILTER OVER WITHIN CONFLICT DO WITH".split())
#: Binding powers, loosest first.
OR, AND, NOT, COMPARE, LIKE, OTHER, CONCAT, ADD, MULTIPLY, POWER, UNARY, JSON, CAST = range(1, 14)
BINARY = {"=": COMPARE, "<>": COMPARE, "!=": COMPARE, "<": COMPARE, ">": COMPARE, "<=": COMPARE, ">=": COMPARE, "||": CONCAT, "+": ADD, "-": ADD, "*": MULTIPLY, "/": MULTIPLY, "%": MULTIPLY, "^": POWER, "->": JSON, "->>": JSON, "#>": JSON, "#>>": JSON, "::": CAST, "[": CAST, "&&": OTHER, "@>": OTHER, "<@": OTHER, "?": OTHER, "?|": OTHER, "?&": OTHER, "~": OTHER, "~*": OTHER, "!~": OTHER, "!~*": OTHER, "~~": LIKE, "!~~": LIKE, "~~*": LIKE, "!~~*": LIKE, "<->": OTHER, "<=>": OTHER, "<#>": OTHER}


#: Kinds of numbers, the wider ones last.
NUMBERS = {"int": 1, "bigint": 1, "smallint": 1, "tinyint": 1, "decimal": 2, "float": 3, "double": 3}
RETURNS = {
    "count": "bigint", "length": "int", "char_length": "int", "strpos": "int", "ascii": "int", "now": "timestamp", "clock_timestamp": "timestamp", "statement_timestamp": "timestamp", "transaction_timestamp": "timestamp", "to_timestamp": "timestamp", "make_date": "date", "to_date": "date",
    "array_append": "array", "array_prepend": "array", "array_cat": "array", "string_to_array": "array", "regexp_match": "array", "sqrt": "double", "power": "double", "random": "double", "cardinality": "int", "array_length": "int",
    "jsonb_set": "json", "jsonb_set_lax": "json", "json_build_object": "json", "jsonb_build_object": "json", "json_build_array": "json", "jsonb_build_array": "json", "to_jsonb": "json",
}


class Parser:
    def __init__(self, sql: str, resolve: Callable[[str], str] = name, params: list | None = None, setting: Callable[[str], str | None] | None = None, call: Callable[[str, list[str]], str | None] | None = None, types: Callable[[str], dict[str, str]] | None = None):
        self.sql, self.all, self.i = sql, tokens(sql), 0
        #: Column types by table name; what is known of the tables in scope, by alias; and of texts that were made.
        self.types, self.scopes, self.kinds = types, [], {}
        #: Derived tables by where they begin: where they end, their text and their columns' types.
        self.derived: dict[int, tuple[int, str, dict[str, str] | None]] = {}
        self.columns: dict[str, str] | None = None
        self.cte_columns: dict[str, dict[str, str] | None] = {}
        self.resolve, self.params, self.setting, self.call = resolve, params, setting, call
        self.recursive: list[Recursive] = []
        self.ctes: list[set[str]] = []
        self.row_items: dict[str, list[str]] = {}
        self.last_type = ""

    # Tokens

    @property
    def t(self) -> Token:
        return self.all[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.all[min(self.i + n, len(self.all) - 1)]

    def next(self) -> Token:
        t = self.t
        self.i += t.kind != "end"
        return t

    def at(self, *words: str) -> bool:
        return all((x := self.all[min(self.i + k, len(self.all) - 1)]).upper == w or (x.kind == "op" and x.text == w) for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError("42601", f"expected {' '.join(words)} near {self.t.text!r} at {self.t.at}")

    def identifier(self) -> str:
        t = self.next()
        if t.kind == "word":
            return t.text.lower()
        if t.kind == "quoted":
            return t.text[1:-1].replace('""', '"')
        raise SqlError("42601", f"expected a name near {t.text!r} at {t.at}")

    def names(self) -> list[str]:
        """A parenthesised list of names."""
        self.need("(")
        out = [self.identifier()]
        while self.take(","):
            out.append(self.identifier())
        self.need(")")
        return out

    def table_name(self) -> str:
        parts = [self.identifier()]
        while self.take("."):
            parts.append(self.identifier())
        return ".".join(parts[1:] if len(parts) > 1 and parts[0] in ("public",) else parts)

    def source(self, table: str) -> str:
        if any(table in level for level in self.ctes):
            return name(table)
        return self.resolve(table)

    def literal(self) -> str:
        t = self.next()
        if t.kind == "string":
            return unquote(t.text)
        if t.kind == "param":
            return str(self._param(t))
        return t.text

    def _param(self, t: Token) -> Any:
        n = int(t.text[1:])
        if self.params is None or n > len(self.params) or n < 1:
            raise SqlError("08P01", f"no value for {t.text}")
        return self.params[n - 1]

    # What is known about types

    def scan_scope(self) -> dict[str, dict[str, str] | None]:
        """The tables of the FROM clause ahead, with their columns' types; None for what isn't a plain table."""
        i, depth, out = self.i, 0, {}
        while not (depth == 0 and self.all[i].upper == "FROM"):
            t = self.all[i]
            depth += (t.text in ("(", "[")) - (t.text in (")", "]")) if t.kind == "op" else 0
            if depth < 0 or t.kind == "end" or t.text == ";":
                return out
            i += 1
        mark, self.i = self.i, i + 1
        wanted = True
        while self.t.kind != "end":
            if self.t.text == "(" and self.t.kind == "op":
                known, start = None, self.i
                if wanted and self.ahead().upper in ("SELECT", "WITH"):
                    self.next()
                    known = self.derived_table()[1]
                self.i = start
                self.skip_parentheses()
                if wanted:
                    own, columns = self.alias_parts()
                    out[own or f"?{self.i}"] = dict(zip(columns, known.values())) if columns and known else None if columns else known
                    wanted = False
            elif self.t.text in (")", ";") and self.t.kind == "op" or self.t.upper in ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "OFFSET", "FETCH"):
                break
            elif self.t.text == "," or self.t.upper == "JOIN":
                self.next()
                wanted = True
            elif wanted and self.t.kind in ("word", "quoted") and self.t.upper not in ("LATERAL", "ONLY"):
                table = self.table_name()
                call = self.at("(")
                if call:
                    self.skip_parentheses()
                own, columns = self.alias_parts()
                known = None
                if any(table in level for level in self.ctes):
                    known = self.cte_columns.get(table)
                elif self.types and not call:
                    known = self.types(table)
                out[own or table.split(".")[-1]] = known if not columns else None
                wanted = False
            else:
                self.next()
        self.i = mark
        return out

    def derived_table(self) -> tuple[str, dict[str, str] | None]:
        """The query here, which is parsed once, and its columns' types."""
        start = self.i
        if start not in self.derived:
            text = self.query()
            self.derived[start] = (self.i, text, self.columns)
        self.i, text, columns = self.derived[start]
        return text, columns

    def note_columns(self, items: list[tuple[str, str | None]]) -> None:
        """Remember the types of a SELECT's columns, as far as all names are known."""
        out: dict[str, str] = {}
        for x, alias in items:
            star = re.fullmatch(r"(?:`((?:[^`]|``)+)`\.)?\*", x)
            if star:
                for own, known in self.scopes[-1].items():
                    if star[1] in (None, own):
                        if known is None:
                            self.columns = None
                            return
                        out |= known
            else:
                last = re.search(r"`((?:[^`]|``)+)`$", x)
                out[alias or (last[1] if last else x)] = self.kind(x)
        self.columns = out

    def skip_parentheses(self) -> None:
        depth = 0
        while self.t.kind != "end":
            t = self.next()
            depth += (t.text == "(") - (t.text == ")") if t.kind == "op" else 0
            if not depth:
                return

    def kind(self, text: str) -> str:
        """The type of an expression as far as it is known, in lower case; '' if it isn't."""
        if text in self.kinds:
            return self.kinds[text]
        if re.fullmatch(r"-?\d+", text):
            return "int"
        if re.fullmatch(r"-?(?:\d+\.\d*|\.\d+)", text):
            return "decimal"
        if text.startswith("'") and re.fullmatch(r"'(?:[^'\\]|\\.)*'", text, re.S):
            return "literal"
        m = re.fullmatch(r"(?:`((?:[^`]|``)+)`\.)?`((?:[^`]|``)+)`", text)
        if m:
            table, column = (x and x.replace("``", "`") for x in m.groups())
            for scope in reversed(self.scopes):
                found = [v[column] for k, v in scope.items() if v and column in v and table in (None, k)]
                if found:
                    return found[0] if len(found) == 1 else ""
                if any(v is None for k, v in scope.items() if table in (None, k)):
                    return ""
        return ""

    def known(self, text: str, kind: str) -> str:
        if kind:
            self.kinds[text] = kind
        return text

    # Expressions

    def expressions(self) -> list[str]:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    def expression(self, power: int = 0) -> str:
        left = self.prefix()
        while True:
            t = self.t
            w = t.upper
            if t.kind == "op" and t.text in BINARY and BINARY[t.text] > power:
                left = self.infix(left, self.next().text)
            elif w == "OPERATOR" and COMPARE > power:
                raise SqlError("0A000", "OPERATOR() isn't supported")
            elif w == "AND" and AND > power:
                self.next()
                left = f"({left} AND {self.expression(AND)})"
            elif w == "OR" and OR > power:
                self.next()
                left = f"({left} OR {self.expression(OR)})"
            elif w in ("IS", "ISNULL", "NOTNULL") and COMPARE > power:
                left = self.is_test(left)
            elif w in ("IN", "BETWEEN", "LIKE", "ILIKE", "SIMILAR") and LIKE > power:
                left = self.matching(left, False)
            elif w == "NOT" and self.ahead().upper in ("IN", "BETWEEN", "LIKE", "ILIKE", "SIMILAR") and LIKE > power:
                self.next()
                left = self.matching(left, True)
            elif w == "AT" and self.ahead().upper == "TIME" and CAST > power:
                self.need("AT", "TIME", "ZONE")
                left = self.in_zone(self.expression(CAST), left)
            else:
                return left

    def in_zone(self, zone: str, x: str) -> str:
        """A time with a zone as the clock there shows it; one without as the moment when it does."""
        if self.kind(x) == "timestamp":
            return self.known(f"convert_timezone('UTC', {zone}, CAST({x} AS TIMESTAMP_NTZ))", "timestamp_ntz")
        return self.known(f"CAST(convert_timezone({zone}, 'UTC', CAST({x} AS TIMESTAMP_NTZ)) AS TIMESTAMP)", "timestamp")

    def is_test(self, left: str) -> str:
        if self.take("ISNULL"):
            return f"({left} IS NULL)"
        if self.take("NOTNULL"):
            return f"({left} IS NOT NULL)"
        self.need("IS")
        no = self.take("NOT")
        if self.take("NULL"):
            return f"({left} IS {'NOT ' * no}NULL)"
        for word in ("TRUE", "FALSE", "UNKNOWN"):
            if self.take(word):
                return f"({left} IS {'NOT ' * no}{word})"
        self.need("DISTINCT", "FROM")
        return f"({left} IS {'NOT ' * no}DISTINCT FROM {self.expression(COMPARE)})"

    def matching(self, left: str, no: bool) -> str:
        word, deny = self.next().upper, "NOT " * no
        if word == "BETWEEN":
            self.take("SYMMETRIC")
            lo = self.expression(LIKE)
            self.need("AND")
            return f"({left} {deny}BETWEEN {lo} AND {self.expression(LIKE)})"
        if word == "IN":
            self.need("(")
            if self.at("SELECT") or self.at("WITH") or self.at("VALUES"):
                inner = self.query()
            else:
                inner = ", ".join(self.expressions())
            self.need(")")
            return f"({left} {deny}IN ({inner}))"
        if word == "SIMILAR":
            self.need("TO")
            pattern = self.expression(LIKE)
            return f"({deny}{left} RLIKE concat('^(?:', replace(replace({pattern}, '%', '.*'), '_', '.'), ')$'))"
        pattern = self.expression(LIKE)
        escape = f" ESCAPE {self.expression(LIKE)}" if self.take("ESCAPE") else ""
        return f"({left} {deny}{word} {pattern}{escape})"

    def infix(self, left: str, op: str) -> str:
        power = BINARY[op]
        if op == "::":
            return self.cast(left)
        if op == "[":
            i = None if self.at(":") else self.expression()
            if self.take(":"):
                j = None if self.at("]") else self.expression()
                self.need("]")
                lo = i or "1"
                return f"slice({left}, {lo}, greatest(({j or f'size({left})'}) - ({lo}) + 1, 0))"
            self.need("]")
            return f"try_element_at({left}, {i})"
        if op in ("=", "<>", "!=", "<", ">", "<=", ">=") and (self.at("ANY", "(") or self.at("SOME", "(") or self.at("ALL", "(")):
            return self.quantified(left, "<>" if op == "!=" else op)
        right = self.expression(power)
        if power == COMPARE and left in self.row_items and right in self.row_items:
            return self.compare_rows(self.row_items[left], op, self.row_items[right])
        if op in ("->", "->>"):
            return self.json_step(left, right, op == "->>")
        if op in ("#>", "#>>"):
            if not re.fullmatch(r"'\{.*\}'", right, re.S):
                raise SqlError("0A000", f"{op} needs a literal path")
            path = scalars.json_path(right[1:-1])
            return f"get_json_object({left}, {path})"
        array = lambda x: f"split(trim(BOTH '{{}}' FROM {x}), ',')" if re.fullmatch(r"'\{.*\}'", x, re.S) else x
        made: dict[str, Callable[[], str]] = {
            "^": lambda: f"power({left}, {right})",
            "||": lambda: f"({left} || {right})",
            "&&": lambda: f"arrays_overlap({array(left)}, {array(right)})",
            "@>": lambda: self.contains(left, right, array),
            "<@": lambda: self.contains(right, left, array),
            "?": lambda: f"array_contains(json_object_keys({left}), {right})",
            "?|": lambda: f"arrays_overlap(json_object_keys({left}), {array(right)})",
            "?&": lambda: f"(size(array_except({array(right)}, json_object_keys({left}))) = 0)",
            "~": lambda: f"({left} RLIKE {right})",
            "~*": lambda: f"({left} RLIKE concat('(?i)', {right}))",
            "!~": lambda: f"(NOT {left} RLIKE {right})",
            "!~*": lambda: f"(NOT {left} RLIKE concat('(?i)', {right}))",
            "~~": lambda: f"({left} LIKE {right})",
            "!~~": lambda: f"({left} NOT LIKE {right})",
            "~~*": lambda: f"({left} ILIKE {right})",
            "!~~*": lambda: f"({left} NOT ILIKE {right})",
            "<->": lambda: scalars.FUNCTIONS["l2_distance"]([left, right]),
            "<=>": lambda: scalars.FUNCTIONS["cosine_distance"]([left, right]),
            "<#>": lambda: f"(- {scalars.FUNCTIONS['inner_product']([left, right])})",
            "!=": lambda: f"({left} <> {right})",
        }
        kinds = (self.kind(left), self.kind(right))
        if op == "-" and (self.json_like(left) or kinds[0] == "json"):
            if kinds[1].startswith("array") or re.fullmatch(r"'\s*\{.*\}\s*'", right, re.S):
                keys = right if kinds[1].startswith("array") else scalars.array_literal(right, "STRING")
                return f"/*json*/pg_jsonb_minus_keys({left}, CAST({keys} AS ARRAY<STRING>))"
            return f"/*json*/pg_jsonb_minus({left}, CAST({right} AS STRING), {'true' if re.fullmatch('[0-9]+', right) else 'false'})"
        if op == "-" and kinds == ("date", "date"):
            return self.known(f"datediff({left}, {right})", "int")
        if op == "||" and (kinds[0].startswith("array") != kinds[1].startswith("array")) and all(kinds):
            return self.known(f"array_append({left}, {right})" if kinds[0].startswith("array") else f"array_prepend({right}, {left})", "array")
        numbers = [NUMBERS.get(re.sub(r"\(.*", "", k)) for k in kinds]
        if op == "/" and numbers == [1, 1]:
            return self.known(f"({left} div {right})", "bigint")
        out = made[op]() if op in made else f"({left} {op} {right})"
        if op in ("+", "-", "*", "%", "/") and all(numbers):
            self.known(out, {1: "bigint", 2: "decimal", 3: "double"}[max(numbers)])
        return out

    def cast(self, x: str) -> str:
        kind, own = self.type(), self.kind(x)
        if kind.startswith("ARRAY<") and own == "literal":
            made = f"CAST({scalars.array_literal(x, kind[6:-1])} AS {kind})"
        elif kind in ("INT", "BIGINT", "SMALLINT") and re.match("decimal|double|float", own):
            made = f"CAST({'round' if own.startswith('decimal') else 'rint'}({x}) AS {kind})"
        else:
            made = f"{'/*json*/' * (self.last_type in ('json', 'jsonb'))}CAST({x} AS {kind})"
        return self.known(made, "json" if self.last_type in ("json", "jsonb") else kind.lower())

    @staticmethod
    def json_like(text: str) -> bool:
        """Whether a text is known to be JSON: such expressions carry a mark."""
        return text.lstrip("( ").startswith("/*json*/")

    @staticmethod
    def compare_rows(a: list[str], op: str, b: list[str]) -> str:
        """Lexicographic comparison, column by column."""
        if len(a) != len(b):
            raise SqlError("42601", "rows have different numbers of columns")
        equal = [f"{x} = {y}" for x, y in zip(a, b)]
        if op == "=":
            return f"({' AND '.join(equal)})"
        if op in ("<>", "!="):
            return f"(NOT ({' AND '.join(equal)}))"
        cases = [" AND ".join([*equal[:i], f"{a[i]} {op[0] if i < len(a) - 1 else op} {b[i]}"]) for i in range(len(a))]
        return "(" + " OR ".join(f"({c})" for c in cases) + ")"

    def contains(self, a: str, b: str, array: Callable[[str], str]) -> str:
        if self.json_like(a) or self.json_like(b) or re.match(r"'\s*\{\s*\"", a) or re.match(r"'\s*(\{\s*\"|\[)", b):
            return f"pg_jsonb_contains({a}, {b})"
        return f"(size(array_except({array(b)}, {array(a)})) = 0)"

    def json_step(self, left: str, key: str, text: bool) -> str:
        if re.fullmatch(r"\d+", key):
            path = f"'$[{key}]'"
        elif re.fullmatch(r"-\d+", key):
            return "CAST(NULL AS STRING)"
        elif re.fullmatch(r"'(?:[^'\\]|\\.)*'", key):
            path = "'$[\\'" + key[1:-1].replace("\\'", "") + "\\']'"
        else:
            path = f"concat('$[\\'', {key}, '\\']')"
        got = f"get_json_object({left}, {path})"
        return self.known(got, "string") if text else self.known(f"/*json*/{got}", "json")

    def quantified(self, left: str, op: str) -> str:
        every = self.next().upper == "ALL"
        self.need("(")
        if self.at("SELECT") or self.at("WITH"):
            sub = self.query()
            self.need(")")
            if op == "=" and not every:
                return f"({left} IN ({sub}))"
            if op == "<>" and every:
                return f"({left} NOT IN ({sub}))"
            arr = f"(SELECT collect_list(c) FROM ({sub}) AS q(c))"
        else:
            arr = self.expression()
            self.need(")")
            if re.fullmatch(r"'\{.*\}'", arr, re.S):
                arr = f"split(trim(BOTH '{{}}' FROM {arr}), ',')"
        return f"{'forall' if every else 'exists'}({arr}, x__ -> {left} {op} x__)"

    def prefix(self) -> str:
        t = self.t
        if t.kind == "op":
            if self.take("("):
                return self.parenthesised()
            if t.text in "+-":
                self.next()
                return f"{t.text}{self.expression(UNARY)}" if self.t.kind == "number" else f"({t.text} {self.expression(UNARY)})"
            if t.text == "*":
                self.next()
                return "*"
        elif t.kind == "number":
            self.next()
            return t.text
        elif t.kind == "string":
            self.next()
            return quote(unquote(t.text))
        elif t.kind == "param":
            self.next()
            value = self._param(t)
            return self.known(literal(value), "array") if isinstance(value, (list, tuple)) else literal(value)
        elif t.kind in ("word", "quoted"):
            return self.word()
        raise SqlError("42601", f"unexpected {t.text!r} at {t.at}")

    def parenthesised(self) -> str:
        if self.at("SELECT") or self.at("WITH") or self.at("VALUES"):
            inner = self.query()
            self.need(")")
            return f"({inner})"
        items = self.expressions()
        self.need(")")
        out = self.known(f"({items[0]})", self.kind(items[0])) if len(items) == 1 else f"struct({', '.join(items)})"
        if len(items) > 1:
            self.row_items[out] = items
        if self.at(".") and self.ahead().kind in ("word", "quoted"):
            self.next()
            field_ = self.identifier()
            out = f"{out}.{'col' + field_[1:] if re.fullmatch(r'f[0-9]+', field_) else name(field_)}"
        return out

    def word(self) -> str:
        w = self.t.upper
        simple = {"NULL": "NULL", "TRUE": "true", "FALSE": "false"}
        if w in simple:
            self.next()
            return simple[w]
        if w == "NOT":
            self.next()
            return f"(NOT {self.expression(NOT)})"
        if w == "CASE":
            return self.case()
        if w == "CAST" and self.ahead().text == "(":
            self.need("CAST", "(")
            x = self.expression()
            self.need("AS")
            out = self.cast(x)
            self.need(")")
            return out
        if w == "EXISTS":
            self.need("EXISTS", "(")
            q = self.query()
            self.need(")")
            return f"EXISTS ({q})"
        if w == "ARRAY" and self.ahead().text == "[":
            self.need("ARRAY", "[")
            items = [] if self.at("]") else self.expressions()
            self.need("]")
            return self.known(f"array({', '.join(items)})", "array")
        if w == "ARRAY" and self.ahead().text == "(":
            self.need("ARRAY", "(")
            q = self.query()
            self.need(")")
            return f"(SELECT collect_list(c) FROM ({q}) AS q(c))"
        if w == "ROW" and self.ahead().text == "(":
            self.need("ROW", "(")
            items = [] if self.at(")") else self.expressions()
            self.need(")")
            out = f"struct({', '.join(items)})"
            self.row_items[out] = items
            return out
        if w == "INTERVAL" and self.ahead().kind == "string":
            self.next()
            return interval(unquote(self.next().text))
        if (w.lower() in scalars.TYPES or w.lower() in scalars.TEXT_TYPES) and self.ahead().kind == "string":
            self.next()
            x = quote(unquote(self.next().text))
            self.last_type = w.lower()
            mark = "/*json*/" if w in ("JSON", "JSONB") else ""
            return self.known(f"{mark}CAST({x} AS {scalars.spark_type(w, [])})", "json" if mark else scalars.spark_type(w, []).lower())
        if w in ("EXTRACT", "POSITION", "SUBSTRING", "TRIM", "OVERLAY") and self.ahead().text == "(":
            return self.special(w)
        if w.lower() in scalars.CONSTANTS and self.ahead().text not in (".",):
            self.next()
            if self.take("("):
                if self.t.kind == "number":
                    self.next()
                self.need(")")
            if self.call and (made := self.call(w.lower(), [])) is not None:
                return made
            return self.known(scalars.CONSTANTS[w.lower()], {"current_timestamp": "timestamp", "current_date": "date", "localtimestamp": "timestamp_ntz"}.get(w.lower(), "string"))
        parts = [self.identifier()]
        while self.at(".") and (self.ahead().kind in ("word", "quoted") or self.ahead().text == "*"):
            self.next()
            if self.take("*"):
                return f"{name(parts[-1])}.*"
            parts.append(self.identifier())
        if self.at("("):
            return self.function(parts[-1])
        return ".".join(map(name, parts[-2:]))

    def case(self) -> str:
        self.need("CASE")
        out, results = "CASE" if self.at("WHEN") else f"CASE {self.expression()}", []
        while self.take("WHEN"):
            out += f" WHEN {self.expression()}"
            self.need("THEN")
            results.append(self.expression())
            out += f" THEN {results[-1]}"
        if self.take("ELSE"):
            results.append(self.expression())
            out += f" ELSE {results[-1]}"
        self.need("END")
        kinds = {self.kind(x) for x in results if x != "NULL"}
        return self.known(out + " END", kinds.pop() if len(kinds) == 1 and "literal" not in kinds else "")

    def special(self, w: str) -> str:
        self.next()
        self.need("(")
        if w == "EXTRACT":
            f = self.literal()
            if not self.take("FROM"):
                self.need(",")
            args = [f"'{f}'", self.expression()]
        elif w == "POSITION":
            first = self.expression(LIKE)
            args = [self.expression(), first] if self.take("IN") else [first, *self.expressions()] if self.take(",") else [first]
        elif w == "TRIM":
            side = self.next().upper if self.t.upper in ("BOTH", "LEADING", "TRAILING") else "BOTH"
            chars = None if self.at("FROM") else self.expression()
            if self.take("FROM"):
                args = [self.expression(), *([chars] if chars else [])]
            else:
                args = [chars, *(self.expressions() if self.take(",") else [])]
            self.need(")")
            return scalars.FUNCTIONS[{"BOTH": "btrim", "LEADING": "ltrim", "TRAILING": "rtrim"}[side]](args)
        else:
            args = [self.expression()]
            for word in ("PLACING", "FROM", "FOR"):
                if self.take(word):
                    args.append(self.expression())
            while self.take(","):
                args.append(self.expression())
        self.need(")")
        return scalars.FUNCTIONS[w.lower()](args) if w != "OVERLAY" else f"overlay({', '.join(args)})"

    def named_interval(self) -> str:
        """make_interval(years, months, weeks, days, hours, mins, secs), by place or by name."""
        parts = ("years", "months", "weeks", "days", "hours", "mins", "secs")
        given: dict[str, str] = {}
        while not self.at(")"):
            own = parts[len(given)]
            if self.t.kind == "word" and self.ahead().text in ("=", ":=") and (self.ahead().text == ":=" or self.ahead(2).text == ">"):
                own = self.identifier()
                self.take(":=") or self.take("=", ">")
            given[own] = self.expression()
            self.take(",")
        self.need(")")
        if not set(given) <= set(parts):
            raise SqlError("42883", f"make_interval has no {sorted(set(given) - set(parts))}")
        return scalars.interval_of([given.get(p, "0") for p in parts])

    def function(self, f: str) -> str:
        self.need("(")
        if f == "make_interval":
            return self.named_interval()
        distinct = self.take("DISTINCT")
        self.take("ALL")
        args = [] if self.at(")") or self.at("ORDER") else self.expressions()
        order = self.order_by() if self.at("ORDER") else ""
        self.need(")")
        within = ""
        if self.take("WITHIN", "GROUP"):
            self.need("(")
            within = self.order_by(nulls=False)
            self.need(")")
        keep = ""
        if self.take("FILTER"):
            self.need("(", "WHERE")
            keep = f" FILTER (WHERE {self.expression()})"
            self.need(")")
        over = ""
        if self.take("OVER"):
            over = f" OVER {self.window()}"
        if f == "current_setting" and self.setting:
            value = self.setting(args[0].strip("'"))
            if value is None and (len(args) < 2 or args[1].lower() != "true"):
                raise SqlError("42704", f"setting {args[0]} isn't known")
            return "CAST(NULL AS STRING)" if value is None else quote(value)
        if f == "timezone" and len(args) == 2:
            return self.in_zone(*args)
        if f in ("row_to_json", "to_json", "to_jsonb") and any(args[0] == name(own) for scope in self.scopes for own in scope) and not self.kind(args[0]):
            return f"/*json*/to_json(struct({args[0]}.*), map('ignoreNullFields', 'false'))"
        if self.call and (made := self.call(f, args)) is not None:
            return made
        if f == "string_agg":
            x, sep = args
            body = f"listagg({'DISTINCT ' * distinct}{x}, {sep})"
            return f"{body} WITHIN GROUP ({order}){keep}{over}" if order else body + keep + over
        if f == "array_agg" and order:
            keys = f"struct({', '.join(k for k in re.sub(r' (ASC|DESC) NULLS (FIRST|LAST)', '', order[9:]).split(', '))}, {args[0]} AS v)"
            sort = "" if " DESC" not in order else ", (l, r) -> CASE WHEN l < r THEN 1 WHEN l > r THEN -1 ELSE 0 END"
            return f"nullif(transform(array_sort(collect_list({keys}){keep}{sort}), e -> e.v), array())"
        if f == "mode":
            x = args[0] if args else re.sub(r" (ASC|DESC).*$", "", within[9:])
            return f"mode({x}, true){keep}{over}"
        if f in ("percentile_cont", "percentile_disc"):
            return f"{f}({args[0]}) WITHIN GROUP ({within}){keep}{over}"
        if f in ("first_value", "last_value") and not over:
            return f"{f[:-6]}({args[0]}, true){keep}"
        if distinct:
            args[0] = f"DISTINCT {args[0]}"
        if f == "array_agg":
            return f"nullif(collect_{'set' if distinct else 'list'}({args[0].removeprefix('DISTINCT ')}){keep}{over}, array())"
        if over and f in ("row_number", "rank", "dense_rank"):
            return f"CAST({f}(){over} AS BIGINT)"
        if f == "grouping":
            return f"CAST(grouping({args[0]}) AS INT)"
        if f in ("nextval", "currval", "setval", "lastval"):
            raise SqlError("0A000", f"{f}() needs a session")
        made = scalars.FUNCTIONS[f](args) if f in scalars.FUNCTIONS else f"{f}({', '.join(args)})"
        if f in ("nullif", "coalesce", "greatest", "least", "abs", "min", "max", "lag", "lead", "first_value", "last_value"):
            own = {self.kind(x) for x in (args[:1] if f == "nullif" else args)} - {""}
            self.known(made + keep + over, own.pop() if len(own) == 1 and (f != "coalesce" or "literal" not in own) else "")
        if f in RETURNS and not (keep or over):
            self.known(made, RETURNS[f])
        if keep or over:
            # The aggregate inside a template is its collect_list.
            if f in scalars.FUNCTIONS and "collect_list(" in made:
                return _after_call(made, "collect_list", keep + over)
            return made + keep + over
        return made

    def window(self) -> str:
        if not self.at("("):
            return name(self.identifier())
        self.need("(")
        out = ""
        if self.t.kind == "word" and self.t.upper not in ("PARTITION", "ORDER", "ROWS", "RANGE"):
            out += name(self.identifier()) + " "
        if self.take("PARTITION", "BY"):
            out += f"PARTITION BY {', '.join(self.expressions())} "
        if self.at("ORDER"):
            out += self.order_by() + " "
        while not self.at(")"):
            t = self.next()
            out += (t.text.upper() if t.kind == "word" else t.text) + " "
        self.need(")")
        return f"({out.strip()})"

    def order_by(self, nulls: bool = True) -> str:
        return "ORDER BY " + ", ".join(f"{x} {d} NULLS {n}" if nulls else f"{x} {d}" for x, d, n in self.order_items())

    def order_items(self) -> list[tuple[str, str, str]]:
        """(expression, direction, where nulls go): last when ascending, first when descending, unless it is said."""
        self.need("ORDER", "BY")
        out = []
        while True:
            x = self.expression()
            direction = "DESC" if self.take("DESC") else "ASC"
            if direction == "ASC":
                self.take("ASC")
            nulls = "LAST" if direction == "ASC" else "FIRST"
            if self.take("NULLS"):
                nulls = self.next().upper
            out.append((x, direction, nulls))
            if not self.take(","):
                return out

    def type(self) -> str:
        base = self.identifier()
        while self.take("."):
            base = self.identifier()
        if base == "double":
            self.take("PRECISION")
        elif base in ("character", "bit"):
            self.take("VARYING")
        self.last_type, args = base, []
        if self.take("("):
            args.append(self.next().text)
            while self.take(","):
                args.append(self.next().text)
            self.need(")")
        if base in ("timestamp", "time"):
            if self.take("WITH"):
                self.need("TIME", "ZONE")
                base += "tz"
            elif self.take("WITHOUT"):
                self.need("TIME", "ZONE")
        depth = 0
        while self.take("["):
            if self.t.kind == "number":
                self.next()
            self.need("]")
            depth += 1
        return scalars.spark_type(base, args, depth)

    # Queries

    def query(self) -> str:
        self.ctes.append(set())
        head = self.with_clause() if self.at("WITH") else ""
        body = self.set_operation(0)
        columns = self.columns
        tail = self.tail()
        self.columns = columns
        self.ctes.pop()
        return head + body + tail

    def with_clause(self) -> str:
        self.need("WITH")
        recursive = self.take("RECURSIVE")
        out = []
        while True:
            own = self.identifier()
            columns = self.names() if self.at("(") else []
            self.need("AS")
            if self.take("NOT"):
                self.need("MATERIALIZED")
            else:
                self.take("MATERIALIZED")
            self.need("(")
            if recursive:
                self.ctes[-1].add(own)
            start = self.i
            text = self.recursive_body(own, columns) if recursive else None
            if text is None:
                self.i = start
                text = self.query()
            self.need(")")
            known = self.columns if start not in self.derived else None
            self.cte_columns[own] = (dict(zip(columns, known.values())) if columns else known) if known and not recursive else None
            self.ctes[-1].add(own)
            if text:
                out.append(f"{name(own)}{'(' + ', '.join(map(name, columns)) + ')' if columns else ''} AS ({text})")
            if not self.take(","):
                break
        if not out:
            return ""
        return f"WITH {'RECURSIVE ' * recursive}{', '.join(out)} "

    def recursive_body(self, own: str, columns: list[str]) -> str | None:
        """base UNION [ALL] step, if the step refers to the CTE; a distinct one is noted and gives ''."""
        self.ctes.append(set())
        base = self.select_core()
        self.ctes.pop()
        if not self.take("UNION"):
            return None
        every = self.take("ALL")
        self.take("DISTINCT")
        start = self.i
        self.ctes.append(set())
        step = self.select_core()
        self.ctes.pop()
        if not any(t.kind in ("word", "quoted") and t.text.strip('"').lower() == own for t in self.all[start : self.i]):
            return None
        if every:
            return f"{base} UNION ALL {step}"
        self.recursive.append(Recursive(own, columns, base, step))
        return ""

    def set_operation(self, power: int) -> str:
        if self.at("("):
            self.next()
            left = f"({self.query()})"
            self.need(")")
        else:
            left = self.select_core()
        while True:
            op = self.t.upper
            own = {"UNION": 1, "EXCEPT": 1, "INTERSECT": 2}.get(op, 0)
            if own <= power:
                return left
            self.next()
            every = " ALL" if self.take("ALL") else ""
            self.take("DISTINCT")
            columns = self.columns
            right = self.set_operation(own)
            self.columns = columns
            left = f"({left}) {op}{every} ({right})" if not left.startswith("(") else f"{left} {op}{every} ({right})"

    def tail(self) -> str:
        out = ""
        if self.at("ORDER"):
            out += " " + self.order_by()
        limit = offset = None
        while True:
            if self.take("LIMIT"):
                limit = None if self.take("ALL") or self.take("NULL") else self.expression()
            elif self.take("OFFSET"):
                offset = self.expression()
                self.take("ROWS") or self.take("ROW")
            elif self.at("FETCH"):
                self.next()
                self.next()  # FIRST or NEXT
                limit = "1" if self.at("ROW") or self.at("ROWS") else self.expression()
                self.take("ROWS") or self.take("ROW")
                self.need("ONLY")
            elif self.at("FOR") and self.ahead().upper in ("UPDATE", "SHARE", "NO", "KEY"):
                while not (self.at(")") or self.at(";") or self.t.kind == "end"):
                    self.next()
            else:
                break
        out += f" LIMIT {limit}" if limit is not None else ""
        out += f" OFFSET {offset}" if offset is not None else ""
        return out

    def select_core(self) -> str:
        if self.take("VALUES"):
            rows = []
            while True:
                self.need("(")
                rows.append(f"({', '.join(self.expressions())})")
                self.need(")")
                if not self.take(","):
                    return f"VALUES {', '.join(rows)}"
        if self.take("TABLE"):
            return f"SELECT * FROM {self.source(self.table_name())}"
        self.need("SELECT")
        self.scopes.append(self.scan_scope())
        try:
            return self.select_rest()
        finally:
            self.scopes.pop()

    def select_rest(self) -> str:
        distinct, on = "", None
        if self.take("DISTINCT"):
            if self.take("ON"):
                self.need("(")
                on = self.expressions()
                self.need(")")
            else:
                distinct = "DISTINCT "
        else:
            self.take("ALL")
        items: list[tuple[str, str | None]] = []
        while not (self.at("FROM") or self.t.kind == "end"):
            x = self.expression()
            alias = None
            if self.take("AS"):
                alias = self.identifier()
            elif (self.t.kind == "word" and self.t.upper not in CLAUSES) or self.t.kind == "quoted":
                alias = self.identifier()
            elif x.startswith("explode(") and not alias:
                alias = "unnest" if "sequence(" not in x else "generate_series"
            items.append((x, alias))
            if not self.take(","):
                break
        self.note_columns(items)
        columns = self.columns
        try:
            return self.select_clauses(distinct, on, items)
        finally:
            self.columns = columns

    def select_clauses(self, distinct: str, on: list[str] | None, items: list[tuple[str, str | None]]) -> str:
        body = ""
        if self.take("FROM"):
            body += f" FROM {self.from_list()}"
        if self.take("WHERE"):
            body += f" WHERE {self.expression()}"
        if self.take("GROUP", "BY"):
            body += f" GROUP BY {', '.join(self.grouping())}"
        if self.take("HAVING"):
            body += f" HAVING {self.expression()}"
        if self.take("WINDOW"):
            windows = []
            while True:
                w = self.identifier()
                self.need("AS")
                windows.append(f"{name(w)} AS {self.window()}")
                if not self.take(","):
                    break
            body += f" WINDOW {', '.join(windows)}"
        shown = [x + (f" AS {name(a)}" if a else "") for x, a in items]
        if on is None:
            return f"SELECT {distinct}{', '.join(shown)}{body}"
        # DISTINCT ON: the first row of each group in the query's order.
        order = self.order_items() if self.at("ORDER") else []
        aliases = {a: x for x, a in items if a}
        order = [(aliases.get(x.strip("`"), x), d, n) for x, d, n in order]
        keys = "".join(f", {x} AS __o{k}" for k, (x, _, _) in enumerate(order))
        by = ", ".join(f"{x} {d} NULLS {n}" for x, d, n in order) or ", ".join(on)
        hidden = ", ".join(["__rn", *(f"__o{k}" for k in range(len(order)))])
        outer = " ORDER BY " + ", ".join(f"__o{k} {d} NULLS {n}" for k, (_, d, n) in enumerate(order)) if order else ""
        return f"SELECT * EXCEPT ({hidden}) FROM (SELECT {', '.join(shown)}{keys}, row_number() OVER (PARTITION BY {', '.join(on)} ORDER BY {by}) AS __rn{body}) WHERE __rn = 1{outer}"

    def grouping(self) -> list[str]:
        out = []
        while True:
            if self.at("ROLLUP", "(") or self.at("CUBE", "("):
                word = self.next().upper
                self.need("(")
                out.append(f"{word} ({', '.join(self.expressions())})")
                self.need(")")
            elif self.take("GROUPING", "SETS"):
                self.need("(")
                sets = []
                while True:
                    if self.take("("):
                        sets.append("(" + ("" if self.at(")") else ", ".join(self.expressions())) + ")")
                        self.need(")")
                    else:
                        sets.append(f"({self.expression()})")
                    if not self.take(","):
                        break
                self.need(")")
                out.append(f"GROUPING SETS ({', '.join(sets)})")
            else:
                out.append(self.expression())
            if not self.take(","):
                return out

    def from_list(self) -> str:
        out = self.join_chain(True)
        while self.take(","):
            out += f" CROSS JOIN {self.join_chain(False)}"
        return out

    def join_chain(self, first: bool) -> str:
        out = self.from_item(first)
        while True:
            kind = None
            if self.take("CROSS", "JOIN"):
                kind = "CROSS JOIN"
            elif self.take("NATURAL"):
                self.take("INNER")
                self.need("JOIN")
                kind = "NATURAL JOIN"
            elif self.take("JOIN") or self.take("INNER", "JOIN"):
                kind = "JOIN"
            else:
                for side in ("LEFT", "RIGHT", "FULL"):
                    if self.at(side) and self.ahead().upper in ("JOIN", "OUTER"):
                        self.next()
                        self.take("OUTER")
                        self.need("JOIN")
                        kind = f"{side} JOIN"
            if kind is None:
                return out
            out += f" {kind} {self.from_item(False)}"
            if self.take("ON"):
                out += f" ON {self.expression()}"
            elif self.take("USING"):
                out += f" USING ({', '.join(map(name, self.names()))})"

    def from_item(self, first: bool) -> str:
        lateral = "LATERAL " if self.take("LATERAL") else ""
        if self.take("("):
            if self.at("SELECT") or self.at("WITH") or self.at("VALUES") or self.at("("):
                inner = self.derived_table()[0]
                self.need(")")
                return f"{lateral}({inner}){self.alias()}"
            inner = self.from_list()
            self.need(")")
            return f"({inner}){self.alias()}"
        if self.t.kind in ("word", "quoted") and self.ahead().text == "(":
            f = self.identifier()
            call = self.function(f)
            own, columns = self.alias_parts()
            own = own or f
            column = columns[0] if columns else own
            return f"{'' if first else 'LATERAL '}(SELECT {call} AS {name(column)}) AS {name(own)}"
        table = self.table_name()
        own, columns = self.alias_parts()
        cols = f"({', '.join(map(name, columns))})" if columns else ""
        return f"{self.source(table)} AS {name(own or table.split('.')[-1])}{cols}"

    def alias_parts(self) -> tuple[str | None, list[str]]:
        own = None
        if self.take("AS") or (self.t.kind == "word" and self.t.upper not in CLAUSES) or self.t.kind == "quoted":
            own = self.identifier()
        return own, self.names() if own and self.at("(") else []

    def alias(self) -> str:
        own, columns = self.alias_parts()
        return (f" AS {name(own)}" if own else "") + (f"({', '.join(map(name, columns))})" if columns else "")

    def done(self) -> None:
        self.take(";")
        if self.t.kind != "end":
            raise SqlError("42601", f"unexpected {self.t.text!r} at {self.t.at}")


def _after_call(text: str, f: str, suffix: str) -> str:
    """text with the suffix after each call of f."""
    out, at = "", 0
    while (i := text.find(f + "(", at)) >= 0:
        depth, j = 0, i + len(f)
        while True:
            depth += (text[j] == "(") - (text[j] == ")")
            j += 1
            if not depth:
                break
        out += text[at:j] + suffix
        at = j
    return out + text[at:]


def literal(value: Any) -> str:
    """A Python value as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    return quote(str(value))


def interval(text: str) -> str:
    """INTERVAL '1 day 2 hours' as a Spark interval."""
    units = re.findall(r"([+-]?\d+(?:\.\d+)?)\s*(year|mon(?:th)?|week|day|hour|hr|min(?:ute)?|sec(?:ond)?|milli(?:second)?|micro(?:second)?)s?", text.lower())
    clock = re.search(r"(-?\d+):(\d+)(?::(\d+(?:\.\d+)?))?", text)
    if clock:
        units += [(clock[1], "hour"), (clock[2], "minute"), (clock[3] or "0", "second")]
    if not units:
        raise SqlError("22007", f"invalid interval {text!r}")
    full = {"mon": "month", "hr": "hour", "min": "minute", "sec": "second", "milli": "millisecond", "micro": "microsecond"}
    units = [(n, full.get(u, u)) for n, u in units]
    if {u in ("year", "month") for _, u in units} == {True, False}:  # of two kinds, which Spark keeps apart
        scale = {"millisecond": 1e-3, "microsecond": 1e-6}
        parts = ["year", "month", "week", "day", "hour", "minute", "second"]
        sums = dict.fromkeys(parts, 0.0)
        for n, u in units:
            sums["second" if u in scale else u] += float(n) * scale.get(u, 1)
        return scalars.interval_of([f"{sums[u]:g}" if u == "second" else str(int(sums[u])) for u in parts])
    made = " + ".join(f"INTERVAL '{n}' {u.upper()}" if "." not in n else f"make_dt_interval(0, 0, 0, {n})" for n, u in units)
    return made if len(units) == 1 else f"({made})"


def to_spark(sql: str, **kw: Any) -> tuple[str, list[Recursive]]:
    """A query in Spark SQL, and the recursive CTEs to run before it."""
    p = Parser(sql, **kw)
    out = p.query()
    p.done()
    return out, p.recursive
