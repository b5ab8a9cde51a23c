"""Tokens of PostgreSQL-flavoured SQL."""

from __future__ import annotations

import re
from typing import NamedTuple


class SqlError(ValueError):
    """A failed statement, with its SQLSTATE."""

    def __init__(self, state: str, message: str):
        super().__init__(f"{state}: {message}")
        self.state = state


class Token(NamedTuple):
    kind: str  # word, quoted, string, number, param, op, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<string>[eE]?'(?:[^']|'')*')
      | (?P<dollar>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)
      | (?P<quoted>"(?:[^"]|"")*")
      | (?P<param>\$\d+)
      | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
      | (?P<word>[^\W\d]\w*)
      | (?P<op>->>|->|\#>>|\#>|<->|<=>|<\#>|!~\*|!~|~\*|~~\*|~~|!~~\*|!~~|~|::|:=|<>|!=|<=|>=|\|\||&&|@>|<@|\?\||\?&|\?|[-+*/%^<>=(),.;\[\]:])""",
    re.X | re.S,
)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError("42601", f"unexpected character {sql[at]!r} at {at}")
        kind, text = m.lastgroup, m.group()
        if kind == "tag" or m.group("dollar"):
            body = text[text.index("$", 1) + 1 :]
            out.append(Token("string", "'" + body[: body.rindex("$", 0, len(body) - 1)].replace("'", "''") + "'", at))
        elif kind != "space":
            if kind == "string" and text[0] in "eE":
                text = "'" + re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r", "'": "''"}.get(e[1], e[1]), text[2:-1], flags=re.S) + "'"
            out.append(Token(kind, text, at))
        at = m.end()
    return [*out, Token("end", "", at)]


def unquote(literal: str) -> str:
    """The value of a string token."""
    return literal[1:-1].replace("''", "'")


def quote(value: str) -> str:
    """A Spark string literal; Spark reads backslashes in it."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(text: str) -> str:
    return "`" + text.replace("`", "``") + "`"
