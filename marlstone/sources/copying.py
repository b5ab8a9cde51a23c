"""COPY in text and CSV, as Spark sources and sinks and as single payloads."""

from __future__ import annotations

import csv
import datetime
import io
import struct
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def text_lines(df: DataFrame, delimiter: str = "\t") -> DataFrame:
    """One string column of COPY text lines: \\N for nulls, backslash escapes."""

    def cell(c: str):
        x = F.col(f"`{c}`").cast("string")
        for raw, escaped in _ESCAPES:
            x = F.replace(x, F.lit(raw), F.lit(escaped))
        return F.coalesce(x, F.lit("\\N"))

    return df.select(F.concat_ws(delimiter, *map(cell, df.columns)).alias("value"))


def csv_lines(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """One string column of CSV lines: nothing for nulls, quotes where they're needed and around empty strings."""

    def cell(c: str):
        x = F.col(f"`{c}`").cast("string")
        quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(x.isNull(), "").when((x == "") | x.contains(delimiter) | x.contains('"') | x.contains("\n") | x.contains("\r"), quoted).otherwise(x)

    return df.select(F.concat_ws(delimiter, *map(cell, df.columns)).alias("value"))


def export(df: DataFrame, kind: str = "text", delimiter: str | None = None, header: bool = False) -> Iterator[str]:
    """The lines of COPY TO STDOUT, a partition at a time."""
    lines = text_lines(df, delimiter or "\t") if kind == "text" else csv_lines(df, delimiter or ",")
    if header:
        yield (delimiter or ("\t" if kind == "text" else ",")).join(df.columns)
    for row in lines.toLocalIterator():
        yield row[0]


def parse(payload: str, kind: str = "text", delimiter: str | None = None, header: bool = False) -> list[list[str | None]]:
    """Rows of a COPY FROM STDIN payload."""
    if kind == "csv":
        rows = _csv_rows(payload, delimiter or ",")
    else:
        rows = []
        for line in payload.split("\n"):
            if line == "\\.":
                break
            if line:
                rows.append([None if x == "\\N" else _unescape(x) for x in line.rstrip("\r").split(delimiter or "\t")])
    return rows[1:] if header else rows


def _csv_rows(payload: str, delimiter: str) -> list[list[str | None]]:
    reader = csv.reader(io.StringIO(payload), delimiter=delimiter, quoting=csv.QUOTE_NOTNULL, strict=True)
    return [row for row in reader if row]


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            out.append({"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v"}.get(text[i + 1], text[i + 1]))
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


# Binary: a signature, then for each row a field count and length-prefixed fields in network order.

SIGNATURE = b"PGCOPY\n\xff\r\n\0"
_DAY, _TIME = datetime.date(2000, 1, 1), datetime.datetime(2000, 1, 1)
_PACKED = {T.ShortType: ">h", T.IntegerType: ">i", T.LongType: ">q", T.FloatType: ">f", T.DoubleType: ">d", T.BooleanType: ">?"}


def _numeric(value: Decimal) -> bytes:
    """Base-10000 digits with weight, sign and scale."""
    sign, digits, exponent = value.as_tuple()
    scale = max(-exponent, 0)
    text = ("".join(map(str, digits)) + "0" * max(exponent, 0)).rjust(scale + 1, "0")
    whole, part = text[: len(text) - scale], text[len(text) - scale :]
    whole = whole.rjust(-(-len(whole) // 4) * 4, "0")
    part = part.ljust(-(-len(part) // 4) * 4, "0")
    groups = [int((whole + part)[i : i + 4]) for i in range(0, len(whole + part), 4)]
    weight = len(whole) // 4 - 1
    while groups and groups[0] == 0:
        groups, weight = groups[1:], weight - 1
    while groups and groups[-1] == 0:
        groups.pop()
    return struct.pack(f">hhHh{len(groups)}h", len(groups), weight if groups else 0, 0x4000 if sign else 0, scale, *groups)


def _read_numeric(data: bytes) -> Decimal:
    n, weight, sign, scale = struct.unpack_from(">hhHh", data)
    total = sum((Decimal(g) * Decimal(10000) ** (weight - i) for i, g in enumerate(struct.unpack_from(f">{n}h", data, 8))), Decimal(0))
    return (-total if sign == 0x4000 else total).quantize(Decimal(1).scaleb(-scale))


def _field(value, kind: T.DataType) -> bytes:
    if type(kind) in _PACKED:
        return struct.pack(_PACKED[type(kind)], value)
    if isinstance(kind, T.DecimalType):
        return _numeric(value)
    if isinstance(kind, T.DateType):
        return struct.pack(">i", (value - _DAY).days)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return struct.pack(">q", (value.replace(tzinfo=None) - _TIME) // datetime.timedelta(microseconds=1))
    return bytes(value) if isinstance(kind, T.BinaryType) else str(value).encode()


def _value(data: bytes, kind: T.DataType):
    if type(kind) in _PACKED:
        return struct.unpack(_PACKED[type(kind)], data)[0]
    if isinstance(kind, T.DecimalType):
        return _read_numeric(data)
    if isinstance(kind, T.DateType):
        return _DAY + datetime.timedelta(days=struct.unpack(">i", data)[0])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _TIME + datetime.timedelta(microseconds=struct.unpack(">q", data)[0])
    return data if isinstance(kind, T.BinaryType) else data.decode()


def export_binary(df: DataFrame) -> Iterator[bytes]:
    """The chunks of a binary COPY TO STDOUT, a row at a time."""
    yield SIGNATURE + struct.pack(">ii", 0, 0)
    kinds = [f.dataType for f in df.schema]
    for row in df.toLocalIterator():
        out = [struct.pack(">h", len(kinds))]
        for value, kind in zip(row, kinds):
            data = None if value is None else _field(value, kind)
            out.append(struct.pack(">i", -1) if data is None else struct.pack(">i", len(data)) + data)
        yield b"".join(out)
    yield struct.pack(">h", -1)


def parse_binary(payload: bytes, schema: T.StructType) -> list[tuple]:
    """Rows of a binary COPY FROM STDIN payload, by the types of the columns."""
    if not payload.startswith(SIGNATURE):
        raise ValueError("the binary COPY signature is missing")
    at = len(SIGNATURE) + 8 + struct.unpack_from(">i", payload, len(SIGNATURE) + 4)[0]
    rows = []
    while (n := struct.unpack_from(">h", payload, at)[0]) >= 0:
        at += 2
        row = []
        for f in range(n):
            size = struct.unpack_from(">i", payload, at)[0]
            at += 4
            row.append(None if size < 0 else _value(payload[at : at + size], schema[f].dataType))
            at += max(size, 0)
        rows.append(tuple(row))
    return rows
