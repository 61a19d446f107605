"""Typed binary tables: bytes to columns and rows, and back.

A column has a type and storage flags: its name only, a default for all rows, or a value in each row. Row
storage wins over a default, so a value is never looked up row by row as "row, else default".
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Column types (fixed values): code, struct format, Spark type.
TYPES = {
    0x0: ("B", "smallint"),
    0x1: ("b", "tinyint"),
    0x2: ("H", "int"),
    0x3: ("h", "smallint"),
    0x4: ("I", "bigint"),
    0x5: ("i", "int"),
    0x6: ("Q", "decimal(20,0)"),
    0x7: ("q", "bigint"),
    0x8: ("f", "float"),
    0x9: ("d", "double"),
    0xA: ("I", "string"),
    0xB: ("II", "binary"),
    0xC: ("16s", "binary"),
}
STRING, BLOB, GUID = 0xA, 0xB, 0xC
NAMED, DEFAULT, ROW = 0x10, 0x20, 0x40
HEADER = struct.Struct(">4sIHHIIIHHI")


class FormatError(ValueError):
    """Bytes that are not what their format asks for."""


@dataclass
class Column:
    name: str
    kind: int
    flags: int | None = None
    default: object = None


@dataclass
class Table:
    name: str
    columns: list[Column]
    rows: list[list] = field(default_factory=list)
    version: int = 1

    def index(self, name: str) -> int:
        """The first column of that exact name, or -1."""
        return next((i for i, c in enumerate(self.columns) if c.name == name), -1)

    def get(self, row: int, name: str, missing=None):
        i = self.index(name)
        return missing if i < 0 or self.rows[row][i] is None else self.rows[row][i]

    def need(self, row: int, name: str):
        value = self.get(row, name)
        if value is None:
            raise FormatError(f"column {name} is missing or empty")
        return value

    def dicts(self) -> list[dict]:
        return [{c.name: v for c, v in zip(self.columns, r)} for r in self.rows]


def masked(raw: bytes) -> bytes:
    """The mask over table chunks, its own inverse: a byte stream of powers of 0x4115 from 0x655F, modulo 2^32."""
    import numpy as np

    n = len(raw)
    keys = np.full(n, 0x655F, np.uint64)
    if n > 1:
        power = np.array([1], np.uint64)
        step = 0x4115
        while len(power) < n:  # powers double: x, then x times the next power of two
            power = np.concatenate([power, power * np.uint64(step) & np.uint64(0xFFFFFFFF)])
            step = step * step & 0xFFFFFFFF
        keys = keys * power[:n] & np.uint64(0xFFFFFFFF)
    return (np.frombuffer(raw, np.uint8) ^ keys.astype(np.uint8)).tobytes()


def parse(raw: bytes, encoding: str = "utf-8") -> Table:
    """Reads one table; raises FormatError for any section, offset or type that cannot be."""
    if len(raw) < HEADER.size:
        raise FormatError("the table is shorter than its header")
    magic, size, version, rows_at, strings_at, data_at, name_at, n_columns, width, n_rows = HEADER.unpack_from(raw)
    size, rows_at, strings_at, data_at = size + 8, rows_at + 8, strings_at + 8, data_at + 8
    if magic != b"@UTF":
        raise FormatError("the magic is not that of a table")
    if version > 1:
        raise FormatError(f"unknown version {version}")
    if size > len(raw) or not HEADER.size <= rows_at <= strings_at <= data_at <= size:
        raise FormatError("sections are out of order or outside the data")
    strings = raw[strings_at:data_at]
    if name_at >= len(strings) or not n_columns:
        raise FormatError("no string table or no columns")
    if rows_at + n_rows * width > strings_at:
        raise FormatError("rows exceed their section")

    def text(at: int) -> str:
        if at >= len(strings):
            raise FormatError("a string offset is outside the string table")
        end = strings.find(b"\0", at)
        return strings[at : end if end >= 0 else None].decode(encoding, "replace")

    def value(kind: int, at: int, end: int):
        fmt = struct.Struct(">" + TYPES[kind][0])
        if at + fmt.size > end:
            raise FormatError("a value is outside its section")
        got = fmt.unpack_from(raw, at)
        if kind == STRING:
            return text(got[0])
        if kind == BLOB:
            if data_at + got[0] + got[1] > size:
                raise FormatError("a blob is outside the data section")
            return raw[data_at + got[0] : data_at + got[0] + got[1]]
        return got[0]

    columns, places, at, offset = [], [], HEADER.size, 0
    for _ in range(n_columns):
        if at + 5 > rows_at:
            raise FormatError("the schema ends before its columns")
        info, named = struct.unpack_from(">BI", raw, at)
        at, kind, flags = at + 5, info & 0xF, info & 0xF0
        if not flags & NAMED or kind not in TYPES:
            raise FormatError("a column has no name or an unknown type")
        wide = struct.calcsize(">" + TYPES[kind][0])
        column = Column(text(named), kind, flags)
        if flags & DEFAULT:
            column.default, at = value(kind, at, rows_at), at + wide
        places.append(offset if flags & ROW else None)
        offset += wide if flags & ROW else 0
        columns.append(column)
    if offset > width:
        raise FormatError("the row width is less than its columns")
    rows = []
    for r in range(n_rows):
        base = rows_at + r * width
        rows.append([value(c.kind, base + p, strings_at) if p is not None else c.default if c.flags & DEFAULT else None for c, p in zip(columns, places)])
    return Table(text(name_at), columns, rows, version)


def storage(column: Column, values: list) -> int:
    """Flags of a column that has none: missing everywhere: name only; several rows, all equal: default; else row."""
    if column.flags is not None:
        return column.flags
    if all(v is None for v in values):
        return NAMED
    if len(values) > 1 and all(v == values[0] for v in values):
        return NAMED | DEFAULT
    return NAMED | ROW


def build(table: Table, align: int = 1, encoding: str = "utf-8") -> bytes:
    """Writes a table. Strings stand once, first seen first; each blob stands for itself."""
    strings: dict[str, int] = {}
    pool, data = bytearray(), bytearray()

    def text(s: str) -> int:
        if s not in strings:
            strings[s] = len(pool)
            pool.extend(s.encode(encoding) + b"\0")
        return strings[s]

    if table.version == 0:
        text("<NULL>")
    name_at = text(table.name)

    def pack(kind: int, v) -> bytes:
        if kind == STRING:
            return struct.pack(">I", text(v or ""))
        if kind == BLOB:
            if align > 1 and len(data):
                data.extend(b"\0" * (-(len(data) + 1) % align + 1))
            at = len(data)
            data.extend(v or b"")
            return struct.pack(">II", at, len(v or b""))
        if kind == GUID:
            if v is not None and len(v) != 16:
                raise FormatError("a GUID has 16 bytes")
            return v or bytes(16)
        return struct.pack(">" + TYPES[kind][0], v or 0)

    schema, body = bytearray(), bytearray()
    flags = [storage(c, [r[i] for r in table.rows]) for i, c in enumerate(table.columns)]
    for i, (c, f) in enumerate(zip(table.columns, flags)):
        schema += struct.pack(">BI", f | c.kind, text(c.name))
        if f & DEFAULT:
            given = c.default if c.default is not None or not table.rows else table.rows[0][i]
            schema += pack(c.kind, given)
    for r in table.rows:
        for v, c, f in zip(r, table.columns, flags):
            if f & ROW:
                body += pack(c.kind, v)
    width = sum(struct.calcsize(">" + TYPES[c.kind][0]) for c, f in zip(table.columns, flags) if f & ROW)
    rows_at = HEADER.size + len(schema)
    strings_at = rows_at + len(body)
    data_at = strings_at + len(pool)
    data_at += -data_at % max(align, 1)
    pool.extend(b"\0" * (data_at - strings_at - len(pool)))
    size = data_at + len(data)
    head = HEADER.pack(b"@UTF", size - 8, table.version, rows_at - 8, strings_at - 8, data_at - 8, name_at, len(table.columns), width, len(table.rows))
    return bytes(head + schema + body + pool + data)
