"""Containers made of nested typed tables, and headers of transform-coded audio."""

from __future__ import annotations

import re
import struct

from lodestone.codecs import adx
from lodestone.codecs import table as tables
from lodestone.codecs.checks import crc16
from lodestone.codecs.table import Column, FormatError, Table

U8, U32, TEXT, BLOB = 0x0, 0x4, 0xA, 0xB


def nested_tables(raw: bytes, depth: int = 4, path: str = "") -> list[dict]:
    """A row for each table in a table, to a fixed depth: where it stands, its name, rows and columns."""
    t = tables.parse(raw)
    out = [{"place": path, "table_name": t.name, "n_rows": len(t.rows), "n_columns": len(t.columns)}]
    if depth:
        for r, row in enumerate(t.rows):
            for c, v in zip(t.columns, row):
                if c.kind == BLOB and v and v[:4] == b"@UTF":
                    out += nested_tables(v, depth - 1, f"{path}/{c.name}[{r}]")
    return out


def parse_segments(raw: bytes) -> list[dict]:
    """Segments of looped block audio; all have one channel count and rate."""
    t = tables.parse(raw)
    if not t.rows:
        raise FormatError("the table has no segments")
    out = []
    for r in range(len(t.rows)):
        data, flag = t.need(r, "data"), t.need(r, "lpflg")
        h = adx.parse_header(data)
        out.append({"segment": r, "loops": bool(flag), "channels": h["channels"], "rate": h["rate"], "samples": h["samples"], "size": len(data)})
    if len({(s["channels"], s["rate"]) for s in out}) > 1:
        raise FormatError("segments differ in channels or rate")
    return out


def build_segments(parts: list[tuple[bytes, bool]]) -> bytes:
    return tables.build(Table("AAX", [Column("data", BLOB, 0x50), Column("lpflg", U8, 0x50)], [[d, int(f)] for d, f in parts]))


ELEMENT = ("name", "data", "fmt", "nch", "stmflg", "sfreq", "nsmpl")


def parse_elements(raw: bytes) -> list[dict]:
    """Sound elements of a bank: a table of sections, one of which holds the table of elements."""
    root = tables.parse(raw)
    sections = [r for r in range(len(root.rows)) if root.need(r, "name") == "SOUND_ELEMENT"]
    if not sections:
        raise FormatError("the bank has no sound elements")
    inner = tables.parse(root.need(sections[0], "utf"))
    if inner.name != "TBLSDL":
        raise FormatError("the element table has another name")
    out = []
    for r in range(len(inner.rows)):
        e = {n: inner.need(r, n) if n != "data" else inner.get(r, n, b"") for n in ELEMENT}
        if not e["data"] and not e["stmflg"]:
            raise FormatError("an embedded element has no payload")
        out.append({"element": r, "path": e["name"], "format": e["fmt"], "channels": e["nch"], "streamed": bool(e["stmflg"]), "rate": e["sfreq"], "samples": e["nsmpl"], "size": len(e["data"])})
    return out


def build_elements(elements: list[dict]) -> bytes:
    kinds = dict(zip(ELEMENT, (TEXT, BLOB, U8, U8, U8, U32, U32)))
    inner = tables.build(Table("TBLSDL", [Column(n, k, 0x50) for n, k in kinds.items()], [[e[n] for n in ELEMENT] for e in elements]))
    return tables.build(Table("TBLCSB", [Column("name", TEXT, 0x50), Column("ttype", U8, 0x50), Column("utf", BLOB, 0x50)], [["SOUND_ELEMENT", 4, inner]]))


def parse_transform_header(raw: bytes) -> dict:
    """Header of transform-coded audio. Chunk names may be masked by their top bits; the checksum must hold."""
    if len(raw) < 8 or bytes(b & 0x7F for b in raw[:4]) != b"HCA\0":
        raise FormatError("the magic is not that of transform-coded audio")
    version, size = struct.unpack_from(">HH", raw, 4)
    if size < 8 or size > len(raw):
        raise FormatError("the header is cut off")
    if crc16(raw[: size - 2]) != struct.unpack_from(">H", raw, size - 2)[0]:
        raise FormatError("the header's checksum does not hold")
    widths = {b"fmt\0": 16, b"comp": 16, b"dec\0": 12, b"vbr\0": 8, b"ath\0": 6, b"loop": 16, b"ciph": 6, b"rva\0": 8, b"comm": None, b"pad\0": None}
    out, at = {"version": version, "header_size": size, "cipher": 0, "volume": 1.0, "loop_start": None, "loop_end": None}, 8
    while at + 4 <= size - 2:
        name = bytes(b & 0x7F for b in raw[at : at + 4])
        body = raw[at + 4 : size - 2]
        if name not in widths or name == b"pad\0":
            break
        if name == b"fmt\0":
            first, out["frames"], out["delay"], out["padding"] = struct.unpack_from(">IIHH", body)
            out["channels"], out["rate"] = first >> 24, first & 0xFFFFFF
        elif name in (b"comp", b"dec\0"):
            out["frame_size"], out["min_resolution"], out["max_resolution"] = struct.unpack_from(">HBB", body)
        elif name == b"loop":
            out["loop_start"], out["loop_end"] = struct.unpack_from(">II", body)
        elif name == b"ciph":
            out["cipher"] = struct.unpack_from(">H", body)[0]
        elif name == b"rva\0":
            out["volume"] = struct.unpack_from(">f", body)[0]
        at += widths[name] if widths[name] else 5 + body[0]
    if "channels" not in out or "frame_size" not in out:
        raise FormatError("the format or codec chunk is missing")
    if not 1 <= out["channels"] <= 8 or not out["rate"] or not out["frames"] or out["delay"] + out["padding"] >= out["frames"] * 1024:
        raise FormatError("format values that cannot be")
    if out["cipher"] not in (0, 1, 56):
        raise FormatError("an unknown cipher type")
    return out | {"samples": out["frames"] * 1024 - out["delay"] - out["padding"]}


def build_transform_header(channels: int, rate: int, frames: int, delay: int, padding: int, frame_size: int, version: int = 0x0200) -> bytes:
    """A header with format and codec chunks and its checksum."""
    body = b"fmt\0" + struct.pack(">IIHH", channels << 24 | rate, frames, delay, padding) + b"comp" + struct.pack(">HBB", frame_size, 1, 15).ljust(12, b"\0")
    raw = b"HCA\0" + struct.pack(">HH", version, 10 + len(body)) + body
    return raw + struct.pack(">H", crc16(raw))


_ASS = re.compile(r"^Dialogue:\s*([^,]*),([^,]*),([^,]*),([^,]*),([^,]*),([^,]*),([^,]*),([^,]*),([^,]*),(.*)$")


def parse_ass(text: str) -> list[dict]:
    """Dialogue lines of an ASS text in milliseconds; \\N is a line break and {..} markup goes."""
    out = []
    for line in text.splitlines():
        m = _ASS.match(line.strip())
        if m:
            a, b = (sum(x * y for x, y in zip((3600000, 60000, 1000, 10), map(int, re.split(r"[:.]", t.strip())))) for t in (m[2], m[3]))
            said = re.sub(r"\{[^}]*\}", "", m[10]).replace("\\N", "\n").replace("\\n", "\n")
            out.append({"cue_no": len(out), "language_id": 0, "time_unit": 1000, "start": a, "duration": b - a, "text": said, "terminators": 0})
    return out
