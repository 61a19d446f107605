"""Archive indexes: bytes to entries, and entries to bytes. An entry is a dict; payloads are slices."""

from __future__ import annotations

import math
import struct

from lodestone.codecs import table as tables
from lodestone.codecs.table import FormatError

ROOT = 0x800


class Ranged:
    """A file as bytes that are read when they are sliced: parsers of indexes touch headers and indexes only."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> bytes:
        start, stop, _ = at.indices(self.size)
        return self.read(start, max(0, stop - start))


def _numbers(fmt: str, raw, at: int) -> tuple:
    return struct.unpack(fmt, raw[at : at + struct.calcsize(fmt)])


def _up(n: int, step: int) -> int:
    return -(-n // step) * step if step > 1 else n


def _entry(i: int, ident: int, name: str, offset: int, size: int, extract: int | None = None) -> dict:
    extract = size if extract is None else extract
    return {"pos": i, "entry_id": ident, "path": name, "file_offset": offset, "file_size": size, "extract_size": extract, "packed": extract > size}


def _chunk(raw: bytes, at: int, size: int, magic: bytes) -> tables.Table:
    if at + 16 > len(raw) or raw[at : at + 4] != magic:
        raise FormatError(f"no chunk {magic!r} at {at}")
    flag, length = _numbers("<II", raw, at + 4)
    if 16 + length > size or at + 16 + length > len(raw):
        raise FormatError("a chunk is longer than declared or cut off")
    body = raw[at + 16 : at + 16 + length]
    return tables.parse(body if flag == 0xFF else tables.masked(body))


def parse_package(raw: bytes) -> list[dict]:
    """Entries of a package: a header table, and an index by path, by id, or both (ids then come from the latter)."""
    head = _chunk(raw, 0, ROOT, b"CPK ")
    index = {}
    for kind, magic in (("Toc", b"TOC "), ("Itoc", b"ITOC")):
        at, size = head.get(0, kind + "Offset", 0), head.get(0, kind + "Size", 0)
        if at and size:
            index[kind] = _chunk(raw, int(at), int(size), magic)
    if "Toc" in index:
        toc, found = index["Toc"], []
        for r in range(len(toc.rows)):
            path = "/".join(p for p in (toc.get(r, "DirName", ""), toc.get(r, "FileName", "")) if p)
            size = int(toc.need(r, "FileSize"))
            found.append(_entry(r, int(toc.get(r, "ID", r)), path, ROOT + int(toc.need(r, "FileOffset")), size, int(toc.get(r, "ExtractSize", size))))
        if "Itoc" in index and index["Itoc"].index("TocIndex") >= 0:
            ids = index["Itoc"]
            for r in range(len(ids.rows)):
                at = ids.need(r, "TocIndex")
                if at >= len(found):
                    raise FormatError("an index row points outside the entries")
                found[at]["entry_id"] = int(ids.need(r, "ID"))
        return found
    if "Itoc" not in index:
        raise FormatError("the package has no entries")
    itoc, rows = index["Itoc"], []
    for part, count in (("DataL", "FilesL"), ("DataH", "FilesH")):
        nested = tables.parse(itoc.need(0, part))
        for r in range(min(len(nested.rows), int(itoc.get(0, count, 0)))):
            size = int(nested.need(r, "FileSize"))
            rows.append((int(nested.need(r, "ID")), size, int(nested.get(r, "ExtractSize", size))))
    at, step, found = int(head.get(0, "ContentOffset", 0)), int(head.get(0, "Align", 1)), []
    for i, (ident, size, extract) in enumerate(sorted(rows, key=lambda r: r[0])):
        found.append(_entry(i, ident, "", at, size, extract))
        at += _up(size, step)
    return found


def package_order(path: str) -> bytes:
    """What the entries of a package are sorted by, before their numbers."""
    return path.replace("\\", "/").lower().encode()


def build_package(entries: list[tuple[str, bytes]], step: int = 2048) -> bytes:
    """A package with an index by path: entries in path order, payloads on multiples of ``step``."""
    ordered = [(i, path, data) for i, (path, data) in sorted(enumerate(entries), key=lambda e: (package_order(e[1][0]), e[0]))]
    out = bytearray(package_header([(i, path, len(data)) for i, path, data in ordered], step))
    for *_, d in ordered:
        out.extend(b"\0" * (-len(out) % step) + d)
    return bytes(out) + b"\0" * (-len(out) % step)


def package_header(ordered: list[tuple[int, str, int]], step: int = 2048) -> bytes:
    """What stands before the payloads of (number, path, size), each of which begins at the next multiple of ``step``."""
    U32, U64, TEXT = 0x4, 0x6, 0xA
    parts = [(i, *("/" + path.replace("\\", "/")).rsplit("/", 1), size) for i, path, size in ordered]
    toc_of = lambda offsets: tables.build(
        tables.Table(
            "CpkTocInfo",
            [tables.Column("DirName", TEXT, 0x50), tables.Column("FileName", TEXT, 0x50), tables.Column("FileSize", U32, 0x50), tables.Column("ExtractSize", U32, 0x50), tables.Column("FileOffset", U64, 0x50), tables.Column("ID", U32, 0x50)],
            [[folder.lstrip("/"), name, n, n, o, i] for (i, folder, name, n), o in zip(parts, offsets)],
        )
    )
    chunk = lambda magic, body: magic + struct.pack("<III", 0xFF, len(body), 0) + body
    toc_size = 16 + len(toc_of([0] * len(parts)))  # offsets have fixed width, so sizes do not change
    content = _up(ROOT + toc_size, step)
    offsets, at = [], content
    for *_, n in parts:
        offsets.append(at - ROOT)
        at += _up(n, step)
    toc = chunk(b"TOC ", toc_of(offsets))
    head = tables.Table("CpkHeader", [tables.Column(n, U64, 0x50) for n in ("ContentOffset", "ContentSize", "TocOffset", "TocSize")] + [tables.Column("Files", U32, 0x50), tables.Column("Align", 0x2, 0x50)], [[content, at - content, ROOT, len(toc), len(parts), step]])
    return chunk(b"CPK ", tables.build(head)).ljust(ROOT, b"\0") + toc


def parse_slots(raw: bytes) -> list[dict]:
    """An index archive, little-endian: slots by number (empty ones stay), names from the directory if there is one."""
    if len(raw) < 8 or raw[:4] != b"AFS\0":
        raise FormatError("the magic is not that of an index archive")
    n = _numbers("<I", raw, 4)[0]
    if not n or 8 + 8 * n > len(raw):
        raise FormatError("the index has no entries or exceeds the data")
    slots = list(struct.iter_unpack("<II", raw[8 : 8 + 8 * n]))
    if any((o or s) and o + s > len(raw) for o, s in slots):
        raise FormatError("an entry is outside the data")
    names = [""] * n
    if 16 + 8 * n <= len(raw):
        at, size = _numbers("<II", raw, 8 + 8 * n)
        if at and size >= 48 * n and at + size <= len(raw):
            listed = raw[at : at + 48 * n]
            names = [listed[48 * i : 48 * i + 32].split(b"\0")[0].decode("utf-8", "replace") for i in range(n)]
    return [_entry(i, i, name, o, s) | {"present": bool(o or s)} for i, (name, (o, s)) in enumerate(zip(names, slots))]


def build_slots(payloads: list[bytes | None], names: list[str] | None = None, step: int = 2048) -> bytes:
    head, listed = slots_header([None if p is None else len(p) for p in payloads], names, step)
    body = b"".join(p + b"\0" * (-len(p) % step) for p in payloads if p is not None)
    return head + b"\0" * (-len(head) % step) + body + listed


def slots_header(sizes: list[int | None], names: list[str] | None = None, step: int = 2048) -> tuple[bytes, bytes]:
    """What stands before and behind the payloads; an empty slot has no size. Payloads and the end begin on multiples of ``step``."""
    at = _up(8 + 8 * len(sizes) + 8, step)
    index = bytearray()
    for n in sizes:
        index += bytes(8) if n is None else struct.pack("<II", at, n)
        at += _up(n or 0, step)
    listed = b"".join(x.encode()[:32].ljust(32, b"\0") + struct.pack("<HHHHHH", 0, 0, 0, 0, 0, 0) + struct.pack("<I", n or 0) for x, n in zip(names or [], sizes))
    tail = struct.pack("<II", at, len(listed)) if listed else bytes(8)
    return b"AFS\0" + struct.pack("<I", len(sizes)) + bytes(index) + tail, listed


def alignment(offsets: list[int], default: int = 2048) -> int:
    """The greatest common divisor of the offsets there are."""
    return math.gcd(*[o for o in offsets if o]) or default


def parse_bank(raw: bytes) -> list[dict]:
    """A wave bank: an entry starts at its aligned offset and ends at the next one's unaligned offset."""
    if len(raw) < 16 or raw[:4] != b"AFS2":
        raise FormatError("the magic is not that of a wave bank")
    _, wide, id_wide, n, step, _ = _numbers("<BBHIHH", raw, 4)
    id_wide &= 0xFF
    if wide not in (2, 4, 8) or id_wide not in (1, 2, 4, 8) or not step:
        raise FormatError("an offset size, id size or alignment that cannot be")
    ids_end = 16 + id_wide * n
    if ids_end + wide * (n + 1) > len(raw):
        raise FormatError("the tables exceed the data")
    head = raw[: ids_end + wide * (n + 1)]
    number = lambda at, size: int.from_bytes(head[at : at + size], "little")
    marks = [number(ids_end + wide * i, wide) for i in range(n + 1)]
    out = []
    for i in range(n):
        start, end = _up(marks[i], step), marks[i + 1]
        if end < start or end > len(raw):
            raise FormatError("an entry is outside the data")
        out.append(_entry(i, number(16 + id_wide * i, id_wide), "", start, end - start))
    return out


def build_bank(entries: list[tuple[int, bytes]], step: int = 32, wide: int = 4, id_wide: int = 2, subkey: int = 0) -> bytes:
    """A wave bank; the last payload is not padded."""
    n = len(entries)
    head = 16 + id_wide * n + wide * (n + 1)
    marks, at, body = [head], head, bytearray()
    for _, p in entries:
        body += b"\0" * (_up(at, step) - at) + p
        at = _up(at, step) + len(p)
        marks.append(at)
    return bank_header([i for i, _ in entries], marks, step, wide, id_wide, subkey) + bytes(body)


def bank_header(ids: list[int], marks: list[int], step: int, wide: int, id_wide: int, subkey: int = 0) -> bytes:
    """What stands before the payloads; ``marks`` is where the tables end and where each payload ends."""
    packed = b"".join(i.to_bytes(id_wide, "little") for i in ids) + b"".join(m.to_bytes(wide, "little") for m in marks)
    return b"AFS2" + struct.pack("<BBHIHH", 2, wide, id_wide, len(ids), step, subkey) + packed


def parse_pairs(raw: bytes) -> list[dict]:
    """An index archive, big-endian: a zero word, a count, and (offset, size) pairs."""
    if len(raw) < 8 or raw[:4] != bytes(4):
        raise FormatError("the marker is not that of a paired index")
    n = _numbers(">I", raw, 4)[0]
    if not n or 8 + 8 * n > len(raw):
        raise FormatError("the index has no entries or exceeds the data")
    out = [_entry(i, i, "", o, s) for i, (o, s) in enumerate(struct.iter_unpack(">II", raw[8 : 8 + 8 * n]))]
    if any(e["file_offset"] + e["file_size"] > len(raw) for e in out):
        raise FormatError("an entry is outside the data")
    return out


def build_pairs(payloads: list[bytes], step: int = 4) -> bytes:
    head = pairs_header([len(p) for p in payloads], step)
    return head + b"".join(p + b"\0" * (-len(p) % step) for p in payloads)


def pairs_header(sizes: list[int], step: int = 4) -> bytes:
    """What stands before the payloads, each of which begins at the next multiple of ``step``."""
    at, index = _up(8 + 8 * len(sizes), step), bytearray()
    for n in sizes:
        index += struct.pack(">II", at, n)
        at += _up(n, step)
    return (bytes(4) + struct.pack(">I", len(sizes)) + bytes(index)).ljust(_up(8 + 8 * len(sizes), step), b"\0")


PARSERS = {"cpk": parse_package, "afs": parse_slots, "awb": parse_bank, "acx": parse_pairs}


def kind_of(head: bytes) -> str | None:
    """Archive kind by first bytes."""
    for magic, kind in ((b"CPK ", "cpk"), (b"AFS2", "awb"), (b"AFS\0", "afs"), (b"@UTF", "utf"), (b"CRID", "usm")):
        if head.startswith(magic):
            return kind
    return "acx" if head[:4] == bytes(4) and len(head) >= 8 else None
