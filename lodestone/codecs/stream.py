"""Media streams as chunks and records: multiplexed chunks, subtitles, frames and audio headers."""

from __future__ import annotations

import re
import struct

from lodestone.codecs import table as tables
from lodestone.codecs.table import FormatError

CHUNK = struct.Struct(">4sIHHBBHIIII")
#: Payload types (fixed values), by the low two bits.
PAYLOADS = ("stream", "header", "end", "seek")


def parse_chunks(raw: bytes) -> list[dict]:
    """All chunks of a multiplexed file in order; the payload lies between its offset and the padding."""
    out, at = [], 0
    while len(raw) - at >= CHUNK.size:
        magic, size, offset, padding, channel, _, kind, time, rate, _, _ = CHUNK.unpack_from(raw, at)
        end = at + 8 + size
        if end > len(raw) or offset + padding > size:
            raise FormatError(f"the chunk at {at} is longer than the data or its padding")
        out.append(
            {"chunk_no": len(out), "chunk_offset": at, "magic": magic.decode("latin-1"), "channel": channel, "payload_type": PAYLOADS[kind & 3], "flags": kind >> 2, "frame_time": time, "frame_rate": rate,
             "payload": raw[at + 8 + offset : end - padding]}
        )
        at = end
    return out


def build_chunk(magic: str, payload: bytes, channel: int = 0, kind: str = "stream", time: int = 0, rate: int = 30, align: int = 0x20) -> bytes:
    padding = -len(payload) % align
    return CHUNK.pack(magic.encode("latin-1"), 0x18 + len(payload) + padding, 0x18, padding, channel, 0, PAYLOADS.index(kind), time, rate, 0, 0) + payload + bytes(padding)


def stream_directory(chunks: list[dict]) -> list[dict]:
    """Rows of the leading directory table; row 0 describes the file. A (stream, channel) twice is an error."""
    if not chunks or chunks[0]["magic"] != "CRID":
        raise FormatError("the file does not start with a directory")
    rows = tables.parse(chunks[0]["payload"]).dicts()
    keys = [(r.get("stmid"), r.get("chno")) for r in rows[1:]]
    if len(set(keys)) != len(keys):
        raise FormatError("the directory has a stream twice")
    return [
        {"row": i, "filename": r.get("filename"), "stream_id": None if r.get("stmid") is None else struct.pack(">I", r["stmid"]).decode("latin-1"), "channel": r.get("chno"), "filesize": r.get("filesize")}
        for i, r in enumerate(rows)
    ]


RECORD = struct.Struct("<5I")


def parse_subtitles(raw: bytes) -> list[dict]:
    """Subtitle records: language, time unit, start, duration, text; trailing zero bytes are counted, not kept."""
    out, at = [], 0
    while at < len(raw):
        if len(raw) - at < RECORD.size:
            raise FormatError("a subtitle record is cut off")
        language, unit, start, duration, size = RECORD.unpack_from(raw, at)
        at += RECORD.size
        if not unit or at + size > len(raw):
            raise FormatError("a subtitle has no time unit or its text is cut off")
        text = raw[at : at + size]
        bare = text.rstrip(b"\0")
        out.append({"cue_no": len(out), "language_id": language, "time_unit": unit, "start": start, "duration": duration, "text": bare.decode("utf-8", "replace"), "terminators": size - len(bare)})
        at += size
    return out


def build_subtitles(cues: list[dict]) -> bytes:
    out = bytearray()
    for c in cues:
        text = c["text"].encode() + bytes(c.get("terminators", 2))
        if not c["time_unit"]:
            raise FormatError("a subtitle has no time unit")
        out += RECORD.pack(c["language_id"], c["time_unit"], c["start"], c["duration"], len(text)) + text
    return bytes(out)


_CUE = re.compile(r"(\d+):(\d\d):(\d\d)[,.](\d{3})\s*-->\s*(\d+):(\d\d):(\d\d)[,.](\d{3})[^\n]*\n(.*?)(?=\n\s*\n|\Z)", re.DOTALL)


def parse_srt(text: str) -> list[dict]:
    """Cues of an SRT text in milliseconds."""
    out = []
    for m in _CUE.finditer(text.replace("\r\n", "\n")):
        a, b = (((int(h) * 60 + int(mi)) * 60 + int(s)) * 1000 + int(ms) for h, mi, s, ms in (m.groups()[:4], m.groups()[4:8]))
        if b < a:
            raise FormatError("a subtitle ends before it starts")
        out.append({"cue_no": len(out), "language_id": 0, "time_unit": 1000, "start": a, "duration": b - a, "text": m[9].strip("\n"), "terminators": 0})
    return out


def srt_time(ms: int) -> str:
    return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def build_srt(cues: list[dict]) -> str:
    milli = lambda t, unit: (t * 1000 + unit // 2) // unit
    return "\n".join(f"{i + 1}\n{srt_time(milli(c['start'], c['time_unit']))} --> {srt_time(milli(c['start'] + c['duration'], c['time_unit']))}\n{c['text']}\n" for i, c in enumerate(cues))


def parse_frames(raw: bytes) -> list[dict]:
    """Frames of an IVF file."""
    if len(raw) < 32 or raw[:4] != b"DKIF":
        raise FormatError("the magic is not that of a frame file")
    at, out = struct.unpack_from("<H", raw, 6)[0], []
    while at + 12 <= len(raw):
        size, stamp = struct.unpack_from("<IQ", raw, at)
        if at + 12 + size > len(raw):
            raise FormatError("a frame is cut off")
        out.append({"frame_no": len(out), "frame_time": stamp, "frame_offset": at + 12, "frame_size": size})
        at += 12 + size
    return out


def build_frames(frames: list[tuple[int, bytes]], codec: bytes = b"VP90", size: tuple[int, int] = (16, 16), clock: tuple[int, int] = (30, 1)) -> bytes:
    """An IVF file of (time, payload) frames."""
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, codec, *size, *clock, len(frames), 0)
    return head + b"".join(struct.pack("<IQ", len(p), t) + p for t, p in frames)


def parse_units(raw: bytes) -> list[dict]:
    """NAL units between start codes."""
    marks = [m.start() for m in re.finditer(b"\0\0\1", raw)]
    ends = [*marks[1:], len(raw)]
    cut = lambda a, b: raw[a + 3 : b].rstrip(b"\0") if b < len(raw) else raw[a + 3 : b]
    return [{"unit_no": i, "unit_offset": a + 3, "unit_type": u[0] & 31 if u else None, "unit_size": len(u)} for i, (a, b) in enumerate(zip(marks, ends)) for u in [cut(a, b)]]


def parse_wav(raw: bytes) -> dict:
    """Format and data place of a RIFF wave file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise FormatError("the magic is not that of a wave file")
    at, out = 12, {}
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from("<4sI", raw, at)
        if kind == b"fmt ":
            _, out["channels"], out["rate"], _, out["block"], out["bits"] = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif kind == b"smpl":
            n = struct.unpack_from("<I", raw, at + 36)[0]
            out["loops"] = [struct.unpack_from("<II", raw, at + 52 + 24 * i) for i in range(n)]
        elif kind == b"data":
            out["data_offset"], out["data_size"] = at + 8, min(size, len(raw) - at - 8)
        at += 8 + size + size % 2
    if "channels" not in out or "data_offset" not in out:
        raise FormatError("a wave file without format or data")
    return out | {"samples": out["data_size"] // max(out["block"], 1), "loops": out.get("loops", [])}


def build_wav(pcm: bytes, rate: int, channels: int) -> bytes:
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(pcm)) + pcm


def parse_commands(raw: bytes) -> list[dict]:
    """Type-length-value commands up to the end mark (0, 0); a value that is cut off is an error."""
    out, at = [], 0
    while at + 3 <= len(raw):
        code, size = struct.unpack_from(">HB", raw, at)
        if code == 0 and size == 0:
            break
        if at + 3 + size > len(raw):
            raise FormatError("a command is cut off")
        out.append({"command_no": len(out), "code": code, "value": raw[at + 3 : at + 3 + size]})
        at += 3 + size
    return out


def _elementary(raw: bytes, at: int, end: int) -> int:
    """Where a packet's payload starts, past its stuffing, buffer size and time stamps."""
    if at < end and raw[at] & 0xC0 == 0x80:  # second generation: flags and a header length
        return min(end, at + 3 + (raw[at + 2] if at + 2 < end else 0))
    while at < end and raw[at] == 0xFF:
        at += 1
    if at < end and raw[at] & 0xC0 == 0x40:
        at += 2
    if at < end:
        at += {2: 5, 3: 10}.get(raw[at] >> 4, 1)
    return min(end, at)


def parse_program(raw: bytes) -> list[dict]:
    """Packets of a program stream: stream id, place and size of the payload. Pack and system headers are skipped."""
    out, at = [], 0
    if raw[:4] != b"\0\0\1\xba":
        raise FormatError("the magic is not that of a program stream")
    while at + 4 <= len(raw) and raw[at : at + 3] == b"\0\0\1":
        code = raw[at + 3]
        if code == 0xB9:
            break
        if code == 0xBA:
            if at + 5 > len(raw):
                raise FormatError("a pack header is cut off")
            at += 14 + (raw[at + 13] & 7) if raw[at + 4] & 0xC0 == 0x40 and at + 14 <= len(raw) else 12
            continue
        if at + 6 > len(raw):
            raise FormatError("a packet header is cut off")
        end = at + 6 + struct.unpack_from(">H", raw, at + 4)[0]
        if end > len(raw):
            raise FormatError("a packet is cut off")
        if code >= 0xC0 or code == 0xBD:
            start = _elementary(raw, at + 6, end)
            out.append({"packet_no": len(out), "stream_id": code, "payload_offset": start, "payload_size": end - start})
        at = end
    return out


def build_program(packets: list[tuple[int, bytes, float]], sector: int = 2048) -> bytes:
    """A first-generation program stream: a pack for each packet, its clock at 90 kHz, sectors filled up."""
    out = bytearray()
    for ident, payload, seconds in packets:
        clock = int(seconds * 90000 + 0.5)
        stamp = bytes([0x21 | clock >> 29 & 0xE, clock >> 22 & 0xFF, clock >> 14 & 0xFE | 1, clock >> 7 & 0xFF, clock << 1 & 0xFE | 1])
        pack = b"\0\0\1\xba" + stamp + b"\x80\0\1"
        body = b"\0\0\1" + bytes([ident]) + struct.pack(">H", 1 + len(payload)) + b"\x0f" + payload
        fill = -(len(pack) + len(body)) % sector
        out += pack + body
        if fill >= 7:
            out += b"\0\0\1\xbe" + struct.pack(">H", fill - 6) + b"\xff" * (fill - 6)
    return bytes(out + b"\0\0\1\xb9")
