"""Checksums, bit readers and legacy text on bytes."""

from __future__ import annotations

#: Encodings tried for text of unknown origin, in order (fixed values).
ENCODINGS = ("utf-8", "cp932", "euc_jp", "gb18030", "cp949", "latin-1")


def crc16(raw: bytes, seed: int = 0, polynomial: int = 0x8005) -> int:
    """CRC-16, most significant bit first."""
    crc = seed
    for b in raw:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ (polynomial if crc & 0x8000 else 0)) & 0xFFFF
    return crc


def checksum769(raw: bytes, seed: int = 0) -> int:
    """The archive checksum: a polynomial in 769 over 32 bits; 0 counts as 1; complement."""
    crc = seed
    for b in raw:
        crc = crc * 769 + b & 0xFFFFFFFF
    return ~(crc or 1) & 0xFFFFFFFF


def take_bits(raw: bytes, widths: list[int]) -> list[int]:
    """Unsigned numbers of the given widths, most significant bit first."""
    whole, left, out = int.from_bytes(raw, "big"), 8 * len(raw), []
    for w in widths:
        left -= w
        if left < 0:
            raise ValueError("not enough bits")
        out.append(whole >> left & (1 << w) - 1)
    return out


def guess_text(raw: bytes) -> tuple[str, str]:
    """(encoding, text): the encoding whose text has the most letters and the fewest control and private characters."""
    best = None
    for order, name in enumerate(ENCODINGS):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        bad = sum((c < " " and c not in "\t\r\n") or "" <= c <= "" or "\x7f" <= c <= "\x9f" for c in text)
        odd = sum("｡" <= c <= "ﾟ" for c in text)
        key = (10 * bad + odd, order)
        if best is None or key < best[0]:
            best = (key, name, text)
    return best[1], best[2]


def u16_list(raw: bytes, counted: bool = False) -> list[int]:
    """Big-endian 16-bit numbers of a blob; a counted list has their number first."""
    n = int.from_bytes(raw[:2], "big") if counted else len(raw) // 2
    at = 2 if counted else 0
    return [int.from_bytes(raw[i : i + 2], "big") for i in range(at, min(len(raw) - 1, at + 2 * n), 2)]
