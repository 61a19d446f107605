"""Backward dictionary compression: the first 256 bytes are stored, the rest is rebuilt from its end."""

from __future__ import annotations

import struct

import numpy as np

from lodestone.codecs.table import FormatError

MAGIC, HEAD, PREFIX = b"CRILAYLA", 16, 256
#: Widths in bits of the length fields, read until one is not full (fixed values).
LENGTH_BITS = (2, 3, 5)
LEAST, OFFSET_BITS = 3, 13
#: Bytes by which earlier places are looked up, and places of each that are tried for a match of so many bytes at most.
GRAMS, TRIES, MOST = (8, 6, 4, 3), 32, 2000
LITERALS = ["0" + format(b, "08b") for b in range(256)]
VALUES = {format(b, "08b"): b for b in range(256)}


def _length(rest: int) -> str:
    """The digits of a length above LEAST."""
    out = ""
    for width in LENGTH_BITS:
        part = min(rest, (1 << width) - 1)
        out += format(part, f"0{width}b")
        rest -= part
        if part != (1 << width) - 1:
            return out
    return out + "11111111" * (rest // 255) + format(rest % 255, "08b")


OFFSETS = ["1" + format(at, f"0{OFFSET_BITS}b") for at in range(1 << OFFSET_BITS)]
LENGTHS = [_length(rest) for rest in range(MOST - LEAST + 1)]


def decompress(raw: bytes) -> bytes:
    """The original bytes; raises FormatError for streams that end early or point outside the output."""
    if len(raw) < HEAD + PREFIX or raw[:8] != MAGIC:
        raise FormatError("not a compressed payload")
    size, packed = struct.unpack_from("<II", raw, 8)
    if HEAD + packed + PREFIX > len(raw):
        raise FormatError("the payload is cut off")
    total = 8 * packed
    # the last byte comes first; as digits, since wide integers make single shifts slow. Zeros behind the end are read, then told
    bits = format(int.from_bytes(raw[HEAD : HEAD + packed], "little"), f"0{total}b") * (packed > 0) + "0" * 64
    back, p = bytearray(), 0  # output from its end
    while len(back) < size:
        if bits[p] == "0":
            p += 9
            if p > total:
                raise FormatError("the bit stream ends early")
            back.append(VALUES[bits[p - 8 : p]])
            continue
        offset, length = int(bits[p + 1 : p + 1 + OFFSET_BITS], 2) + LEAST, LEAST
        p += 1 + OFFSET_BITS
        for width in LENGTH_BITS:
            part = int(bits[p : p + width], 2)
            p += width
            length += part
            if part != (1 << width) - 1:
                break
        else:
            part = 255
            while part == 255:
                part = VALUES[bits[p : p + 8]]
                p += 8
                length += part
        if p > total:
            raise FormatError("the bit stream ends early")
        if offset > len(back):
            raise FormatError("a reference points outside the output")
        length = min(length, size - len(back))
        piece = back[len(back) - offset : len(back) - offset + length]
        back += (piece * (length // offset + 1))[:length]
    return raw[HEAD + packed : HEAD + packed + PREFIX] + bytes(back[::-1])


def _earlier(body: bytes) -> list[list[int]]:
    """For each of GRAMS and each place the last one before it at which as many bytes are the same, or -1."""
    b = np.frombuffer(body, np.uint8).astype(np.uint64)
    out = []
    for n in GRAMS:
        before = np.full(len(b), -1, np.int64)
        if len(b) > n:
            codes = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                codes = codes << np.uint64(8) | b[k : len(b) - n + 1 + k]
            # by hash, then place; of two grams with one hash a place may find none before it
            order = np.sort(codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32) << np.uint64(32) | np.arange(len(codes), dtype=np.uint64))
            order = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
            same = codes[order[1:]] == codes[order[:-1]]
            before[order[1:][same]] = order[:-1][same]
        out.append(before.tolist())
    return out


def compress(data: bytes) -> bytes:
    """Greedy matches of the longest recent occurrence; inputs up to the prefix are returned as they are.

    Places that share more bytes are tried first, and where some do no others are.
    """
    if len(data) <= PREFIX:
        return data
    body = data[PREFIX:][::-1]
    out: list[str] = []
    earlier = _earlier(body)
    least = earlier[-1]
    i, reach, end = 0, (1 << OFFSET_BITS) - 1 + LEAST, len(body)
    while i < end:
        best, at, low = 0, 0, max(0, i - reach)
        if least[i] >= low:
            most = min(MOST, end - i)
            for before in earlier:
                j, tries = before[i], TRIES
                while j >= low and tries and best < most:
                    # longer than what was found only if the byte behind that fits as well
                    if i - j >= LEAST and (not best or body[j + best] == body[i + best]):
                        n = LEAST
                        while n + 32 <= most and body[j + n : j + n + 32] == body[i + n : i + n + 32]:
                            n += 32
                        while n < most and body[j + n] == body[i + n]:
                            n += 1
                        if n > best:
                            best, at = n, i - j
                    j, tries = before[j], tries - 1
                if best:
                    break
        if best >= LEAST:
            out.append(OFFSETS[at - LEAST])
            out.append(LENGTHS[best - LEAST])
        else:
            best = 1
            out.append(LITERALS[body[i]])
        i += best
    bits = "".join(out)
    bits += "0" * (-len(bits) % 32)
    packed = int(bits, 2).to_bytes(len(bits) // 8, "little")
    made = MAGIC + struct.pack("<II", len(body), len(packed)) + packed + data[:PREFIX]
    return made if len(made) < len(data) else data
