"""Block ADPCM audio: header, decoding and encoding, vectorised over tracks and blocks where state allows."""

from __future__ import annotations

import math
import struct

import numpy as np

from lodestone.codecs.table import FormatError

SIGNATURE = b"(c)CRI"


def parse_header(raw: bytes) -> dict:
    if len(raw) < 20 or raw[:2] != b"\x80\x00":
        raise FormatError("the magic is not that of block audio")
    offset, mode, block, bits, channels, rate, samples, highpass, version, flags = struct.unpack_from(">HBBBBIIHBB", raw, 2)
    if mode not in (2, 3, 4, 0x10, 0x11):
        raise FormatError(f"unknown mode {mode}")
    if not channels or not rate:
        raise FormatError("no channels or no rate")
    return {"data_offset": offset + 4, "mode": mode, "block": block, "bits": bits, "channels": channels, "rate": rate, "samples": samples, "highpass": highpass, "version": version, "flags": flags}


def coefficients(highpass: int, rate: int) -> tuple[int, int]:
    """Prediction weights in 1/4096 of the two samples before, from the cut-off of the high-pass filter."""
    a, b = math.sqrt(2) - math.cos(2 * math.pi * highpass / rate), math.sqrt(2) - 1
    c = (a - math.sqrt((a + b) * (a - b))) / b
    return int(c * 8192), int(c * c * -4096)


def decode(raw: bytes) -> tuple[np.ndarray, dict]:
    """(samples x channels) of 16-bit PCM and the header. The predictor runs along a track; channels run abreast."""
    h = parse_header(raw)
    if h["mode"] not in (3, 4) or h["bits"] != 4 or h["block"] != 18:
        raise FormatError("only 4-bit blocks of 18 bytes with a computed predictor are decoded")
    n, blocks = h["channels"], -(-h["samples"] // 32)
    body = np.frombuffer(raw, np.uint8, offset=min(h["data_offset"], len(raw)))
    if len(body) < blocks * n * 18:
        raise FormatError("blocks are cut off")
    frames = body[: blocks * n * 18].reshape(blocks, n, 18)
    stored = frames[..., 0].astype(np.int64) << 8 | frames[..., 1]
    scale = (stored & 0x1FFF) + 1 if h["mode"] == 3 else np.left_shift(1, np.clip(12 - stored, 0, 12))
    nibbles = np.stack([frames[..., 2:] >> 4, frames[..., 2:] & 15], -1).reshape(blocks, n, 32).astype(np.int64)
    steps = ((nibbles ^ 8) - 8) * scale[..., None]
    steps = steps.transpose(0, 2, 1).reshape(blocks * 32, n)
    c1, c2 = coefficients(h["highpass"], h["rate"])
    out = np.empty((h["samples"], n), np.int16)
    s1 = s2 = np.zeros(n, np.int64)
    by_term = h["version"] == 3  # that version rounds each term of the prediction
    for i in range(h["samples"]):
        guess = (c1 * s1 >> 12) + (c2 * s2 >> 12) if by_term else (c1 * s1 + c2 * s2) >> 12
        s1, s2 = np.clip(steps[i] + guess, -32768, 32767), s1
        out[i] = s1
    return out, h


def encode(pcm: np.ndarray, rate: int, highpass: int = 500) -> bytes:
    """Blocks of 32 samples, each with the least scale that holds its residuals; the decoder's state is followed."""
    samples, n = pcm.shape
    c1, c2 = coefficients(highpass, rate)
    s1 = s2 = np.zeros(n, np.int64)
    body = bytearray()
    for at in range(0, samples, 32):
        part = np.zeros((32, n), np.int64)
        part[: min(32, samples - at)] = pcm[at : at + 32]
        before = np.concatenate([s2[None], s1[None], part])
        residual = part - ((c1 * before[1:-1] + c2 * before[:-2]) >> 12)
        scale = np.clip(np.ceil(np.maximum(residual.max(0) / 7, -residual.min(0) / 8)), 1, 0x2000).astype(np.int64)
        codes = np.empty((32, n), np.int64)
        for i in range(32):
            guess = (c1 * s1 + c2 * s2) >> 12
            codes[i] = np.clip(np.rint((part[i] - guess) / scale), -8, 7)
            s1, s2 = np.clip(codes[i] * scale + guess, -32768, 32767), s1
        packed = ((codes[0::2] & 15) << 4 | codes[1::2] & 15).astype(np.uint8)
        for c in range(n):
            body += struct.pack(">H", int(scale[c]) - 1) + packed[:, c].tobytes()
    offset = 0x20
    head = b"\x80\x00" + struct.pack(">HBBBBIIHBB", offset, 3, 18, 4, n, rate, samples, highpass, 4, 0)
    return head.ljust(offset + 4 - len(SIGNATURE), b"\0") + SIGNATURE + bytes(body) + b"\x80\x01" + struct.pack(">H", 14) + bytes(14)
