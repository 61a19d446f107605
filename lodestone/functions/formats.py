"""What bytes are: candidate formats, payload codecs, presets, command meanings, and plain text forms, as columns.

Everything works on the upper-case hex of a payload's first bytes (``head``), so a scan never decodes a payload in
Python to name it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import trim_ascii

#: Readers tried when nothing fits the first bytes, in order.
FALLBACK = ("cvm", "cpk", "usm", "awb", "afs", "aix", "csb", "acb", "aax", "sfd", "acx", "adx", "hca", "utf", "wav")
#: Label and extension of each payload codec.
CODECS = {
    "hca": ("HCA audio", ".hca"),
    "hca-mx": ("HCA-MX audio", ".hcamx"),
    "adx": ("ADX audio", ".adx"),
    "ahx": ("AHX audio", ".ahx"),
    "lpcm": ("software LPCM audio", ".swlpcm"),
    "ds-adpcm": ("Nintendo DS ADPCM audio", ".dsadpcm"),
    "dsp": ("Nintendo DSP audio", ".dsp"),
    "wii-adpcm": ("Wii ADPCM audio", ".wiiadpcm"),
    "wiiu-adpcm": ("Wii U ADPCM audio", ".wiiuadpcm"),
    "vag": ("VAG audio", ".vag"),
    "hevag": ("HEVAG audio", ".vag"),
    "atrac3": ("ATRAC3 audio", ".at3"),
    "3ds-adpcm": ("Nintendo 3DS ADPCM audio", ".3dsadpcm"),
    "atrac9": ("ATRAC9 audio", ".at9"),
    "xma2": ("XMA2 audio", ".xma2"),
    "switch-opus": ("Switch Opus audio", ".switchopus"),
    "m4a": ("AAC/M4A audio", ".m4a"),
    "adts": ("AAC/ADTS audio", ".aac"),
    "vorbis": ("Ogg/Vorbis audio", ".ogg"),
    "opus": ("Ogg/Opus audio", ".opus"),
    "speex": ("Ogg/Speex audio", ".spx"),
    "ogg": ("Ogg audio", ".ogg"),
    "wav": ("WAV audio", ".wav"),
    "flac": ("FLAC audio", ".flac"),
    "mp3": ("MP3 audio", ".mp3"),
    "unknown": ("audio", ".bin"),
}
#: Kinds of sequences and of references.
SEQUENCES = {0: "polyphonic", 1: "sequential", 2: "shuffle", 3: "random", 4: "random_no_repeat", 5: "switch_game_variable", 6: "combo_sequential", 7: "switch_selector", 8: "track_transition_by_selector"}
REFERENCES = {0: "none", 1: "waveform", 2: "synth", 3: "sequence", 5: "outside_link", 6: "direct_synth", 7: "direct_sequence", 8: "block_sequence", 9: "direct_block_sequence", 11: "special_11", 12: "special_12"}
#: Fixed values: (code, bytes of the value or None for any, meaning) of parameter and of event commands.
PARAMETERS = (
    (0, None, "terminator"), (33, None, "mute"), (65, None, "category_information"), (72, None, "runtime_counter_add"), (79, None, "cue_limit_information"), (81, None, "runtime_flag_write"),
    (98, None, "sequence_wait_item"), (99, 2, "selector_name"), (100, 4, "selector_condition"), (111, None, "bus_send_by_name"), (120, None, "sequence_wait_timer"), (124, None, "stop_at_loop_end"),
)
EVENTS = (
    (0, None, "terminator"), (997, None, "sequence_start_milliseconds"), (998, None, "sequence_start_random"), (999, None, "sequence_start"), (2001, 4, "wait_milliseconds"), (2005, 2, "wait_submillisecond"),
    (4000, None, "midi_event"), (4050, None, "end_track_event"), (7099, None, "start_action"), (7100, None, "start_action"), (7101, None, "stop_action"), (7102, None, "mute"), (7104, 4, "set_selector_label"),
    (7107, None, "playback_parameter"), (7108, None, "pause_action"), (7109, None, "resume_action"), (7110, None, "stop_action_parameterized"), (7111, None, "pause_action"), (7112, None, "resume_action"),
    (7113, 2, "set_next_block"), (7115, 2, "set_selector_label"),
)


def _mapped(values: dict, code: Column, missing: str) -> Column:
    pairs = itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items())
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(missing))


def sequence_name(kind: Column) -> Column:
    return _mapped(SEQUENCES, kind.cast("int"), "unknown")


def reference_name(kind: Column) -> Column:
    return _mapped(REFERENCES, kind.cast("int"), "unknown")


def codec_label(codec: Column) -> Column:
    return _mapped({k: v[0] for k, v in CODECS.items()}, codec, "audio")


def codec_extension(codec: Column) -> Column:
    return _mapped({k: v[1] for k, v in CODECS.items()}, codec, ".bin")


def number(head: Column, at: int | Column, size: int, little: bool = False) -> Column:
    """``size`` bytes of a hex text from byte ``at`` as a number; null past its end. Sizes up to seven bytes."""
    at = F.lit(at) if isinstance(at, int) else at.cast("int")
    digits = F.substr(head, at * 2 + 1, F.lit(2 * size))
    if little:
        pairs = [F.substr(head, (at + k) * 2 + 1, F.lit(2)) for k in reversed(range(size))]
        digits = F.concat(*pairs)
    return F.when(F.length(head) >= (at + size) * 2, F.conv(digits, 16, 10).cast("long"))


def _begins(head: Column, magic: bytes, at: int = 0) -> Column:
    return F.substr(head, F.lit(2 * at + 1), F.lit(2 * len(magic))) == magic.hex().upper()


def candidate_formats(head: Column) -> Column:
    """Formats whose readers are to be tried, in order; all of FALLBACK if the first bytes say nothing."""
    clear = F.concat(*[F.lpad(F.hex(number(head, k, 1).bitwiseAND(F.lit(0x7F))), 2, "0") for k in range(4)])
    checks = [
        (_begins(head, b"CVMH"), ("cvm",)), (_begins(head, b"CPK "), ("cpk",)), (_begins(head, b"CRID") | _begins(head, b"SFSH"), ("usm",)), (_begins(head, b"AFS2"), ("awb",)), (_begins(head, b"AFS\0"), ("afs",)),
        (_begins(head, b"AIXF"), ("aix",)), (_begins(head, b"@UTF"), ("csb", "acb", "aax", "utf")), (_begins(head, b"\0\0\1\xba"), ("sfd",)), (_begins(head, b"\x80\0") & (F.length(head) >= 8), ("adx",)), (clear == "48434100", ("hca",)),
        (_begins(head, b"RIFF") & _begins(head, b"WAVE", 8), ("wav",)), (_begins(head, bytes(4)) & (number(head, 4, 4) > 0), ("acx",)),
    ]
    none = F.array().cast("array<string>")
    found = F.concat(*[F.when(F.coalesce(hit, F.lit(False)), F.array(*map(F.lit, kinds))).otherwise(none) for hit, kinds in checks])
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, FALLBACK)))


def _wave_codec(head: Column) -> Column:
    """Codec of a wave file by its format chunk, which is sought chunk by chunk."""
    step = lambda at, _: F.when(_at(head, at, "666D7420"), at).otherwise(
        F.coalesce(at + 8 + number(head, at + 4, 4, True) + F.pmod(number(head, at + 4, 4, True), F.lit(2)), at)
    )
    at = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(12).cast("long"), step)
    kind = number(head, at + 8, 2, True)
    guid = F.substr(head, ((at + 32) * 2 + 1).cast("int"), F.lit(32)) == "D242E147BA368D4D88FC61654F8C836C"
    return F.when(~_at(head, at, "666D7420"), "wav").when(kind == 0x0270, "atrac3").when(kind == 0x0166, "xma2").when((kind == 0xFFFE) & (number(head, at + 4, 4, True) >= 40) & guid, "atrac9").otherwise("wav")


def _at(head: Column, at: Column, digits: str) -> Column:
    return F.substr(head, (at * 2 + 1).cast("int"), F.lit(len(digits))) == digits


def _ogg_codec(head: Column) -> Column:
    at = 27 + number(head, 26, 1)
    is_ = lambda word, skip=0: _at(head, at + skip, word.hex().upper())
    return F.when(is_(b"OpusHead"), "opus").when(_at(head, at, "01") & is_(b"vorbis", 1), "vorbis").when(is_(b"Speex   "), "speex").otherwise("ogg")


def payload_codec(head: Column) -> Column:
    """Codec of an audio payload by its first bytes (as hex, some 400 bytes of it): the first rule that fits."""
    n = F.length(head)
    byte = lambda k: number(head, k, 1)
    dsp = (n >= 0x54 * 2) & number(head, 8, 4).between(8000, 48000) & (number(head, 14, 2) == 0) & (number(head, 24, 4) == 2) & (number(head, 80, 4) == 0)
    mp3 = (byte(0) == 0xFF) & (byte(1).bitwiseAND(F.lit(0xE0)) == 0xE0)
    version, layer = F.shiftright(byte(1), 3).bitwiseAND(F.lit(3)), F.shiftright(byte(1), 1).bitwiseAND(F.lit(3))
    rate, sampling = F.shiftright(byte(2), 4), F.shiftright(byte(2), 2).bitwiseAND(F.lit(3))
    frame = mp3 & (version != 1) & (layer != 0) & ~rate.isin(0, 15) & (sampling != 3)
    hca = (byte(0).bitwiseAND(F.lit(0x7F)) == 0x48) & (byte(1).bitwiseAND(F.lit(0x7F)) == 0x43) & (byte(2).bitwiseAND(F.lit(0x7F)) == 0x41) & (byte(3).bitwiseAND(F.lit(0x7F)) == 0)
    rules = [
        (hca, F.lit("hca")), ((n >= 10) & _begins(head, b"\x80\0") & byte(4).isin(0x10, 0x11), F.lit("ahx")), ((n >= 10) & _begins(head, b"\x80\0"), F.lit("adx")), (_begins(head, b"VAGp"), F.lit("vag")),
        (_begins(head, b"CWAV"), F.lit("3ds-adpcm")), (_begins(head, b"CWAC"), F.lit("wiiu-adpcm")), (_begins(head, b"\1\0\0\x80"), F.lit("switch-opus")), (dsp, F.lit("dsp")), (_begins(head, b"ftyp", 4), F.lit("m4a")),
        ((byte(0) == 0xFF) & (byte(1).bitwiseAND(F.lit(0xF6)) == 0xF0), F.lit("adts")), (_begins(head, b"OggS"), _ogg_codec(head)), (_begins(head, b"RIFF") & _begins(head, b"WAVE", 8), _wave_codec(head)),
        (_begins(head, b"fLaC"), F.lit("flac")), (_begins(head, b"ID3"), F.lit("mp3")), (frame, F.lit("mp3")),
    ]
    out = F.lit("unknown")
    for hit, name in reversed(rules):
        out = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(out)
    return out


def aac_signature(head: Column) -> Column:
    """What tells masked AAC payloads apart: bytes 0 to 31 and 36 to 39; null for short or clear ones."""
    clear = payload_codec(head).isin("hca", "adx", "ahx", "m4a")
    return F.when((F.length(head) >= 80) & ~clear, F.concat(F.substr(head, F.lit(1), F.lit(64)), F.substr(head, F.lit(73), F.lit(8))))


def preset(toc: Column, itoc: Column, gtoc: Column, etoc: Column) -> Column:
    """Preset of a package by the indexes it has."""
    have = F.concat(*[F.when(c, "1").otherwise("0") for c in (toc, itoc, gtoc, etoc)])
    return _mapped({"0100": "id", "1001": "filename", "1101": "filename_id", "1011": "filename_group", "1110": "id_group", "1111": "filename_id_group"}, have, "custom")


def command_meaning(code: Column, size: Column, parameters: Column) -> Column:
    """What a command does, by its code and the bytes of its value; ``parameters`` tells parameter lists from events."""
    out = F.lit("unknown")
    for listed, which in ((PARAMETERS, parameters), (EVENTS, ~parameters)):
        for c, n, name in listed:
            hit = which & (code == c)
            out = F.when(hit & (size == n) if n is not None else hit, name).otherwise(out)
    return out


def command_wait(code: Column, value: Column) -> Column:
    """Microseconds by which an event command moves its stream's clock; null for all others. ``value`` is hex."""
    short = number(value, 0, 2)
    signed = F.when(short >= 0x8000, short - 0x10000).otherwise(short)
    return F.when((code == 2001) & (F.length(value) == 8), number(value, 0, 4) * 1000).when((code == 2005) & (F.length(value) == 4), signed)


def crc16(data: Column, seed: int = 0, polynomial: int = 0x8005) -> Column:
    """CRC-16 of bytes or text, most significant bit first."""
    digits = F.hex(data.cast("binary"))
    table = F.array(*[F.lit(x) for x in _crc_table(polynomial)])
    byte = lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("int")
    step = lambda s, i: F.shiftleft(s.bitwiseAND(F.lit(0xFF)), 8).bitwiseXOR(F.get(table, F.shiftright(s, 8).bitwiseXOR(byte(i))))
    return F.when(F.length(digits) < 2, F.lit(seed)).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), F.lit(seed), step))


def _crc_table(polynomial: int) -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ (polynomial if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


def u16_list(data: Column) -> Column:
    """Big-endian 16-bit numbers of a blob; an odd last byte is left out."""
    digits = F.hex(data.cast("binary"))
    n = F.floor(F.length(digits) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def unsigned(c: Column, bits: int = 32) -> Column:
    """A decimal or 0x number in a text; null if it is none or takes more bits (up to 63)."""
    t = trim_ascii(c)
    parsed = F.when(F.regexp_like(t, F.lit("^0[xX][0-9A-Fa-f]{1,15}$")), F.conv(F.substr(t, F.lit(3)), 16, 10).try_cast("long")).when(F.regexp_like(t, F.lit("^[0-9]{1,18}$")), t.try_cast("long"))
    return F.when(parsed < F.lit(1 << bits if bits < 63 else (1 << 63) - 1), parsed)


def json_quoted(c: Column) -> Column:
    """A text in JSON quotes; control characters, quotes and backslashes escaped."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
