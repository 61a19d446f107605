"""Binary formats: round trips, hand-made bytes, and what must be refused."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.codecs import adx, archives, checks, compress, stream
from lodestone.codecs import table as tables
from lodestone.codecs.table import Column, FormatError, Table

ALL = Table(
    "All",
    [Column(f"c{k}", k) for k in range(0xD)],
    [[1, -1, 2, -2, 3, -3, 2**63, -4, 1.5, 2.5, "a", b"xy", bytes(range(16))], [2, -2, 3, -3, 4, -4, 1, -5, 2.5, 3.5, "b", b"", bytes(16)]],
)


@pytest.mark.parametrize("align", [1, 8, 32])
@pytest.mark.parametrize("version", [0, 1])
def test_all_types_round_trip(align, version):
    made = Table(ALL.name, ALL.columns, ALL.rows, version)
    assert tables.parse(tables.build(made, align)).rows == ALL.rows


def test_storage_follows_values():
    t = Table("t", [Column("none", 4), Column("same", 4), Column("rows", 4)], [[None, 7, 1], [None, 7, 2]])
    assert [c.flags for c in tables.parse(tables.build(t)).columns] == [0x10, 0x30, 0x50]
    one = Table("t", [Column("x", 4)], [[7]])
    assert tables.parse(tables.build(one)).columns[0].flags == 0x50


def test_row_storage_wins_over_default():
    t = Table("t", [Column("x", 4, 0x70, 9)], [[1], [2]])
    assert tables.parse(tables.build(t)).rows == [[1], [2]]


def test_strings_stand_once_and_blobs_each():
    t = Table("t", [Column("s", 0xA, 0x50), Column("b", 0xB, 0x50)], [["q", b"zz"], ["q", b"zz"]])
    raw = tables.build(t)
    assert raw.count(b"q\0") == 1 and raw.count(b"zz") == 2


@pytest.mark.parametrize("change", [(0, b"@XTF"), (8, b"\0\7"), (4, b"\xff\xff\xff\xff"), (10, b"\xff\xff"), (0x14, b"\0\0\xff\xff"), (0x18, b"\0\0"), (0x1C, b"\0\0\xff\xff")])
def test_bad_headers_are_refused(change):
    raw = bytearray(tables.build(ALL))
    raw[change[0] : change[0] + len(change[1])] = change[1]
    with pytest.raises(FormatError):
        tables.parse(bytes(raw))


def test_truncated_tables_are_refused():
    raw = tables.build(ALL)
    for n in range(0, len(raw), 7):
        with pytest.raises(FormatError):
            tables.parse(raw[:n])


def test_mask_is_its_own_inverse():
    m, keys = 0x655F, []
    for _ in range(1000):
        keys.append(m & 0xFF)
        m = m * 0x4115 & 0xFFFFFFFF
    assert tables.masked(bytes(1000)) == bytes(keys)
    assert tables.masked(tables.masked(b"abc" * 99)) == b"abc" * 99


def test_packages():
    given_ = [("b/Two", b"22"), ("a\\one", b"1" * 3000), ("a", b"")]
    raw = archives.build_package(given_)
    got = archives.parse_package(raw)
    assert [e["path"] for e in got] == ["a", "a/one", "b/Two"]
    assert [raw[e["file_offset"] :][: e["file_size"]] for e in got] == [b"", b"1" * 3000, b"22"]
    assert all(e["file_offset"] % 2048 == 0 for e in got)
    masked = bytearray(raw)
    size = struct.unpack_from("<I", raw, 8)[0]
    masked[4:8] = bytes(4)
    masked[16 : 16 + size] = tables.masked(raw[16 : 16 + size])
    assert archives.parse_package(bytes(masked)) == got
    with pytest.raises(FormatError):
        archives.parse_package(raw[:2100])


def test_banks_end_at_the_next_unaligned_offset():
    raw = archives.build_bank([(5, b"abc"), (300, b"d" * 40)], 32)
    got = archives.parse_bank(raw)
    assert [(e["entry_id"], raw[e["file_offset"] :][: e["file_size"]]) for e in got] == [(5, b"abc"), (300, b"d" * 40)]
    assert len(raw) == got[-1]["file_offset"] + 40
    for wide in (4, 8):
        for ids in (2, 4, 8):
            assert len(archives.parse_bank(archives.build_bank([(1, b"x")], 16, wide, ids))) == 1
    with pytest.raises(FormatError):
        archives.parse_bank(raw[:12] + b"\0\0" + raw[14:])


def test_slots_keep_empty_numbers():
    raw = archives.build_slots([b"x", None, b""], ["a", "b", "c"])
    assert [(e["present"], e["path"]) for e in archives.parse_slots(raw)] == [(True, "a"), (False, "b"), (True, "c")]
    assert archives.alignment([0, 2048, 6144]) == 2048


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(b"abc"), max_size=2500), st.integers(0, 900))
def test_compression_round_trip(letters, zeros):
    data = bytes(letters) + bytes(zeros)
    packed = compress.compress(data)
    assert packed == data or compress.decompress(packed) == data
    assert len(packed) <= len(data)


def test_cut_compression_is_refused():
    packed = compress.compress(b"abcabcabd" * 200)
    with pytest.raises(FormatError):
        compress.decompress(packed[:-1])
    with pytest.raises(FormatError):
        compress.decompress(packed[:8] + struct.pack("<II", 1 << 20, len(packed) - 272) + packed[16:])


def test_chunks_and_directory():
    cols = [Column("filename", 0xA, 0x50), Column("stmid", 4, 0x50), Column("chno", 2, 0x50)]
    head = lambda rows: stream.build_chunk("CRID", tables.build(Table("d", cols, rows)), kind="header")
    raw = head([["f", 0, 0], ["v", 0x40534656, 0]]) + stream.build_chunk("@SFV", b"12345", 3, time=9)
    got = stream.parse_chunks(raw)
    assert (got[1]["payload"], got[1]["channel"], got[1]["frame_time"], got[1]["payload_type"]) == (b"12345", 3, 9, "stream")
    assert stream.stream_directory(got)[1]["stream_id"] == "@SFV"
    with pytest.raises(FormatError):
        stream.stream_directory(stream.parse_chunks(head([["f", 0, 0], ["v", 1, 0], ["v", 1, 0]])))
    with pytest.raises(FormatError):
        stream.parse_chunks(raw[:-1])


def test_subtitles():
    cues = [{"cue_no": 0, "language_id": 2, "time_unit": 600, "start": 30, "duration": 60, "text": "é\nx", "terminators": 2}]
    assert stream.parse_subtitles(stream.build_subtitles(cues)) == cues
    srt = stream.parse_srt(stream.build_srt(cues))
    assert (srt[0]["start"], srt[0]["duration"], srt[0]["text"]) == (50, 100, "é\nx")
    with pytest.raises(FormatError):
        stream.parse_subtitles(struct.pack("<5I", 0, 0, 0, 0, 0))


def test_commands_stop_and_fail():
    assert [c["code"] for c in stream.parse_commands(b"\0\5\1x\0\0\0\0\7\0")] == [5]
    with pytest.raises(FormatError):
        stream.parse_commands(b"\0\5\4x")


def test_audio_blocks():
    x = (9000 * np.sin(np.arange(3000) / 25)).astype(np.int16)
    got, head = adx.decode(adx.encode(np.stack([x, x // 3], 1), 44100))
    assert got.shape == (3000, 2) and head["rate"] == 44100
    noise = got[64:].astype(int) - np.stack([x, x // 3], 1)[64:]
    assert np.sqrt((noise**2).mean()) < 200
    with pytest.raises(FormatError):
        adx.decode(adx.encode(np.zeros((100, 1), np.int16), 8000)[:60])


def test_checks():
    assert checks.checksum769(b"") == 0xFFFFFFFE and checks.checksum769(b"ab") == ~(97 * 769 + 98) & 0xFFFFFFFF
    assert checks.crc16(b"123456789") == 0xFEE8
    assert checks.take_bits(b"\xa5\xf0", [1, 3, 4, 8]) == [1, 2, 5, 0xF0]
    assert checks.guess_text("日本語テキスト".encode("cp932"))[1] == "日本語テキスト" and checks.guess_text(b"plain")[0] == "utf-8"
    assert checks.u16_list(b"\0\1\0\2\0\3") == [1, 2, 3] and checks.u16_list(b"\0\1\0\2\0\3", True) == [2]
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(99))
    assert stream.parse_wav(stream.build_wav(raw + b"\0", 8000, 1))["samples"] == 50


def test_nested_containers():
    from lodestone.codecs import media

    tone = adx.encode(np.zeros((64, 1), np.int16), 8000)
    assert [(s["samples"], s["loops"]) for s in media.parse_segments(media.build_segments([(tone, False), (tone, True)]))] == [(64, False), (64, True)]
    with pytest.raises(FormatError):
        media.parse_segments(media.build_segments([(tone, False), (adx.encode(np.zeros((64, 1), np.int16), 16000), True)]))
    made = media.build_elements([{"name": "a/b", "data": tone, "fmt": 0, "nch": 1, "stmflg": 0, "sfreq": 8000, "nsmpl": 64}])
    assert media.parse_elements(made)[0]["path"] == "a/b"
    assert [t["place"] for t in media.nested_tables(made)] == ["", "/utf[0]"]
    assert media.parse_ass("Dialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,{\\i1}Hi\\Nyou, too")[0]["text"] == "Hi\nyou, too"


def test_transform_header():
    from lodestone.codecs import media

    body = b"HCA\0" + struct.pack(">HH", 0x200, 8 + 16 + 16 + 6 + 2) + b"fmt\0" + struct.pack(">IIHH", 2 << 24 | 48000, 10, 128, 0)
    body += b"comp" + struct.pack(">HBBBBBBBBBB", 512, 1, 15, 1, 0, 100, 100, 0, 0, 0, 0) + b"ciph" + struct.pack(">H", 56)
    raw = body + struct.pack(">H", checks.crc16(body))
    head = media.parse_transform_header(raw)
    assert (head["channels"], head["rate"], head["samples"], head["cipher"], head["frame_size"]) == (2, 48000, 10112, 56, 512)
    with pytest.raises(FormatError):
        media.parse_transform_header(raw[:-1] + b"\xff")
