"""Packets across rows, names by routes, reader attempts and nested archives, against row-by-row versions."""

import random

from lodestone.codecs import archives, media, stream
from lodestone.codecs import table as tables
from lodestone.operators import joins
from lodestone.operators import stream as streams
from lodestone.sources import files


def test_packets_span_rows(spark):
    rng = random.Random(1)
    rows = [(s, i, rng.randbytes(rng.choice([0, 1, 9, 10, 11, 95]))) for s in ("a", "b") for i in range(40)]
    rows += [("a", 40, None), ("c", 0, b""), ("d", 0, b"x" * 30)]
    df = spark.createDataFrame([(s, i, None if p is None else bytearray(p)) for s, i, p in rows], "s string, i int, p binary").repartition(5)
    expected = {}
    for name in "abd":
        whole = b"".join(p or b"" for s, _, p in sorted(rows, key=lambda r: (r[0], r[1])) if s == name)
        expected |= {(name, k // 10): whole[k : k + 10] for k in range(0, len(whole), 10)}
    assert {(r.s, r.packet_no): bytes(r.content) for r in streams.packets(df, "s", ["i"], "p", 10).collect()} == expected


def test_routes_by_priority(spark):
    hops = [(1, 1, 1, 10), (1, 2, 10, 20), (2, 1, 1, 30), (2, 1, 2, 30), (3, 1, 3, 40), (3, 2, 40, 50), (3, 3, 50, 60), (1, 1, 4, 11), (2, 1, 4, 31), (2, 1, 4, 32)]
    names = [(1, 2, 20, "two hops"), (2, 1, 30, "one hop"), (3, 3, 60, "three hops"), (2, 1, 31, "b"), (2, 1, 32, "a"), (1, 1, 11, None)]
    got = joins.routed(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "item long"), "item", spark.createDataFrame(hops, "route int, hop int, src long, dst long"), spark.createDataFrame(names, "route int, hop int, node long, name string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, "two hops"), (2, 2, "one hop"), (3, 3, "three hops"), (4, 2, "a"), (5, None, None), (5, None, None)], key=str)


def test_attempts_name_the_reader_that_got_furthest(spark):
    bank, package = archives.build_bank([(1, b"x" * 50), (2, b"y" * 60)]), archives.build_package([("a", b"1"), ("b", b"22")])
    made = {"bank": bank, "package": package, "cut bank": bank[:20], "cut package": package[:900], "text": b"no archive at all", "empty": b"", "chunks": stream.build_chunk("@SFV", b"1")[:-1]}
    readers = {"package": archives.PARSERS["cpk"], "bank": archives.PARSERS["awb"], "slots": archives.PARSERS["afs"], "table": tables.parse, "segments": media.parse_segments}
    blobs = spark.createDataFrame([(n, bytearray(b)) for n, b in made.items()], "file string, content binary")
    tried = files.attempted(blobs, {n: r for n, r in readers.items() if n in ("package", "bank", "slots")})
    assert tried.count() == 3 * len(made)
    got = {r.file: r for r in files.settled(tried).collect()}
    assert (got["bank"].reader, got["bank"].n_rows, got["package"].reader, got["package"].n_rows) == ("bank", 2, "package", 2)
    assert all(got[n].error and got[n].n_rows is None for n in made if n not in ("bank", "package"))
    assert got["cut bank"].reader == "bank" and got["cut package"].reader == "package"


def test_nested_archives(spark, monkeypatch):
    inner = archives.build_bank([(7, b"deep"), (8, b"deeper")])
    middle = archives.build_package([("in/bank.awb", inner), ("in/same.awb", inner), ("note.txt", b"text")])
    outer = archives.build_slots([middle, None, b"plain"])
    made = {"one": outer, "two": middle, "three": b"nothing", "broken": b"CPK " + bytes(100)}

    def walk(raw, path, depth):
        kind = archives.kind_of(raw[:16])
        if kind not in ("cpk", "awb", "afs"):
            return
        try:
            rows = archives.PARSERS[kind](raw)
        except ValueError:
            return
        for e in rows:
            part = raw[e["file_offset"] : e["file_offset"] + e["file_size"]]
            here = "/".join(x for x in (path, e["path"] or str(e["pos"])) if x)
            yield here, depth, len(part), archives.kind_of(part[:16]) if archives.kind_of(part[:16]) in ("cpk", "awb", "afs") else None
            yield from walk(part, here, depth + 1)

    expected = sorted(((n, *r) for n, raw in made.items() for r in walk(raw, "", 1)), key=str)
    got = files.nested_entries(spark.createDataFrame([(n, bytearray(b)) for n, b in made.items()], "file string, content binary"))
    assert sorted(((r.file, r.path, r.depth, r.size, r.kind) for r in got.collect()), key=str) == expected
    assert max(r[2] for r in expected) == 3
    assert files.nested_entries(spark.createDataFrame([], "file string, content binary")).count() == 0
