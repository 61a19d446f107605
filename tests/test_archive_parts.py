import pytest
from lodestone.sources import files, ranges, sinks
from pyspark.sql import functions as F

ROWS = [("a", 3, "x/B", b"12345"), ("a", 1, "X/a", b""), ("a", 2, "x\\c", b"9" * 2049), ("a", 4, "q", None), ("b/..", 7, "one", b"z"), ("b/..", 8, "two", b"yy")]


@pytest.mark.parametrize("kind", ["cpk", "afs", "awb", "acx"])
def test_pieces_make_the_same_archive(spark, kind):
    """Written piece by piece, no task holding a file, archives have the bytes that the builders give, and are read back by ranges."""
    df = spark.createDataFrame(ROWS, "file string, id long, path string, raw binary")
    order, name = ("path" if kind == "cpk" else "id"), ("path" if kind == "afs" else None)
    folder = sinks.save_parts(sinks.archive_parts(df, "file", kind, order, "raw", name))
    whole = {"cpk": lambda: sinks.package(df, "file", "path", "raw"), "afs": lambda: sinks.slots(df, "file", "id", "path", "raw"), "awb": lambda: sinks.bank(df, "file", "id", "raw"), "acx": lambda: sinks.pairs(df, "file", "id", "raw")}[kind]()
    want = {bytes(r.content) for r in whole.collect()}
    assert {bytes(r.content) for r in files.files(spark, folder).filter("NOT file LIKE '%manifest%'").collect()} == want
    named = df.select("file", sinks.stored_as(F.col("file")).alias("stored")).distinct()
    got = {(r.file, r.pos, r.file_size, bytes(r.payload)) for r in files.stored_entries(folder, named, kind).collect()}
    assert got == {(r.file, r.pos, r.file_size, bytes(r.payload)) for r in files.archive_entries(whole, kind, payload=True).collect()}


def test_pieces_of_nothing(spark):
    df = spark.createDataFrame([], "file string, id long, raw binary")
    folder = sinks.save_parts(sinks.archive_parts(df, "file", "acx", "id", "raw"))
    named = df.select("file", sinks.stored_as(F.col("file")).alias("stored"))
    assert files.stored_entries(folder, named, "acx").count() == 0


def test_reads_and_batches_are_bounded():
    """Ranges next to each other are not all read at once."""
    asked = []
    read = lambda at, n: asked.append(n) or bytes(n)
    assert [len(x) for x in ranges.read_ranges(read, [(10 * i, 10) for i in range(100)] + [(1000, 500)], most=100)] == [10] * 100 + [500]
    assert max(asked) == 500 and sorted(asked)[-2] <= 100


def test_archives_in_archives_are_windows(spark):
    """Packages of stored banks have the bytes that the builders give, and their entries are found without holding an archive."""
    df = spark.createDataFrame([(k, i, bytes([65 + i]) * (40_000 * i)) for k in ("p|a", "p|B", "q|a") for i in range(5)], "key string, id long, raw binary")
    folder = sinks.save_parts(sinks.archive_parts(df, "key", "awb", "id", "raw"))
    part = F.split("key", r"\|")
    names = df.select("key", sinks.stored_as(F.col("key")).alias("file")).distinct()
    banks = names.join(ranges.manifest(spark, folder), "file").select(part[0].alias("top"), part[1].alias("path"), F.concat(F.lit(folder + "/"), "file").alias("place"), "bytes")
    packages = sinks.save_parts(sinks.package_parts(banks, "top", "path", "place", "bytes"))
    whole = sinks.package(sinks.bank(df, "key", "id", "raw").select(F.split("file", r"\|")[0].alias("key"), F.split("file", r"\|")[1].alias("path"), "content"), "key", "path", "content")
    assert {bytes(r.content) for r in files.files(spark, packages).filter("NOT file LIKE '%manifest%'").collect()} == {bytes(r.content) for r in whole.collect()}
    stored = banks.select(F.col("top").alias("file"), sinks.stored_as(F.col("top")).alias("stored")).distinct()
    found = files.stored_nested(packages, stored)
    want = files.nested_entries(whole)
    assert found.columns == want.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 3 + 15


def test_nested_entries_hold_no_archive(spark, monkeypatch):
    from lodestone.plans import catalog, walks  # noqa: F401

    monkeypatch.setattr(sinks, "built", None)
    assert catalog.QUERIES["nested_entries"](spark, "/root/testdata/sf0.001").count() > 200
