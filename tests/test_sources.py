"""Readers over files on disk, the data source, saving, and errors as rows."""

from pyspark.sql import functions as F

from lodestone.codecs import archives, stream
from lodestone.operators import layout
from lodestone.sources import datasource, files, sinks


def test_files_are_found_and_parsed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.cpk").write_bytes(archives.build_package([("x/1", b"one"), ("x/2", b"two" * 999)]))
    (tmp_path / "in" / "b.awb").write_bytes(archives.build_bank([(7, b"seven")]))
    (tmp_path / "in" / "bad.bin").write_bytes(b"nothing")
    found = files.files(spark, str(tmp_path / "in"))
    rows = files.archive_entries(found, payload=True, errors="row").collect()
    assert {(r.file.rsplit("/", 1)[1], bytes(r.payload)) for r in rows if r.error is None} == {("a.cpk", b"one"), ("a.cpk", b"two" * 999), ("b.awb", b"seven")}
    assert [r.file.rsplit("/", 1)[1] for r in rows if r.error] == ["bad.bin"]
    datasource.register(spark)
    (tmp_path / "in" / "bad.bin").unlink()
    listed = spark.read.format("lodestone").load(f"file://{tmp_path}/in")
    assert sorted(r.file_size for r in listed.collect()) == [3, 5, 2997]


def test_saved_files_stay_inside(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.bin", bytearray(b"1")), ("../../c.bin", bytearray(b"22"))], "file string, content binary")
    done = sinks.save(rows, str(tmp_path / "out")).collect()
    assert sorted(r.bytes for r in done) == [1, 2] and not any(r.error for r in done)
    assert (tmp_path / "out" / "c.bin").read_bytes() == b"22" and (tmp_path / "out" / "a" / "b.bin").exists()


def test_program_packets(spark):
    raw = stream.build_program([(0xE0, b"v" * 100, 0.0), (0xC0, b"a" * 50, 0.04), (0xE0, b"w" * 3000, 0.08)])
    blobs = spark.createDataFrame([("f", bytearray(raw))], "file string, content binary")
    rows = files.program_packets(blobs).orderBy("packet_no").collect()
    assert [(r.stream_id, raw[r.payload_offset :][: r.payload_size]) for r in rows if r.stream_id != 0xBE] == [(0xE0, b"v" * 100), (0xC0, b"a" * 50), (0xE0, b"w" * 3000)]


def test_alignment_of_listed_entries(spark):
    raw = archives.build_slots([b"x" * 10, b"y" * 5000, None, b"z"], step=512)
    blobs = spark.createDataFrame([("f", bytearray(raw))], "file string, content binary")
    assert layout.gcd_of(files.archive_entries(blobs), "file_offset", ["file"]).first().gcd % 512 == 0


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "file string, content binary")
    assert files.archive_entries(none).count() == 0 and files.table_rows(none).count() == 0
    assert sinks.package(spark.createDataFrame([], "f string, p string, b binary"), "f", "p", "b").count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1
