"""Split chunk files, pushed filters, payload ranges, and files that are committed at once."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from lodestone.codecs import stream
from lodestone.sources import ranges


def media(n=300, size=2000):
    """A chunk file whose payloads hold magics and cut-off headers."""
    tricky = stream.build_chunk("@SFV", b"inner" * 9)[:40]
    out = stream.build_chunk("CRID", b"directory", kind="header")
    for i in range(n):
        body = (b"%d@SFV" % i + tricky + b"@SFA" * 3) * (1 + i % 5) + bytes(i % 251 for _ in range(size))
        out += stream.build_chunk(("@SFV", "@SFA", "@SBT")[i % 3], body, i % 2, time=i)
    return out


def rows_of(reader, raw, count=None):
    """Rows of all partitions, and the bytes that were read."""
    read = []

    def at(a, n):
        read.append(min(n, len(raw) - a))
        return raw[a : a + n]

    found = [r for p in reader.partitions() for r in ranges.chunks(at, p, reader.wanted, reader.payload)]
    return found, sum(read)


def test_every_split_finds_its_chunks(tmp_path):
    raw = media()
    (tmp_path / "a.bin").write_bytes(raw)
    expected = [(c["chunk_offset"], c["magic"], c["channel"], c["payload"]) for c in stream.parse_chunks(raw)]
    for split in (1000, 4096, 77777, 1 << 30):
        reader = ranges.ChunkReader({"path": f"file://{tmp_path}/a.bin", "splitbytes": str(split)})
        assert len(reader.partitions()) == -(-len(raw) // split)
        assert [(r[1], r[2], r[4 - 1], r[9]) for r in rows_of(reader, raw)[0]] == expected


def test_bytes_read_fall_with_filters(tmp_path):
    raw = media(400, 20_000)
    (tmp_path / "a.bin").write_bytes(raw)
    path = {"path": f"file://{tmp_path}/a.bin"}
    whole = rows_of(ranges.ChunkReader(path), raw)
    filtered = ranges.ChunkReader(path)
    assert list(filtered.pushFilters([EqualTo(("magic",), "@SBT"), In(("channel",), (0,))])) == []
    some = rows_of(filtered, raw)
    assert [r for r in whole[0] if r[2] == "@SBT" and r[3] == 0] == some[0] and some[1] < 0.25 * whole[1]
    late = ranges.ChunkReader(path | {"payload": "false", "splitbytes": "500000"})
    assert len(list(late.pushFilters([GreaterThanOrEqual(("chunk_offset",), len(raw) - 400_000)]))) == 1
    assert rows_of(late, raw)[1] < 0.05 * whole[1]


def test_through_spark(spark, tmp_path):
    ranges.register(spark)
    raw = media(60)
    for name in ("a.bin", "b.bin", "_hidden"):
        (tmp_path / name).write_bytes(raw)
    df = spark.read.format("lodestone_chunks").option("splitBytes", 20_000).load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() >= 2 * len(raw) // 20_000
    found = df.filter("magic = '@SFV' AND frame_time > 10").select("chunk_offset", "frame_time", "payload").collect()
    expected = [(c["chunk_offset"], c["frame_time"], c["payload"]) for c in stream.parse_chunks(raw) if c["magic"] == "@SFV" and c["frame_time"] > 10]
    assert sorted((r[0], r[1], bytes(r[2])) for r in found) == sorted(expected * 2)


def test_payload_ranges(spark, tmp_path):
    data = {n: os.urandom(300_000) for n in ("a", "b")}
    for n, raw in data.items():
        (tmp_path / n).write_bytes(raw)
    rows = [(f"file://{tmp_path}/{n}", at, size) for n in data for at, size in ((0, 10), (5, 20), (250_000, 77), (299_990, 10), (100, 0), (5, 20))]
    rows += [(None, 1, 2), (rows[0][0], None, 3)]
    got = ranges.payloads(spark.createDataFrame(rows, "file string, file_offset long, file_size long")).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = None if r.file is None or r.file_offset is None else data[r.file[-1]][r.file_offset :][: r.file_size]
        assert (r.payload if r.payload is None else bytes(r.payload)) == expected
    read = []
    raw = os.urandom(10_000_000)
    wanted = [(i * 100_000, 1000) for i in range(100)]  # 1 % of the bytes, further apart than NEAR_BYTES
    assert list(ranges.read_ranges(lambda a, n: (read.append(n), raw[a : a + n])[1], wanted)) == [raw[a : a + n] for a, n in wanted]
    assert sum(read) == 100_000
    read.clear()
    assert list(ranges.read_ranges(lambda a, n: (read.append(n), raw[a : a + n])[1], [(0, 10), (20, 10), (25, 500_000)], 100))
    assert read == [500_025]


def test_a_commit_moves_and_a_failure_leaves_nothing(spark, tmp_path):
    ranges.register(spark)
    folder = f"{tmp_path}/out"
    df = spark.range(200).repartition(5).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/f"), "id").alias("file"), F.encode(F.repeat(F.col("id").cast("string"), 10), "utf-8").alias("content"))
    df.write.format("lodestone_files").mode("append").save(f"file://{folder}")
    names = sorted(os.path.relpath(os.path.join(at, n), folder) for at, _, found in os.walk(folder) for n in found if not n.startswith(("lodestone-manifest-", ".")))
    assert names == sorted(f"d{i % 7}/f{i}" for i in range(200))
    assert (tmp_path / "out" / "d3" / "f3").read_bytes() == b"3" * 10
    listed = ranges.manifest(spark, f"file://{folder}")
    assert listed.count() == 200 and listed.agg(F.sum("bytes")).first()[0] == sum(10 * len(str(i)) for i in range(200))
    assert not [n for n in os.listdir(folder) if n.startswith("_staging")]
    bad = df.withColumn("file", F.when(F.col("file") == "d5/f103", F.lit(None)).otherwise(F.col("file")))
    twice = df.select(F.lit("same").alias("file"), "content")
    for broken in (bad, twice):
        other = f"{tmp_path}/broken"
        with pytest.raises(Exception, match="no file name|two rows"):
            broken.write.format("lodestone_files").mode("append").save(f"file://{other}")
        assert not os.path.exists(other) or not os.listdir(other)


def test_a_retried_task_is_written_once(tmp_path):
    from pyspark.sql import Row
    from pyspark.sql.types import BinaryType, StringType, StructType

    schema = StructType().add("file", StringType()).add("content", BinaryType())
    writer = ranges.FileWriter({"path": f"file://{tmp_path}/out"}, schema)
    rows = [Row(file="a", content=b"1"), Row(file="../b", content=None)]
    writer.write(iter(rows))  # lost
    writer.commit([writer.write(iter(rows)), None])
    assert sorted(n for n in os.listdir(tmp_path / "out") if not n.startswith("lodestone-manifest-")) == ["a", "b"]
    assert (tmp_path / "out" / "b").read_bytes() == b""


def test_chunk_files_by_pieces(spark):
    """A chunk is a piece: files have the bytes that the builder gives, and no task holds one."""
    from lodestone.sources import files, sinks
    from pyspark.sql import functions as F

    rows = [(f"f{i % 3}.bin", ("@SFV", "@SFA")[i % 2], i % 4, 1000 - i, b"x" * (i % 70)) for i in range(200)]
    df = spark.createDataFrame(rows, "file string, magic string, channel int, frame_time long, payload binary")
    folder = sinks.save_parts(sinks.stream_parts(df, "file", ["frame_time"]), as_named=True)
    name = F.element_at(F.split("file", "/"), -1)
    got = {r.file: bytes(r.content) for r in files.files(spark, folder, "*.bin").select(name.alias("file"), "content").collect()}
    assert got == {r.file: bytes(r.content) for r in sinks.stream_file(df, "file", ["frame_time"]).collect()}


def test_small_splits_share_a_task(spark, tmp_path):
    from lodestone.codecs import stream
    from lodestone.sources import ranges

    for i in range(3):
        (tmp_path / f"{i}.bin").write_bytes(b"".join(stream.build_chunk("@SFA", bytes([65 + i]) * 40, 1, time=t) for t in range(400)))
    ranges.register(spark)
    found = spark.read.format("lodestone_chunks").option("splitBytes", 1 << 10).option("taskBytes", 1 << 20).load(f"file://{tmp_path}")
    assert found.rdd.getNumPartitions() == 1
    assert sorted((r.file[-5:], r.frame_time, bytes(r.payload)) for r in found.collect()) == [(f"{i}.bin", t, bytes([65 + i]) * 40) for i in range(3) for t in range(400)]
