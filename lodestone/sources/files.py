"""Files as DataFrames: Spark reads the bytes (any path it can open), Arrow functions parse them on executors.

Metadata comes without payloads unless they are asked for. Here contents reach Python whole; the data source in
``datasource`` lists archives by reading their headers and indexes only. A file that
cannot be parsed raises, or with ``errors="row"`` becomes a row whose ``error`` says why.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.codecs import adx, archives, media, stream
from lodestone.codecs import table as tables
from lodestone.functions.names import suspicion
from lodestone.session import checkpointed, ship

ENTRY = "pos int, entry_id long, path string, file_offset long, file_size long, extract_size long, packed boolean"
#: Rows of a batch, and bytes of the files whose rows share one, about.
ROWS_OUT, BYTES_OUT = 4096, 1 << 18


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, content) of all files under a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("file"), "content")


def parsed(blobs: DataFrame, parse: Callable[[bytes], list[dict]], schema: str, errors: str = "raise") -> DataFrame:
    """Rows of ``parse(content)`` for each (file, content), after the file's name, in batches of bounded length that small files share."""
    spark = blobs.sparkSession
    ship(spark)
    full = f"file string, {schema}" + (", error string" if errors == "row" else "")
    out = spark.createDataFrame([], full).schema
    arrow = to_arrow_schema(out)

    def batch_of(names: list[str], rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names if f.name == "file" else [r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kept, size = [], [], 0
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py() or b""
                try:
                    rows = parse(raw)
                except ValueError as e:
                    if errors != "row":
                        raise
                    rows = [{"error": str(e)}]
                size += len(raw)
                for at in range(0, len(rows), ROWS_OUT):
                    part = rows[at : at + ROWS_OUT]
                    if kept and len(kept) + len(part) > ROWS_OUT:
                        yield batch_of(names, kept)
                        names, kept = [], []
                    names += [name] * len(part)
                    kept += part
                if size >= BYTES_OUT:
                    if kept:
                        yield batch_of(names, kept)
                    names, kept, size = [], [], 0
        if kept:
            yield batch_of(names, kept)

    return blobs.select("file", "content").mapInArrow(over, out)


def archive_entries(blobs: DataFrame, kind: str | None = None, payload: bool = False, errors: str = "raise") -> DataFrame:
    """Entries of archives; ``kind`` is cpk, afs, awb or acx, or found from each file's first bytes."""

    def parse(raw: bytes) -> list[dict]:
        found = kind or archives.kind_of(raw[:16])
        if found not in archives.PARSERS:
            raise tables.FormatError("no archive format is known for these bytes")
        rows = archives.PARSERS[found](raw)
        return [r | {"payload": raw[r["file_offset"] : r["file_offset"] + r["file_size"]]} for r in rows] if payload else rows

    return parsed(blobs, parse, ENTRY + (", payload binary" if payload else ""), errors)


def stored_entries(folder: str, stored: DataFrame, kind: str | None = None) -> DataFrame:
    """Entries, with payloads, of the archives in a folder; ``stored`` is (file, stored) with the name of each file there. Headers and
    indexes are read first, then the ranges of the payloads, so no task holds an archive."""
    from lodestone.sources import datasource, ranges

    spark = stored.sparkSession
    datasource.register(spark)
    reader = spark.read.format("lodestone")
    found = (reader.option("kind", kind) if kind else reader).load(folder).withColumn("stored", F.element_at(F.split("file", "/"), -1))
    named = found.drop("file").join(stored, "stored").withColumn("place", F.concat(F.lit(folder.rstrip("/") + "/"), "stored")).drop("stored")
    return ranges.payloads(named, "place").drop("place")


def table_columns(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    """Schema of typed tables: a row for each column with its type and storage flags."""

    def parse(raw: bytes) -> list[dict]:
        t = tables.parse(raw)
        return [{"table_name": t.name, "column_no": i, "column_name": c.name, "kind": c.kind, "flags": c.flags, "n_rows": len(t.rows)} for i, c in enumerate(t.columns)]

    return parsed(blobs, parse, "table_name string, column_no int, column_name string, kind int, flags int, n_rows long", errors)


def table_rows(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    """Typed rows of tables that share one schema, which the first file gives; another schema is an error."""
    head = table_columns(blobs.limit(1), errors).filter("kind IS NOT NULL").collect()  # an executor reads the file
    if not head:
        return blobs.sparkSession.createDataFrame([], "file string, row_no int")
    shape = [(c.column_name, c.kind) for c in sorted(head, key=lambda c: c.column_no)]

    def parse(raw: bytes) -> list[dict]:
        from decimal import Decimal

        t = tables.parse(raw)
        if [(c.name, c.kind) for c in t.columns] != shape:
            raise tables.FormatError("the table has another schema than the first one")
        fix = lambda v, k: Decimal(v) if k == 0x6 and v is not None else v
        return [{"row_no": i} | {n: fix(v, k) for (n, k), v in zip(shape, r)} for i, r in enumerate(t.rows)]

    return parsed(blobs, parse, "row_no int, " + ", ".join(f"`{n}` {tables.TYPES[k][1]}" for n, k in shape), errors)


def stream_chunks(blobs: DataFrame, payload: bool = True, errors: str = "raise") -> DataFrame:
    """Chunks of multiplexed files in order."""
    schema = "chunk_no long, chunk_offset long, magic string, channel int, payload_type string, flags int, frame_time long, frame_rate long, payload_size long" + (", payload binary" if payload else "")
    return parsed(blobs, lambda raw: [c | {"payload_size": len(c["payload"])} for c in stream.parse_chunks(raw)], schema, errors)


def stream_directory(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    return parsed(blobs, lambda raw: stream.stream_directory(stream.parse_chunks(raw)), "row int, filename string, stream_id string, channel int, filesize long", errors)


CUE = "cue_no int, language_id long, time_unit long, start long, duration long, text string, terminators int"


def subtitles(blobs: DataFrame, kind: str = "sbt", errors: str = "raise") -> DataFrame:
    """Cues of sbt, srt or ass files."""
    text = {"srt": stream.parse_srt, "ass": media.parse_ass}.get(kind)
    read = (lambda raw: text(raw.decode("utf-8-sig", "replace"))) if text else stream.parse_subtitles
    return parsed(blobs, read, CUE, errors)


def frames(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    return parsed(blobs, stream.parse_frames, "frame_no long, frame_time long, frame_offset long, frame_size long", errors)


def video_units(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    return parsed(blobs, stream.parse_units, "unit_no long, unit_offset long, unit_type int, unit_size long", errors)


def waves(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    return parsed(blobs, lambda raw: [{k: v for k, v in stream.parse_wav(raw).items() if k != "loops"}], "channels int, rate long, bits int, block int, data_offset long, data_size long, samples long", errors)


def audio_headers(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    return parsed(blobs, lambda raw: [adx.parse_header(raw)], "data_offset int, mode int, block int, bits int, channels int, rate long, samples long, highpass int, version int, flags int", errors)


def decoded_audio(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    """16-bit PCM of block audio, a row for each file."""

    def parse(raw: bytes) -> list[dict]:
        pcm, h = adx.decode(raw)
        return [{"rate": h["rate"], "channels": h["channels"], "samples": h["samples"], "pcm": pcm.astype("<i2").tobytes()}]

    return parsed(blobs, parse, "rate long, channels int, samples long, pcm binary", errors)


def commands(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    return parsed(blobs, stream.parse_commands, "command_no int, code int, value binary", errors)


def nested_tables(blobs: DataFrame, depth: int = 4, errors: str = "raise") -> DataFrame:
    """All tables inside typed tables, to a depth: cue sheets and banks keep their parts this way."""
    return parsed(blobs, lambda raw: media.nested_tables(raw, depth), "place string, table_name string, n_rows long, n_columns int", errors)


def sheet_table(blobs: DataFrame, name: str, columns: dict[str, str], errors: str = "raise") -> DataFrame:
    """Rows of one table of a cue sheet: (file, row_no, columns). A column the table lacks is null, and so is an index
    of 0xFFFF in a column of type int; a sheet without the table has no rows."""

    def parse(raw: bytes) -> list[dict]:
        sheet = tables.parse(raw)
        inner = sheet.get(0, name, b"") if sheet.rows else b""
        if not inner:
            return []
        t = tables.parse(inner)
        cell = lambda r, c: None if columns[c] == "int" and t.get(r, c) == 0xFFFF else t.get(r, c)
        return [{"row_no": r} | {c: cell(r, c) for c in columns} for r in range(len(t.rows))]

    return parsed(blobs, parse, "row_no int, " + ", ".join(f"`{c}` {kind}" for c, kind in columns.items()), errors)


def looped_segments(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    return parsed(blobs, media.parse_segments, "segment int, loops boolean, channels int, rate long, samples long, size long", errors)


def sound_elements(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    return parsed(blobs, media.parse_elements, "element int, path string, format int, channels int, streamed boolean, rate long, samples long, size long", errors)


def transform_headers(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    schema = "version int, header_size int, channels int, rate long, frames long, delay int, padding int, frame_size int, min_resolution int, max_resolution int, loop_start long, loop_end long, cipher int, volume float, samples long"
    return parsed(blobs, lambda raw: [media.parse_transform_header(raw)], schema, errors)


def program_packets(blobs: DataFrame, errors: str = "raise") -> DataFrame:
    """Packets of program streams; ``stream.stream_totals`` and ``stream.demux`` take them by stream id."""
    return parsed(blobs, stream.parse_program, "packet_no long, stream_id int, payload_offset long, payload_size long", errors)


def attempted(blobs: DataFrame, readers: dict[str, Callable[[bytes], list]]) -> DataFrame:
    """(file, attempt, reader, n_rows, error): every reader tries every file, a row each, in the readers' order."""

    def tries(raw: bytes) -> list[dict]:
        out = []
        for i, (name, read) in enumerate(readers.items()):
            try:
                out.append({"attempt": i, "reader": name, "n_rows": len(read(raw))})
            except (ValueError, LookupError, struct.error, OverflowError) as e:
                out.append({"attempt": i, "reader": name, "error": str(e) or type(e).__name__})
        return out

    return parsed(blobs, tries, "attempt int, reader string, n_rows long, error string")


def settled(attempts: DataFrame) -> DataFrame:
    """(file, reader, n_rows, error): the first reader that succeeded, else the one that got furthest before it failed."""
    good = F.col("error").isNull()
    rank = F.struct(good.cast("int").alias("ok"), F.when(good, 0).otherwise(suspicion(F.col("error"))).alias("depth"), (-F.col("attempt")).alias("first"))
    return attempts.groupBy("file").agg(F.max_by(F.struct("reader", "n_rows", "error"), rank).alias("b")).select("file", "b.*")


def nested_entries(blobs: DataFrame, most: int = 16) -> DataFrame:
    """(file, path, depth, size, digest, kind) of all entries of archives, of archives in them, and so on to ``most`` levels.

    A work list: each round opens the archives that the last one brought up, every different content once whatever
    the number of places that hold it, and dealt out by bytes. ``kind`` is null for what is no archive; an archive that cannot be
    read counts as no archive. Deeper nesting than ``most`` is an error.
    """
    kind = F.when(F.startswith("content", F.lit(b"CPK ")), "cpk").when(F.startswith("content", F.lit(b"AFS\x00")), "afs").when(F.startswith("content", F.lit(b"AFS2")), "awb")
    digest = F.sha2("content", 256)
    top = checkpointed(blobs.select("file", digest.alias("digest"), kind.alias("kind"), "content"))
    front = top.filter("kind IS NOT NULL").groupBy("digest").agg(F.first("content").alias("content"))
    opened = None
    for _ in range(most):
        if front.isEmpty():
            break
        spread = front.repartition(F.pmod(F.xxhash64("digest"), F.lit(4096))).select(F.col("digest").alias("file"), "content")
        got = archive_entries(spread, payload=True, errors="row").filter("error IS NULL").select(F.col("file").alias("parent"), "path", "pos", F.col("payload").alias("content"))
        got = checkpointed(got.select("parent", "path", "pos", digest.alias("digest"), F.octet_length("content").cast("long").alias("size"), kind.alias("kind"), F.when(kind.isNotNull(), F.col("content")).alias("content")))
        before = opened
        opened = got.drop("content") if before is None else before.union(got.drop("content"))
        front = got.filter("kind IS NOT NULL").groupBy("digest").agg(F.first("content").alias("content")).join(opened.select(F.col("parent").alias("digest")).distinct(), "digest", "left_anti")
    else:
        if not front.isEmpty():
            raise RuntimeError(f"archives lie deeper than {most} levels")
    return _places(top, opened, most)


def _places(top: DataFrame, opened: DataFrame | None, most: int) -> DataFrame:
    """(file, path, depth, size, digest, kind): where the entries of opened archives lie below the files on top."""
    schema = "file string, path string, depth int, size long, digest string, kind string"
    if opened is None:
        return top.sparkSession.createDataFrame([], schema)
    walk = top.select("file", F.lit("").alias("path"), "digest")
    out = None
    for depth in range(1, most + 1):
        step = walk.withColumnRenamed("path", "above").join(opened.withColumnRenamed("digest", "inner"), F.col("digest") == F.col("parent"))
        name = F.when(F.coalesce(F.col("path"), F.lit("")) != "", F.col("path")).otherwise(F.col("pos").cast("string"))
        here = step.select("file", F.concat_ws("/", F.when(F.col("above") != "", F.col("above")), name).alias("path"), F.lit(depth).alias("depth"), "size", F.col("inner").alias("digest"), "kind")
        here = checkpointed(here)
        if here.isEmpty():
            break
        out = here if out is None else out.union(here)
        walk = here.filter("kind IS NOT NULL").select("file", "path", "digest")
    return out if out is not None else top.sparkSession.createDataFrame([], schema)


def _stamped(windows: DataFrame) -> DataFrame:
    """Windows (place, file_offset, file_size) of stored files with their ``digest`` and ``kind``; a task reads a block at a time."""
    from lodestone.sources.ranges import READ_BYTES, REGION_BYTES

    ship(windows.sparkSession)
    dealt = windows.repartition(F.col("place"), (F.col("file_offset") / REGION_BYTES).cast("long")).sortWithinPartitions("place", "file_offset")
    at = [dealt.columns.index(c) for c in ("place", "file_offset", "file_size")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        from pyarrow import fs

        for batch in batches:
            digests, kinds, name, f = [], [], None, None
            try:
                for place, begin, size in zip(*[batch.column(i).to_pylist() for i in at]):
                    if place != name:
                        if f is not None:
                            f.close()
                        system, path = fs.FileSystem.from_uri(place)
                        name, f = place, system.open_input_file(path)
                    digest = sha256()
                    for part in range(0, size, READ_BYTES):
                        digest.update(f.read_at(min(READ_BYTES, size - part), begin + part))
                    found = archives.kind_of(f.read_at(min(16, size), begin))
                    digests.append(digest.hexdigest())
                    kinds.append(found if found in ("cpk", "afs", "awb") else None)
            finally:
                if f is not None:
                    f.close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(kinds, pa.string())], names=[*batch.schema.names, "digest", "kind"])

    return dealt.mapInArrow(over, StructType([*dealt.schema.fields, StructField("digest", StringType()), StructField("kind", StringType())]))


def _windows(found: DataFrame) -> DataFrame:
    """(parent, pos, path, place, file_offset, file_size) of the entries of archives (digest, place, file_offset, file_size, kind) that lie in stored
    files; headers and indexes are read, and an archive that cannot be read has no entries."""
    ship(found.sparkSession)
    schema = "parent string, pos int, path string, place string, file_offset long, file_size long"
    arrow = to_arrow_schema(found.sparkSession.createDataFrame([], schema).schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for digest, place, begin, size, kind in zip(*[c.to_pylist() for c in batch.columns]):
                system, path = fs.FileSystem.from_uri(place)
                with system.open_input_file(path) as f:
                    try:
                        rows = archives.PARSERS[kind](archives.Ranged(lambda a, n: f.read_at(n, begin + a), size))
                    except ValueError:
                        continue
                for at in range(0, len(rows), ROWS_OUT):
                    out = []
                    for r in rows[at : at + ROWS_OUT]:
                        start = min(r["file_offset"], size)  # as a slice of the archive's bytes ends with them
                        out.append((digest, r["pos"], r["path"], place, begin + start, min(r["file_size"], size - start)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return found.select("digest", "place", "file_offset", "file_size", "kind").mapInArrow(over, schema)


def stored_nested(folder: str, stored: DataFrame, most: int = 16) -> DataFrame:
    """As ``nested_entries``, of the files of a folder; ``stored`` is (file, stored) with the name of each file there.

    An archive inside another is a window of a stored file, of which its index is read, and payloads are read a block at a time for
    their digests, so no task holds an archive or a payload.
    """
    spark = stored.sparkSession
    root = folder.rstrip("/") + "/"
    sizes = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("stored"), F.col("length").alias("file_size"))
    whole = stored.join(sizes, "stored").select("file", F.concat(F.lit(root), "stored").alias("place"), F.lit(0).cast("long").alias("file_offset"), "file_size")
    top = checkpointed(_stamped(whole))
    at = F.min(F.struct("place", "file_offset", "file_size", "kind")).alias("at")
    once = lambda df: df.filter("kind IS NOT NULL").groupBy("digest").agg(at).select("digest", "at.*")
    front, opened = once(top), None
    for _ in range(most):
        if front.isEmpty():
            break
        dealt = front.repartition(F.pmod(F.xxhash64("digest"), F.lit(4096)))
        got = checkpointed(_stamped(_windows(dealt)))
        listed = got.select("parent", "path", "pos", "digest", F.col("file_size").alias("size"), "kind")
        opened = listed if opened is None else opened.union(listed)
        front = once(got).join(opened.select(F.col("parent").alias("digest")).distinct(), "digest", "left_anti")
    else:
        if not front.isEmpty():
            raise RuntimeError(f"archives lie deeper than {most} levels")
    return _places(top, opened, most)
