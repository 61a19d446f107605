"""Entries to files: one archive is built in one task from its own rows, many archives in parallel."""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from lodestone.codecs import archives, compress, stream
from lodestone.codecs import table as tables
from lodestone.operators import layout
from lodestone.session import scratch, ship
from lodestone.sources import ranges
from lodestone.sources.files import BYTES_OUT, ROWS_OUT

#: Rows that become Python objects at a time.
ROWS_IN = 256


def built(df: DataFrame, key: str, columns: list[str], order: list[str], build: Callable[[list[dict]], bytes]) -> DataFrame:
    """(file, content): ``build`` gets a file's rows as dicts, in order. A file has to fit in memory.

    Spark sorts the rows of a task by file, so files are cut from one stream of batches: a call for each group would cost more
    than the building of small files. Small files leave together.
    """
    ship(df.sparkSession)
    schema = pa.schema([("file", pa.string()), ("content", pa.binary())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, ROWS_IN) for row in batch.slice(at, ROWS_IN).to_pylist())
        names, contents, size = [], [], 0
        for name, of in itertools.groupby(rows, lambda row: row[key]):
            names.append(name)
            contents.append(build(list(of)))
            size += len(contents[-1])
            if size >= BYTES_OUT or len(names) >= ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], schema=schema)
                names, contents, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], schema=schema)

    chosen = df.select(*dict.fromkeys([key, *columns, *order]))
    in_order = chosen.repartition(key).sortWithinPartitions(key, *[F.asc_nulls_last(c) for c in order])
    return in_order.mapInArrow(over, "file string, content binary")


def package(df: DataFrame, key: str, path: str, payload: str) -> DataFrame:
    return built(df, key, [path, payload], [path], lambda rows: archives.build_package([(r[path], r[payload] or b"") for r in rows]))


def bank(df: DataFrame, key: str, ident: str, payload: str, step: int = 32) -> DataFrame:
    return built(df, key, [ident, payload], [ident], lambda rows: archives.build_bank([(r[ident], r[payload] or b"") for r in rows], step, 4, 8))


def bank_parts(df: DataFrame, key: str, ident: str, payload: str, step: int = 32) -> DataFrame:
    """(file, file_offset, content): the pieces of the same files as ``bank``, each at its place.

    Offsets follow from sizes alone, and each header is built from ids and offsets, so no task holds a file's payloads
    and a file of very many rows is written by many tasks. Ids differ in a file; parts leave gaps of zeros.
    """
    ship(df.sparkSession)
    sizes = df.select(key, ident, F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("size"))
    in_order, whole = Window.partitionBy(key).orderBy(ident), Window.partitionBy(key)
    begin = F.count("*").over(whole) * (8 + 4) + 16 + 4  # header, ids of eight bytes, one mark of four more than entries
    stored = layout.align_up(F.col("size"), step)
    placed = sizes.withColumn("begin", begin).withColumn("before", F.sum(stored).over(in_order) - stored)
    placed = placed.withColumn("file_offset", layout.align_up(F.col("begin"), step) + F.col("before")).drop("before")

    def head(t: pa.Table) -> pa.Table:
        t = t.sort_by([(ident, "ascending")])
        at, sizes, begin = (t.column(c).to_pylist() for c in ("file_offset", "size", "begin"))
        made = archives.bank_header(t.column(ident).to_pylist(), [begin[0], *[a + n for a, n in zip(at, sizes)]], step, 4, 8)
        return pa.table({"file": pa.array([t.column(key)[0].as_py()], pa.string()), "file_offset": pa.array([0], pa.int64()), "content": pa.array([made], pa.binary())})

    heads = placed.select(key, ident, "file_offset", "size", "begin").groupBy(key).applyInArrow(head, "file string, file_offset long, content binary")
    bodies = df.join(placed.select(key, ident, "file_offset"), [key, ident]).select(F.col(key).alias("file"), "file_offset", F.coalesce(payload, F.lit(b"")).alias("content"))
    return heads.union(bodies)


#: Bytes of a piece of a stored file that becomes a payload.
BLOCK = 1 << 16
#: Multiples on which the payloads of an archive begin, by its kind.
STEPS = {"cpk": 2048, "afs": 2048, "awb": 32, "acx": 4}


def _folded(path: str) -> Column:
    """Paths as a package orders them."""
    return F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/")))


def _around(placed: DataFrame, kind: str) -> DataFrame:
    """(file, turn, step, content): what stands before and behind the payloads of archives, of rows (file, p0 to p3)."""
    step = STEPS[kind]

    def ends(t: pa.Table) -> pa.Table:
        file = t.column("file")[0].as_py()
        t = t.sort_by([(c, "ascending") for c in ("p0", "p1", "p2", "p3")])
        keys, names, sizes = (t.column(c).to_pylist() for c in ("p1", "p2", "p3"))
        tail = b""
        if kind == "cpk":
            number = sorted(range(len(keys)), key=lambda i: keys[i])
            at = dict(zip(number, range(len(keys))))
            head = archives.package_header([(at[i], path, n) for i, (path, n) in enumerate(zip(keys, sizes))], step)
        elif kind == "afs":
            head, tail = archives.slots_header(sizes, names, step)
        elif kind == "awb":
            begin = 16 + 8 * len(keys) + 4 * (len(keys) + 1)
            marks = [begin]
            for n in sizes:
                marks.append(-(-marks[-1] // step) * step + n)
            head = archives.bank_header(keys, marks, step, 4, 8)
        else:
            head = archives.pairs_header(sizes, step)
        kept = [(0, 1, head)] + ([] if kind == "awb" else [(2, step, tail)])  # the last payload of a bank is not padded
        turn, steps, content = zip(*kept)
        return pa.table({"file": pa.array([file] * len(kept), pa.string()), "turn": pa.array(turn, pa.int32()), "step": pa.array(steps, pa.int32()), "content": pa.array(content, pa.binary())})

    return placed.select("file", "p0", "p1", "p2", "p3").groupBy("file").applyInArrow(ends, "file string, turn int, step int, content binary")


def archive_parts(df: DataFrame, key: str, kind: str, order: str, payload: str, name: str | None = None) -> DataFrame:
    """The pieces, for ``save_parts``, of the same archives as ``package`` (``order`` being the path), ``slots``, ``bank`` and ``pairs`` make.

    What stands before and behind the payloads is built from numbers, names and sizes alone; payloads never meet in one place.
    Rows that are alike in ``order`` are told apart by name and size.
    """
    ship(df.sparkSession)
    step = STEPS[kind]
    folded = _folded(order) if kind == "cpk" else F.lit(None).cast("string")
    size = F.octet_length(payload) if kind == "afs" else F.coalesce(F.octet_length(payload), F.lit(0))
    placed = df.select(F.col(key).alias("file"), folded.alias("p0"), F.col(order).alias("p1"), (F.col(name) if name else F.lit(None).cast("string")).alias("p2"), size.alias("p3"), (F.col(payload) if kind == "afs" else F.coalesce(F.col(payload), F.lit(b""))).alias("content"))

    bodies = placed.withColumn("turn", F.lit(1)).withColumn("step", F.lit(step))
    return bodies.filter("content IS NOT NULL").unionByName(_around(placed, kind), allowMissingColumns=True)


def package_parts(df: DataFrame, key: str, path: str, place: str, size: str) -> DataFrame:
    """The pieces, for ``save_parts``, of packages whose payloads are stored files: ``place`` says where and ``size`` how long. A payload
    is carried in blocks, so no task holds a stored file."""
    ship(df.sparkSession)
    placed = df.select(F.col(key).alias("file"), _folded(path).alias("p0"), F.col(path).alias("p1"), F.lit(None).cast("string").alias("p2"), F.col(size).cast("long").alias("p3"), F.col(place).alias("place"))
    last = F.greatest(F.lit(0), F.ceil(F.col("p3") / BLOCK) - 1)
    blocks = placed.withColumn("p4", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).withColumn("at", F.col("p4") * BLOCK)
    read = ranges.payloads(blocks.withColumn("length", F.least(F.lit(BLOCK), F.col("p3") - F.col("at"))), "place", "at", "length", "content")
    bodies = read.withColumn("turn", F.lit(1)).withColumn("step", F.when(F.col("p4") == 0, STEPS["cpk"]).otherwise(1)).drop("place", "at", "length")
    return bodies.unionByName(_around(placed, "cpk"), allowMissingColumns=True)


def stored_as(file: Column) -> Column:
    """The name under which ``save_parts`` writes a file of any name."""
    return F.when(file.isNull(), "none").otherwise(F.sha2(file, 256))


def save_parts(parts: DataFrame, as_named: bool = False) -> str:
    """Writes pieces (file, turn, p0 and so on, step, content) as files of a scratch folder, which it returns; their names there are
    those of ``stored_as``, or their own.

    A file is written by one task, front to back, which holds a piece at a time.
    """
    spark = parts.sparkSession
    ranges.register(spark)
    folder = scratch(spark)
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    places = [F.asc_nulls_last(c) for c in parts.columns if c not in ("file", "turn", "step", "content")]
    in_order = (parts if as_named else parts.withColumn("file", stored_as(F.col("file")))).repartition("file").sortWithinPartitions("file", "turn", *places)
    in_order.select("file", "step", "content").write.format("lodestone_files").option("step", "step").mode("append").save(folder)
    return folder


def slots(df: DataFrame, key: str, order: str, name: str, payload: str) -> DataFrame:
    """A null payload is an empty slot."""
    return built(df, key, [name, payload], [order], lambda rows: archives.build_slots([r[payload] for r in rows], [r[name] for r in rows]))


def pairs(df: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    return built(df, key, [payload], [order], lambda rows: archives.build_pairs([r[payload] or b"" for r in rows]))


def typed_table(df: DataFrame, key: str, order: str, columns: dict[str, int], name: str = "Table") -> DataFrame:
    """Typed tables with the given column types; storage flags follow from the values."""

    def build(rows: list[dict]) -> bytes:
        cols = [tables.Column(c, kind) for c, kind in columns.items()]
        return tables.build(tables.Table(name, cols, [[r[c] for c in columns] for r in rows]))

    return built(df, key, list(columns), [order], build)


def subtitle_file(df: DataFrame, key: str, order: str) -> DataFrame:
    cols = ["language_id", "time_unit", "start", "duration", "text"]
    return built(df, key, cols, [order], stream.build_subtitles)


def _stream_head(totals: dict[tuple[str, int], int]) -> bytes:
    """The directory before the chunks, by the bytes of each (magic, channel)."""
    listed = [["", 0, 0, 0]] + [[f"{m}_{c}", int.from_bytes(m.encode("latin-1"), "big"), c, totals[m, c]] for m, c in sorted(totals)]
    cols = [tables.Column("filename", 0xA, 0x50), tables.Column("stmid", 0x4, 0x50), tables.Column("chno", 0x2, 0x50), tables.Column("filesize", 0x4, 0x50)]
    return stream.build_chunk("CRID", tables.build(tables.Table("CRIUSF_DIR_STREAM", cols, listed)), kind="header")


def stream_file(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Multiplexed chunks of (magic, channel, frame_time, payload) rows behind a directory of their streams."""

    def build(rows: list[dict]) -> bytes:
        totals: dict[tuple[str, int], int] = {}
        for r in rows:
            totals[r["magic"], r["channel"]] = totals.get((r["magic"], r["channel"]), 0) + len(r["payload"])
        return _stream_head(totals) + b"".join(stream.build_chunk(r["magic"], r["payload"], r["channel"], time=r["frame_time"]) for r in rows)

    return built(df, key, ["magic", "channel", "frame_time", "payload"], order, build)


def stream_parts(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The pieces, for ``save_parts``, of the same files as ``stream_file``: a chunk is a piece, and the directory is built from sums."""
    ship(df.sparkSession)

    def head(t: pa.Table) -> pa.Table:
        totals = {(r["magic"], r["channel"]): r["n"] for r in t.to_pylist()}
        return pa.table({"file": t.column("file").slice(0, 1), "turn": pa.array([0], pa.int32()), "step": pa.array([1], pa.int32()), "content": pa.array([_stream_head(totals)], pa.binary())})

    def chunk(batches):
        for batch in batches:
            magic, channel, time, payload = (batch.column(c).to_pylist() for c in ("magic", "channel", "frame_time", "payload"))
            made = [stream.build_chunk(m, p, c, time=t) for m, c, t, p in zip(magic, channel, time, payload)]
            kept = [i for i, n in enumerate(batch.schema.names) if n not in ("magic", "channel", "frame_time", "payload")]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(made, pa.binary())], names=[*[batch.schema.names[i] for i in kept], "content"])

    sums = df.groupBy(F.col(key).alias("file"), "magic", "channel").agg(F.sum(F.octet_length("payload")).alias("n"))
    heads = sums.groupBy("file").applyInArrow(head, "file string, turn int, step int, content binary")
    rows = df.select(F.col(key).alias("file"), F.lit(1).alias("turn"), F.lit(1).alias("step"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(order)], "magic", "channel", "frame_time", "payload")
    fields = [f for f in rows.schema.fields if f.name not in ("magic", "channel", "frame_time", "payload")]
    bodies = rows.mapInArrow(chunk, StructType([*fields, StructField("content", BinaryType())]))
    return bodies.unionByName(heads, allowMissingColumns=True)


def wave_file(df: DataFrame, key: str, order: str, sample: str, rate: int) -> DataFrame:
    """Wave files of 16-bit samples in order, one channel."""
    import struct

    return built(df, key, [sample], [order], lambda rows: stream.build_wav(struct.pack(f"<{len(rows)}h", *[r[sample] for r in rows]), rate, 1))


def frame_file(df: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Frame files: a payload and a time (``order``) in each row."""
    return built(df, key, [payload], [order], lambda rows: stream.build_frames([(r[order], r[payload]) for r in rows]))


def joined_file(df: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Files that are their payloads one after the other."""
    return built(df, key, [payload], [order], lambda rows: b"".join(r[payload] for r in rows))


def srt_file(df: DataFrame, key: str, order: str) -> DataFrame:
    return built(df, key, ["time_unit", "start", "duration", "text"], [order], lambda rows: stream.build_srt(rows).encode())


def program_file(df: DataFrame, key: str, order: str, ident: str, payload: str) -> DataFrame:
    """Program streams of one packet for each row, ``order`` being its time in seconds."""
    return built(df, key, [ident, payload], [order], lambda rows: stream.build_program([(r[ident], r[payload], r[order]) for r in rows]))


def _binary(df: DataFrame, column: str, out: str, f: Callable[[bytes], bytes]) -> DataFrame:
    ship(df.sparkSession)

    @F.pandas_udf("binary")
    def apply(s):
        return s.map(lambda b: None if b is None else f(bytes(b)))

    return df.withColumn(out, apply(F.col(column)))


def compressed(df: DataFrame, column: str, out: str) -> DataFrame:
    """Payloads compressed where that makes them smaller."""
    return _binary(df, column, out, compress.compress)


def decompressed(df: DataFrame, column: str, out: str) -> DataFrame:
    """Payloads decompressed where they are compressed."""
    return _binary(df, column, out, lambda b: compress.decompress(b) if b[:8] == compress.MAGIC else b)


def masked(df: DataFrame, column: str, out: str) -> DataFrame:
    return _binary(df, column, out, tables.masked)


def save(df: DataFrame, folder: str, name: str = "file", content: str = "content") -> DataFrame:
    """Writes each row as a file below a folder that all executors share; returns (file, bytes, error)."""

    def write(batches):
        for batch in batches:
            out = []
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [p for p in (n or "").replace("\\", "/").split("/") if p not in ("", ".", "..")]
                full = os.path.join(folder, *parts)
                try:
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    with open(f"{full}.part", "wb") as f:
                        f.write(c or b"")
                    os.replace(f"{full}.part", full)
                    out.append((n, len(c or b""), None))
                except OSError as e:
                    out.append((n, None, str(e)))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["file", "bytes", "error"])

    return df.select(name, content).mapInArrow(write, "file string, bytes long, error string")
