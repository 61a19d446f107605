"""Reading and writing no more than is asked for: split chunk files, payload ranges, and files that are committed at once.

``lodestone_chunks`` reads multiplexed files chunk by chunk. A large file is several partitions; each finds the first chunk
boundary in its range by itself. Headers are read, payloads are skipped unless they are wanted, and filters on magic, channel,
payload type and offset reach the reader. ``payloads`` reads the byte ranges that entry rows name, near ones together.
``lodestone_files`` writes rows as files: tasks write to a staging folder, and the driver moves what succeeded and leaves a
manifest, so a failed job leaves nothing and a task that ran twice is written once.

Executors open paths through Arrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

from lodestone.session import ship

#: Bytes of a partition of a chunk file, and bytes that are searched for a boundary at a time.
SPLIT_BYTES, SEARCH_BYTES = 128 << 20, 1 << 16
#: Headers in a row that must fit before a place counts as a chunk boundary.
CHAIN = 4
#: First four bytes of chunks (fixed values).
MAGICS = (b"CRID", b"@SFV", b"@SFA", b"@ALP", b"@SBT", b"@CUE", b"@ELM", b"@STA", b"@AHX", b"@USR", b"@PST")
#: Bytes between two ranges up to which they are read as one; bytes of the file ranges that tasks share out.
NEAR_BYTES, REGION_BYTES = 1 << 16, 64 << 20
#: Bytes of several ranges that are read at once, and of payloads that a batch of rows carries on; one range may be longer.
READ_BYTES = 8 << 20

CHUNK = "file string, chunk_offset long, magic string, channel int, payload_type string, flags int, frame_time long, frame_rate long, payload_size long, payload binary"


@dataclass
class ChunkRange(InputPartition):
    """The chunks of a file that begin in a range of bytes."""

    path: str
    begin: int
    end: int
    size: int


@dataclass
class ChunkTask(InputPartition):
    """Neighbouring ranges, each read by itself, that one task reads."""

    ranges: list[ChunkRange]


def _header(raw: bytes) -> tuple | None:
    """(magic, size, payload offset, padding, channel, kind, time, rate) of a chunk header that can be one."""
    from lodestone.codecs.stream import CHUNK as HEADER

    if len(raw) < HEADER.size:
        return None
    magic, size, offset, padding, channel, _, kind, time, rate, _, _ = HEADER.unpack_from(raw)
    if magic not in MAGICS or offset < 0x18 or offset + padding > size:
        return None
    return magic, size, offset, padding, channel, kind, time, rate


def boundary(read: Callable[[int, int], bytes], begin: int, size: int) -> int:
    """The first chunk boundary at or after ``begin``: a place from which CHAIN headers follow each other, or all to the end."""

    def chained(at: int) -> bool:
        for _ in range(CHAIN):
            if at == size:
                return True
            found = _header(read(at, 32))
            if found is None or at + 8 + found[1] > size:
                return False
            at += 8 + found[1]
        return True

    at = begin
    while at < size:
        raw = read(at, SEARCH_BYTES + 3)
        hits = sorted({i for m in MAGICS for i in _places(raw, m)})
        for i in hits:
            if i < SEARCH_BYTES and chained(at + i):
                return at + i
        at += SEARCH_BYTES
    return size


def _places(raw: bytes, magic: bytes) -> Iterator[int]:
    i = raw.find(magic)
    while i >= 0:
        yield i
        i = raw.find(magic, i + 1)


def chunks(read: Callable[[int, int], bytes], part: ChunkRange, wanted: Callable[[str, int, str], bool], payload: bool) -> Iterator[tuple]:
    """Rows of the chunks that begin in the range; only headers and wanted payloads are read."""
    from lodestone.codecs.stream import PAYLOADS
    from lodestone.codecs.table import FormatError

    at = boundary(read, part.begin, part.size) if part.begin else 0
    while at < part.end and part.size - at >= 32:
        found = _header(read(at, 32))
        if found is None:
            raise FormatError(f"{part.path} has no chunk at {at}")
        magic, size, offset, padding, channel, kind, time, rate = found
        if at + 8 + size > part.size:
            raise FormatError(f"the chunk at {at} is longer than the data or its padding")
        name, what = magic.decode("latin-1"), PAYLOADS[kind & 3]
        n = size - offset - padding
        if wanted(name, channel, what):
            yield (part.path, at, name, channel, what, kind >> 2, time, rate, n, read(at + 8 + offset, n) if payload else None)
        at += 8 + size


class ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.task = int(options.get("taskbytes", options.get("taskBytes", 0)))
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.only: dict[str, set] = {}
        self.low, self.high = 0, None
        self.scheme = ""

    def pushFilters(self, filters) -> Iterator:
        """Keeps what headers can decide; the rest is Spark's."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("magic", "channel", "payload_type") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = values & self.only.get(column, values)
            elif column == "chunk_offset" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                yield f
            elif column == "chunk_offset" and isinstance(f, (LessThan, LessThanOrEqual)):
                top = f.value + isinstance(f, LessThanOrEqual)
                self.high = top if self.high is None else min(self.high, top)
                yield f
            else:
                yield f

    def partitions(self) -> list[ChunkRange] | list[ChunkTask]:
        if not self.task:
            return self.splits()
        tasks, held = [], 0
        for part in self.splits():
            if not tasks or held + part.end - part.begin > self.task:
                tasks.append(ChunkTask([]))
                held = 0
            tasks[-1].ranges.append(part)
            held += part.end - part.begin
        return tasks

    def splits(self) -> list[ChunkRange]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.root)
        self.scheme = self.root[: -len(path)] if self.root.endswith(path) else ""  # rows name files as the path did
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if not f.is_file or f.base_name.startswith(("_", ".", "lodestone-manifest-")):
                continue
            top = f.size if self.high is None else min(f.size, self.high)
            first = self.low // self.split * self.split
            out += [ChunkRange(f.path, at, min(at + self.split, top), f.size) for at in range(first, top, self.split)]
        return out

    def wanted(self, magic: str, channel: int, kind: str) -> bool:
        values = {"magic": magic, "channel": channel, "payload_type": kind}
        return all(values[c] in some for c, some in self.only.items())

    def read(self, partition: ChunkRange | ChunkTask | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one partition of a folder without files
            return
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        for part in partition.ranges if isinstance(partition, ChunkTask) else [partition]:
            with system.open_input_file(part.path) as f:
                for row in chunks(lambda at, n: f.read_at(min(n, part.size - at), at), part, self.wanted, self.payload):
                    yield (self.scheme + row[0], *row[1:])


class ChunkSource(DataSource):
    """Chunks of multiplexed files. Options: ``splitBytes``, ``taskBytes`` up to which neighbouring splits share a task (a split is a task without it),
    and ``payload`` = false for headers only."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_chunks"

    def schema(self) -> str:
        return CHUNK

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options)


def read_ranges(read: Callable[[int, int], bytes], ranges: list[tuple[int, int]], near: int = NEAR_BYTES, most: int = READ_BYTES) -> Iterator[bytes]:
    """The bytes of (offset, size) ranges in rising order; ranges with at most ``near`` bytes between them are read at once, up
    to ``most`` bytes."""
    held: list[tuple[int, int]] = []

    def out() -> Iterator[bytes]:
        begin, end = held[0][0], max(a + n for a, n in held)
        raw = read(begin, end - begin)
        for a, n in held:
            yield raw[a - begin : a - begin + n]

    for a, n in ranges:
        if held and (a > max(x + m for x, m in held[-1:]) + near or a + n > held[0][0] + most):
            yield from out()
            held = []
        held.append((a, n))
    if held:
        yield from out()


def payloads(entries: DataFrame, file: str = "file", offset: str = "file_offset", size: str = "file_size", out: str = "payload") -> DataFrame:
    """``entries`` with the bytes that they name; a null file, offset or size gives a null payload.

    Rows are dealt out by regions of files and sorted, so a task reads a region front to back, and ranges that lie near
    each other are one read. A range is read whole, at one place, however many rows name it in a row.
    """
    ship(entries.sparkSession)
    named = entries.filter(F.col(file).isNotNull() & F.col(offset).isNotNull() & F.col(size).isNotNull())
    region = (F.col(offset) / REGION_BYTES).cast("long")
    dealt = named.withColumn("_region", region).repartition(F.col(file), F.col("_region")).sortWithinPartitions(file, offset, size).drop("_region")
    at = [dealt.columns.index(c) for c in (file, offset, size)]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            names, offsets, sizes = (batch.column(i).to_pylist() for i in at)
            begin, held, found = 0, 0, []

            def rows() -> pa.RecordBatch:
                part = batch.slice(begin, len(found))
                return pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out])

            start = 0
            while start < len(names):
                stop = start
                while stop < len(names) and names[stop] == names[start]:
                    stop += 1
                system, path = fs.FileSystem.from_uri(names[start])
                with system.open_input_file(path) as f:
                    for raw in read_ranges(lambda a, n: f.read_at(n, a), list(zip(offsets[start:stop], sizes[start:stop]))):
                        found.append(raw)
                        held += len(raw)
                        if held >= READ_BYTES:
                            yield rows()
                            begin, held, found = begin + len(found), 0, []
                start = stop
            if found:
                yield rows()

    read = dealt.mapInArrow(over, StructType([*dealt.schema.fields, StructField(out, BinaryType())]))
    rest = entries.filter(F.col(file).isNull() | F.col(offset).isNull() | F.col(size).isNull()).withColumn(out, F.lit(None).cast("binary"))
    return read.union(rest)


@dataclass
class Staged(WriterCommitMessage):
    """(name, bytes, digest, place in the staging folder) of the files that a task has written."""

    files: list[tuple[str, int, str, str]]


class FileWriter(DataSourceWriter):
    """Stages in ``_staging-<job>``; a commit moves, an abort deletes."""

    def __init__(self, options, schema):
        names = [f.name for f in schema]
        self.root = options["path"].rstrip("/")
        self.file, self.content = names.index(options.get("file", "file")), names.index(options.get("content", "content"))
        self.step = names.index(options["step"]) if "step" in options else None
        self.job = uuid.uuid4().hex

    def _open(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.root)
        return system, path.rstrip("/"), f"{path.rstrip('/')}/_staging-{self.job}"

    def write(self, rows) -> Staged:
        system, _, staging = self._open()
        place = f"{staging}/{uuid.uuid4().hex}"  # of this attempt alone
        system.create_dir(place, recursive=True)
        out, f, name, size, digest = [], None, None, 0, None
        try:
            for row in rows:
                parts = [p for p in (row[self.file] or "").replace("\\", "/").split("/") if p not in ("", ".", "..")]
                if not parts:
                    raise ValueError("a row has no file name")
                if f is None or self.step is None or "/".join(parts) != name:
                    if f is not None:
                        f.close()
                        out.append((name, size, digest.hexdigest(), f"{place}/{len(out)}"))
                    name, size, digest = "/".join(parts), 0, sha256()
                    f = system.open_output_stream(f"{place}/{len(out)}", buffer_size=1 << 20)
                raw = bytes(row[self.content] or b"")
                if self.step is not None:
                    raw = bytes(-size % (row[self.step] or 1)) + raw
                f.write(raw)
                digest.update(raw)
                size += len(raw)
        finally:
            if f is not None:
                f.close()
        if f is not None:
            out.append((name, size, digest.hexdigest(), f"{place}/{len(out)}"))
        return Staged(out)

    def commit(self, messages) -> None:
        """Moves every staged file to its name and writes the manifest last; a name that comes twice is an error, and then
        nothing is moved."""
        system, root, staging = self._open()
        found = sorted(f for m in messages if m is not None for f in m.files)
        names = [f[0] for f in found]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"two rows have the name {next(a for a, b in zip(names, names[1:]) if a == b)}")
        for folder in sorted({"", *[n.rpartition("/")[0] for n in names]}):
            system.create_dir(f"{root}/{folder}" if folder else root, recursive=True)
        for name, _, _, place in found:
            system.move(place, f"{root}/{name}")
        with system.open_output_stream(f"{root}/lodestone-manifest-{self.job}.json") as f:
            for name, size, digest, _ in found:
                f.write((json.dumps({"file": name, "bytes": size, "sha256": digest}) + "\n").encode())
        self._clear(system, staging)

    def abort(self, messages) -> None:
        system, _, staging = self._open()
        self._clear(system, staging)

    def _clear(self, system, staging: str) -> None:
        from pyarrow import fs

        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class FileSink(DataSource):
    """Rows as files: ``df.write.format("lodestone_files").mode("append").save(folder)``. Options ``file`` and ``content`` name the
    columns. With the option ``step``, rows of one file that follow each other are its pieces, each of which begins at the next
    multiple of the number in that column; a task holds a piece at a time."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_files"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options, schema)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of all files that were committed to a folder."""
    return spark.read.schema("file string, bytes long, sha256 string").json(f"{folder.rstrip('/')}/lodestone-manifest-*.json")


def register(spark: SparkSession) -> None:
    """Makes both formats known, and lets filters reach the reader."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)
    spark.dataSource.register(FileSink)
