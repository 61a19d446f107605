"""The readers as a Spark data source: ``spark.read.format("lodestone").option("kind", "cpk").load(folder)``.

One partition per file, opened by the executor through Arrow's file systems; only headers and indexes are read. Where only Spark itself can open
a path, use ``files.files`` and the functions beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.session import ship


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class EntrySource(DataSource):
    """Archive entries, without payloads: (file, pos, entry_id, path, file_offset, file_size, extract_size, packed)."""

    @classmethod
    def name(cls) -> str:
        return "lodestone"

    def schema(self) -> str:
        from lodestone.sources.files import ENTRY

        return "file string, " + ENTRY

    def reader(self, schema) -> DataSourceReader:
        return EntryReader(self.options)


class EntryReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.kind = options["path"], options.get("kind")

    def partitions(self) -> list[FilePartition]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.root)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        return [FilePartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", ".", "lodestone-manifest-"))]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one partition of a folder without files
            return
        from pyarrow import fs

        from lodestone.codecs import archives

        system, _ = fs.FileSystem.from_uri(self.root)
        with system.open_input_file(partition.path) as f:
            raw = archives.Ranged(lambda at, n: f.read_at(n, at), f.size())
            kind = self.kind or archives.kind_of(raw[:16])
            rows = archives.PARSERS[kind](raw)
        for e in rows:
            yield (partition.path, e["pos"], e["entry_id"], e["path"], e["file_offset"], e["file_size"], e["extract_size"], e["packed"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(EntrySource)
