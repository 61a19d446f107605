"""Functions under SQL names. Byte functions are Arrow-batched; the others are column expressions already."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.codecs import checks, compress
from lodestone.codecs import table as tables
from lodestone.session import ship


def _map(f):
    return lambda s: s.map(lambda b: None if b is None else f(b.encode() if isinstance(b, str) else bytes(b)))


def register(spark: SparkSession) -> None:
    """Makes unmask_table, decompress_payload, compress_payload, crc16_msb, checksum_769, legacy_text and u16_list
    callable from SQL."""
    ship(spark)

    def add(name: str, kind: str, f) -> None:
        def apply(s: pd.Series) -> pd.Series:
            return _map(f)(s)

        spark.udf.register(name, F.pandas_udf(apply, kind))

    add("unmask_table", "binary", tables.masked)
    add("decompress_payload", "binary", lambda b: compress.decompress(b) if b[:8] == compress.MAGIC else b)
    add("compress_payload", "binary", compress.compress)
    add("crc16_msb", "int", checks.crc16)
    add("checksum_769", "bigint", checks.checksum769)
    add("legacy_text", "string", lambda b: checks.guess_text(b)[1])
    add("u16_list", "array<int>", checks.u16_list)


def register_tables(spark: SparkSession) -> None:
    """Makes archive_entries(content), stream_chunks(content) and nested_tables(content) callable as table functions: ``SELECT f.*
    FROM blobs, LATERAL archive_entries(content) f``. Null or unreadable content gives no rows."""
    from pyspark.sql.functions import udtf

    from lodestone.codecs import archives, media, stream
    from lodestone.sources.files import ENTRY

    ship(spark)

    def add(name: str, schema: str, read) -> None:
        columns = [c.split()[0] for c in schema.split(", ")]

        class Rows:
            def eval(self, content: bytes):
                try:
                    rows = read(bytes(content)) if content is not None else []
                except (ValueError, LookupError):
                    rows = []
                for r in rows:
                    yield tuple(r.get(c) for c in columns)

        spark.udtf.register(name, udtf(Rows, returnType=schema))

    add("archive_entries", ENTRY, lambda raw: archives.PARSERS[archives.kind_of(raw[:16])](raw))
    add("stream_chunks", "chunk_no long, chunk_offset long, magic string, channel int, payload_type string, frame_time long, payload binary", stream.parse_chunks)
    add("nested_tables", "place string, table_name string, n_rows long, n_columns int", lambda raw: media.nested_tables(raw, 4))
