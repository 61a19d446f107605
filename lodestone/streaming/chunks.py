"""Chunk operators on unbounded input.

Event times carry a watermark, so windows close and late chunks are dropped by a stated delay. Per-stream
offsets need state for each stream only: its bytes so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def windowed_totals(chunks: DataFrame, key: str, time: str, size: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Chunks and payload bytes of each stream and window; rows later than ``late`` are dropped."""
    return (
        chunks.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), key)
        .agg(F.count("*").alias("chunks"), F.sum(size).alias("payload_bytes"))
        .select(F.col("w.start").alias("window_start"), key, "chunks", "payload_bytes")
    )


def first_seen(chunks: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """One chunk of each key within the watermark: repeats of a chunk id are dropped."""
    return chunks.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stream_offsets(chunks: DataFrame, key: str, seq: str, size: str) -> DataFrame:
    """(key, seq, byte_offset): where each chunk lies in its stream's payload, in arrival order of batches and in
    ``seq`` order inside one."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(seq)
        ends = rows[size].fillna(0).astype("int64").cumsum() + at
        state.update((int(ends.iloc[-1]),))
        yield pd.DataFrame({key: rows[key], seq: rows[seq], "byte_offset": ends - rows[size].fillna(0).astype("int64")})

    kinds = dict(chunks.dtypes)
    schema = f"{key} {kinds[key]}, {seq} {kinds[seq]}, byte_offset long"
    return chunks.select(key, seq, size).groupBy(key).applyInPandasWithState(step, schema, "bytes long", "append", "NoTimeout")
