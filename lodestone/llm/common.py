"""Shared pieces of the document operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import checkpointed, discard, ship, table

__all__ = ["checkpointed", "discard", "ship", "table", "map_texts", "pieces", "spread", "whole_text", "word_spans"]

#: Bytes of text that a Python worker expands at a time; a longer single text is a piece of its own.
PIECE_BYTES = 4 << 20


def whole_text(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan of very few partitions (one row group, say) out to all cores before Python works on it.

    Plans with exchanges are left alone: Spark has dealt them already, and to count their partitions would run them.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() <= cores else df


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about ``most`` bytes of text each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def word_spans(texts: pa.Array, in_word: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts after ``lower``, start and size of each word, the number of its text), by tables of 256 bytes."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = texts.buffers()[2]
    data = lower[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = in_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words end where texts do
    before = np.append(False, inside[:-1]) if len(inside) else inside
    starts = np.nonzero(inside & (~before | edge[:-1]))[0]
    after = np.append(inside[1:], False) if len(inside) else inside
    sizes = np.nonzero(inside & (~after | edge[1:]))[0] + 1 - starts
    return data, starts, sizes, np.searchsorted(offsets, starts, "right") - 1


def map_texts(docs: DataFrame, f: Callable[[pa.Array, list[str]], dict], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Applies ``f(keys, texts)`` to slices of (key, text) rows; it returns columns by name.

    Only the two columns reach Python; null texts arrive as empty.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    out = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                got = f(piece.column(0), piece.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(got[n.name], type=n.type) for n in arrow], schema=arrow)

    return spread(docs.select(F.col(key).alias("k"), whole_text(text).alias("t"))).mapInArrow(over, out)
