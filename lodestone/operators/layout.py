"""Layout of entries in one address space: alignment and a distributed exclusive prefix sum.

A global window without a partition key would pull every row into one task. Here rows are range
partitioned by the order key, each partition is summed on its own, and the short list of partition
totals (one row per partition, so bounded by the partition count) gives every partition its start.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import checkpointed, ship

#: Groups that a task holds at a time while it folds.
GROUPS = 100_000


def align_up(value: Column, step: int) -> Column:
    """The least multiple of ``step`` that is not below ``value``, in integer arithmetic."""
    up = value + F.lit(step - 1)
    return up - F.pmod(up, F.lit(step))


def ranged(df: DataFrame, order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """Range partitions by the order keys and tags each row with its range, ``_range``.

    The result is checkpointed: the bounds come from a sample that another evaluation of the same plan may
    draw differently, and every reader of the tags must see the same ranges.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return checkpointed(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def running_offset(df: DataFrame, size: str, order: Sequence[str], out: str, parts: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over all rows before this one in the global order.

    ``order`` must be a total order (ties get an unspecified order). Null sizes count as 0; an empty input
    gives an empty output.
    """
    tagged = ranged(df, [F.col(c) for c in order], parts)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_before", F.coalesce(F.sum(F.coalesce(F.col(size), F.lit(0))).over(inside), F.lit(0)))
    totals = tagged.groupBy("_range").agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("_total"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_start"))
    return (
        local.join(F.broadcast(starts), "_range")
        .withColumn(out, (F.col("_before") + F.col("_start")).cast("long"))
        .drop("_range", "_before", "_start")
    )


def divide_up(value: Column, by: int) -> Column:
    """Integer quotient rounded up, for values not below 0."""
    return (align_up(value, by) / F.lit(by)).cast("long")


def padded_layout(df: DataFrame, size: str, order: Sequence[str], step: int, base: int, out: str = "file_offset") -> DataFrame:
    """Bank layout: payloads start on multiples of ``step`` after ``base``; the last one is not padded.

    Adds ``out`` (start), ``end_offset`` (start plus the unpadded size) and ``stored`` (bytes taken in the file).
    """
    sized = df.withColumn("_step", align_up(F.coalesce(F.col(size), F.lit(0)), step))
    placed = running_offset(sized, "_step", order, "_rel")
    last = placed.agg(F.max("_rel").alias("_last"))
    start = align_up(F.lit(base).cast("long"), step) + F.col("_rel")
    return (
        placed.join(F.broadcast(last))
        .withColumn(out, start)
        .withColumn("end_offset", start + F.coalesce(F.col(size), F.lit(0)))
        .withColumn("stored", F.when(F.col("_rel") == F.col("_last"), F.col(size)).otherwise(F.col("_step")))
        .drop("_step", "_rel", "_last")
    )


def seek_index(df: DataFrame, size: str, order: Sequence[str], keyframe: Column, out: str = "byte_offset") -> DataFrame:
    """Running byte offset of each chunk; only key frames are kept."""
    return running_offset(df, size, order, out).filter(keyframe)


def segment_ranges(df: DataFrame, length: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``range_start`` and ``range_end``: back-to-back ranges inside each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    total = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("range_end", total).withColumn("range_start", F.col("range_end") - F.col(length))


def gcd_of(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Greatest common divisor of a column, by group: an associative fold, so each task folds what it reads first.

    Every task passes on one value for each group it has seen, so a group's list is as long as there are tasks (longer
    only where a task sees more than GROUPS groups); a higher-order function folds that by Euclid's steps. Nulls and
    zeros do not count.
    """
    v = F.abs(F.col(value).cast("long"))
    some = df.filter(F.coalesce(v, F.lit(0)) != 0).select(*group, v.alias("_v"))
    names = list(group)
    ship(df.sparkSession)

    def fold(batches):
        held: dict[tuple, int] = {}
        schema = None

        def out():
            columns = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(held.values(), pa.int64())], schema=schema)

        for batch in batches:
            schema = batch.schema
            values, (places, keys) = batch.column("_v").to_numpy(), _grouped(batch, names)
            for key, g in zip(keys, np.gcd.reduceat(values[places[0]], places[1]).tolist()):
                held[key] = math.gcd(held.get(key, 0), g)
            if len(held) > GROUPS:
                yield out()
                held = {}
        if held:
            yield out()

    step = lambda a, b: F.aggregate(
        F.sequence(F.lit(1), F.lit(92)), F.struct(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")),
        lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y"))), lambda s: s["x"],
    )
    parts = some.mapInArrow(fold, some.schema)
    return parts.groupBy(*group).agg(F.aggregate(F.collect_set("_v"), F.lit(0).cast("long"), step).alias("gcd"))


def _grouped(batch: pa.RecordBatch, names: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], list[tuple]]:
    """((order, starts), keys): the rows of a batch in an order in which those of one key stand together."""
    if not names:
        return (np.arange(batch.num_rows), np.zeros(min(1, batch.num_rows), np.int64)), [()] * min(1, batch.num_rows)
    codes = np.zeros(batch.num_rows, np.int64)
    for n in names:
        column = pc.dictionary_encode(batch.column(n), null_encoding="encode")
        _, codes = np.unique(codes * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    starts = np.nonzero(np.append(True, np.diff(codes[order]) > 0))[0] if len(order) else order
    firsts = batch.select(names).take(pa.array(order[starts]))
    return (order, starts), list(zip(*[c.to_pylist() for c in firsts.columns]))
