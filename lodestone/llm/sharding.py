"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns VNODES points on a ring of 2^32 positions; a row belongs to the first point clockwise of the
hash of its text, so equal texts meet. Each shard holds at most its capacity: the row count split as evenly as
whole rows allow. Points are served clockwise from position 0; what finds its shard full continues clockwise
to the next point whose shard has room, so counts are at most one apart and only the overflow moves.

Only counts per arc decide who overflows, and the arcs are fixed by parameters. Rows are counted per cell (an
arc and a slice of doc_id hashes, so one hot text is spread over many cells), the bounded table of arc counts
is walked on the driver, and each row finds its shard and slot from its rank: rank in the cell, plus the
cell's offset in the arc, against the pieces into which the walk has cut the arc.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import checkpointed, table

SHARDS = 16
VNODES = 32
#: Slices of an arc; a cell is a slice of an arc, and the largest group that one task sorts.
SLICES = 64


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of every point, clockwise; positions come from MD5, ties go to the lesser shard."""
    points = {}
    for s in range(shards - 1, -1, -1):
        for v in range(vnodes):
            points[int(hashlib.md5(f"{s}:{v}".encode()).hexdigest()[:8], 16)] = s
    return sorted(points.items())


def walk(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[dict]:
    """Serves the arcs clockwise. Returns pieces: rows lo..hi-1 of an arc go to a shard, from slot ``slot``."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, pieces = [0] * shards, []
    for arc in range(len(points)):
        lo, left, at = 0, counts.get(arc, 0), arc
        while left:
            s = points[at % len(points)][1]
            take = min(left, room[s] - used[s])
            if take:
                pieces.append({"arc": arc, "lo": lo, "hi": lo + take, "shard": s, "slot": used[s]})
                used[s] += take
                lo, left = lo + take, left - take
            at += 1
    return pieces


def _bounded(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of literals, for lists whose length parameters bound."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def position(text: Column) -> Column:
    """Ring position of a text: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def arc_of(pos: Column, points: list[tuple[int, int]]) -> Column:
    """Number of the first point at or after a position, clockwise: a binary search in nested conditions."""
    at = [p for p, _ in points]

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo % len(at))
        mid = (lo + hi) // 2
        return F.when(pos <= at[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(at))


def arc_number(pos: int, points: list[tuple[int, int]]) -> int:
    """The same for one integer; the brute-force check uses it."""
    return bisect_left([p for p, _ in points], pos) % len(points)


def shard_rows(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Defined cases: null text has size 1 and the checksum of nothing; repeated rows are placed one by one, in an
    arbitrary order among themselves; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), position(raw).alias("pos"))
    cell = F.pmod(F.xxhash64("pos", "doc_id"), F.lit(SLICES)).cast("int")
    placed = checkpointed(rows.select("doc_id", "size", "text_crc32", arc_of(F.col("pos"), points).alias("arc"), cell.alias("cell")))
    counts = placed.groupBy("arc", "cell").agg(F.count("*").alias("n")).collect()  # at most shards * vnodes * SLICES rows
    per_cell = sorted((r.arc, r.cell, r.n) for r in counts)
    starts, arcs = [], {}
    for arc, c, n in per_cell:
        starts.append({"arc": arc, "cell": c, "start": arcs.get(arc, 0)})
        arcs[arc] = arcs.get(arc, 0) + n
    pieces = _bounded(spark, walk(points, arcs, shards), "arc int, lo long, hi long, shard int, slot long")
    offsets = _bounded(spark, starts, "arc int, cell int, start long")
    inside = Window.partitionBy("arc", "cell").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["arc", "cell"]).withColumn("at", F.col("rank") + F.col("start")).drop("cell", "rank", "start")
    cut = F.broadcast(pieces.withColumnRenamed("arc", "own").withColumnRenamed("slot", "from"))
    held = ranked.join(cut, (F.col("arc") == F.col("own")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    return held.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("from") + F.col("at") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
