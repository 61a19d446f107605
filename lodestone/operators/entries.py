"""Operators on entry tables: one row per archive entry, with a position that gives their order.

Editing returns a new DataFrame; positions stay gapless. Positions come from the entry table itself, so edits
are arithmetic on a column, and only reading an unnumbered table needs a sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.layout import align_up, running_offset


def numbered(df: DataFrame, order: Sequence[str], out: str = "pos") -> DataFrame:
    """Adds the global position in a total order, from 0, without a one-task window."""
    return running_offset(df.withColumn("_one", F.lit(1)), "_one", order, out).drop("_one")


def select_entries(df: DataFrame, positions: Sequence[int], pos: str = "pos") -> DataFrame:
    return df.filter(F.col(pos).isin(list(positions)))


def remove_entries(df: DataFrame, positions: Sequence[int], pos: str = "pos") -> DataFrame:
    """Drops entries and closes the gaps: each position falls by the removed ones before it."""
    gone = sorted(set(positions))
    fall = sum((F.when(F.col(pos) > g, 1).otherwise(0) for g in gone), F.lit(0))
    return df.filter(~F.col(pos).isin(gone)).withColumn(pos, F.col(pos) - fall)


def move_entry(df: DataFrame, source: int, target: int, pos: str = "pos") -> DataFrame:
    """Rotates one entry to another position; those between move by one."""
    p = F.col(pos)
    lo, hi, shift = (source + 1, target, -1) if source < target else (target, source - 1, 1)
    return df.withColumn(pos, F.when(p == source, F.lit(target)).when(p.between(lo, hi), p + shift).otherwise(p))


def add_entries(df: DataFrame, new: DataFrame, pos: str = "pos") -> DataFrame:
    """Appends entries (numbered from 0 among themselves) after the last position; missing columns are null."""
    end = df.agg(F.coalesce(F.max(pos) + 1, F.lit(0)).alias("_end"))
    moved = new.join(F.broadcast(end)).withColumn(pos, F.col(pos) + F.col("_end")).drop("_end")
    return df.unionByName(moved, allowMissingColumns=True)


def replace_values(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Takes ``column`` from ``changes`` where it has the key (once at most); other rows keep theirs."""
    new = changes.select(F.col(key).alias("_k"), F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    joined = df.join(new, df[key] == new["_k"], "left")
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_k", "_new", "_hit")


def rename_path(path: Column, directory: str | None = None, name: str | None = None) -> Column:
    """A path with another directory or another last part."""
    head, tail = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    folder = head if directory is None else F.lit(directory.rstrip("/") + "/" if directory else "")
    return F.concat(folder, tail if name is None else F.lit(name))


def assign_ids(df: DataFrame, ident: str, order: Sequence[str], start: int = 0) -> DataFrame:
    """Fills null ids with the least unused ones, in entry order.

    The k-th free id is k plus the used ids not above it, so used ids are ranked and each gap of free ones
    becomes a range: (first rank, first id). An entry's rank among the null ones finds its range.
    """
    used = df.filter(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("_u")).distinct()
    ranks = numbered(used, ["_u"], "_i").filter(F.col("_u") >= start)
    # after used id u with i used ids before it, the free ids above u start at rank u + 1 - start - (i + 1)
    after = ranks.select((F.col("_u") - F.col("_i") - start).alias("_rank"), (F.col("_u") + 1).alias("_first"))
    gaps = after.groupBy("_rank").agg(F.max("_first").alias("_first"))
    lack = numbered(df.filter(F.col(ident).isNull()).drop(ident), order, "_need")
    # the last gap whose first rank is not above the need: a running maximum over both, in rank order
    marks = gaps.select(F.col("_rank").alias("_need"), F.lit(0).alias("_kind"), (F.col("_first") - F.col("_rank")).alias("_shift"))
    block = 1 << 20
    asked = lack.select("_need", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_shift"))
    both = marks.union(asked).withColumn("_block", F.floor(F.col("_need") / block))
    carry = marks.groupBy(F.floor(F.col("_need") / block).alias("_block")).agg(F.max("_shift").alias("_top"))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.select("_block").distinct().join(carry, "_block", "left")
    carried = blocks.select("_block", F.max("_top").over(before).alias("_carried"))
    w = Window.partitionBy("_block").orderBy("_need", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.max("_shift").over(w)).filter("_kind = 1").join(F.broadcast(carried), "_block")
    ids = found.select("_need", (F.col("_need") + F.coalesce(F.greatest("_here", "_carried"), F.lit(start))).alias(ident))
    filled = lack.join(ids, "_need").drop("_need")
    return df.filter(F.col(ident).isNotNull()).unionByName(filled)


def repeated_ids(df: DataFrame, ident: str) -> DataFrame:
    """Explicit ids that more than one entry has: an archive with any is refused."""
    return df.filter(F.col(ident).isNotNull()).groupBy(ident).agg(F.count("*").alias("entries")).filter("entries > 1")


def next_id(df: DataFrame, ident: str) -> DataFrame:
    return df.agg(F.coalesce(F.max(ident) + 1, F.lit(0)).alias("next_id"))


def override_ids(toc: DataFrame, index: DataFrame, pos: str, ident: str) -> tuple[DataFrame, DataFrame]:
    """Index rows (``pos``, ``ident``) give their ids to the table's entries.

    Returns the entries, and the index rows that point outside the table: those are an error to report, never
    rows to lose in an inner join.
    """
    ids = index.select(F.col(pos).alias("_p"), F.col(ident).alias("_id"))
    joined = toc.join(ids, toc[pos] == ids["_p"], "left").withColumn(ident, F.coalesce("_id", ident)).drop("_p", "_id")
    dangling = index.join(toc.select(F.col(pos).alias("_p")), index[pos] == F.col("_p"), "left_anti")
    return joined, dangling


def path_key(path: Column) -> Column:
    """Sort key of archive paths: ASCII lower case, back slashes turned; a shorter path precedes its extensions."""
    upper = "".join(map(chr, range(65, 91))) + "\\"
    return F.translate(path, upper, upper.lower().replace("\\", "/"))


def archive_totals(df: DataFrame, packed: str, unpacked: str, directory: str, step: int) -> DataFrame:
    """Packed, unpacked and aligned bytes, and the number of different directories."""
    return df.agg(
        F.sum(packed).alias("packed"), F.sum(unpacked).alias("unpacked"), F.sum(align_up(F.col(packed), step)).alias("aligned"), F.countDistinct(directory).alias("directories")
    )


def presence(df: DataFrame, offset: Column, size: Column, group: Sequence[str] = ()) -> DataFrame:
    """A slot is present if its offset or size is not 0: count, first payload offset and payload end."""
    there = (offset != 0) | (size != 0)
    return df.groupBy(*group).agg(F.count_if(there).alias("present"), F.min(F.when(there, offset)).alias("first_offset"), F.max(F.when(there, offset + size)).alias("payload_end"))
