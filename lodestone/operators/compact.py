"""Typed binary tables as DataFrames: how columns are stored, dictionary offsets, and edits of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.layout import running_offset


def storage_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, storage): how each column would be stored, from one aggregation over the table.

    ``name``: all values are missing; ``default``: more than one row and all equal; ``row`` otherwise. One row
    with a value is stored per row, never as a default.
    """
    names = list(columns or df.columns)
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        aggs += [F.count(c).alias(f"v{i}"), F.min(F.col(c).cast("string")).alias(f"a{i}"), F.max(F.col(c).cast("string")).alias(f"b{i}")]
    one = df.agg(*aggs)
    kind = lambda i: (
        F.when(F.col(f"v{i}") == 0, "name").when((F.col("n") > 1) & (F.col(f"v{i}") == F.col("n")) & (F.col(f"a{i}") == F.col(f"b{i}")), "default").otherwise("row")
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), kind(i).alias("storage")) for i, c in enumerate(names)])).alias("r")).select("r.*")


def resolve(row: Column | None, default: Column | None, has_row: bool, has_default: bool) -> Column:
    """The value of a cell: the row's where the column has row storage, even a null one; else the default."""
    if has_row:
        return row
    return default if has_default else F.lit(None)


def dictionary(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """(value, offset): the string table of a column. Strings stand once, in the order first seen, each with a
    zero byte after it."""
    seen = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(*[F.min(F.struct(*order)).alias("_first")])
    sized = seen.withColumn("_size", F.octet_length("value") + 1)
    return running_offset(sized, "_size", ["_first"], "string_offset").select("value", "string_offset")


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A new column is null in all rows there are."""
    return df.withColumn(name, F.lit(None).cast(kind))


def retype_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Another type empties the column; the same type leaves it."""
    same = dict(df.dtypes).get(name) == kind
    return df if same else df.withColumn(name, F.lit(None).cast(kind))


def set_cell(df: DataFrame, pos: str, at: int, name: str, value) -> DataFrame:
    return df.withColumn(name, F.when(F.col(pos) == at, F.lit(value)).otherwise(F.col(name)))


def visible_columns(names: Sequence[str], wanted: Sequence[str], most: int = 4) -> list[str]:
    """Up to ``most`` columns to show: the wanted ones in their order, then others in table order."""
    first = [w for w in wanted if w in names]
    return (first + [n for n in names if n not in first])[:most]


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
