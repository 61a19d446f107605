"""Names that are given once: what clashes is renamed until no two entries share a name.

The first entry of a name keeps it, so a name that the entries bring is never given to another one. Names that are made
join the taken ones, and only rows that still clash go on. Numbers come last, in closed form: the k-th row of a family
gets the k-th number whose name is free, which is k plus the taken numbers below it. Ranks and counts are distributed
prefix sums, so a family may hold most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.entries import numbered
from lodestone.operators.layout import running_offset
from lodestone.session import checkpointed

_STEM = r"^(.*?[^/])(\.[^./]*)?$"


def with_suffix(path: Column, suffix: Column) -> Column:
    """A path with a suffix before its extension; a leading dot begins no extension."""
    return F.concat(F.regexp_extract(path, _STEM, 1), suffix, F.regexp_extract(path, _STEM, 2))


def _ranked(df: DataFrame, family: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Adds the place of each row in its family, from 1, by one global prefix sum."""
    placed = numbered(df, [*family, *order], "_g")
    first = placed.groupBy(*family).agg(F.min("_g").alias("_first"))
    return placed.join(first, list(family)).select(*df.columns, (F.col("_g") - F.col("_first") + 1).alias(out))


def _suffixed(rows: DataFrame, order: Sequence[str], taken: DataFrame) -> DataFrame:
    """``rows`` (with _head and _tail) and their ``_made``: _head, a number from 1, _tail, none of them ``taken`` (_name)."""
    family = ["_head", "_tail"]
    needs = _ranked(rows, family, order, "_k")
    parts = taken.select(F.regexp_extract("_name", _STEM, 1).alias("_stem"), F.regexp_extract("_name", _STEM, 2).alias("_tail"))
    dotted = taken.select(F.col("_name").alias("_stem"), F.lit("").alias("_tail"))
    number = r"^(.*)_([1-9][0-9]{0,17})$"
    used = parts.union(dotted).select(F.regexp_extract("_stem", number, 1).alias("_head"), "_tail", F.try_to_number(F.regexp_extract("_stem", number, 2), F.lit("9" * 18)).cast("long").alias("_n"))
    used = used.filter("_n IS NOT NULL").distinct().join(rows.select(*family).distinct(), family, "left_semi")
    # the i-th taken number n has n - i free ones below it, so it lies before the k-th free one if n - i < k
    marks = _ranked(used, family, ["_n"], "_i").select(*family, (F.col("_n") - F.col("_i") + 1).alias("_k"), F.lit(0).alias("_kind"), F.lit(1).alias("_one"))
    asked = needs.select(*family, "_k", F.lit(1).alias("_kind"), F.lit(0).alias("_one"))
    counted = running_offset(marks.union(asked), "_one", [*family, "_k", "_kind"], "_c")
    start = counted.groupBy(*family).agg(F.min("_c").alias("_start"))
    number = counted.filter("_kind = 1").join(start, family).select(*family, "_k", (F.col("_k") + F.col("_c") - F.col("_start")).alias("_number"))
    made = F.concat("_head", F.lit("_"), F.col("_number").cast("string"), "_tail")
    return needs.join(number, [*family, "_k"]).withColumn("_made", made).select(*rows.columns, "_made")


def _first_of(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """``df`` with ``_is_first``: whether a row is the first of its name. A minimum and a join, so a name may be on most rows."""
    at = F.struct(*order)
    least = df.groupBy(name).agg(F.min(at).alias("_least"))
    return df.join(least, name).withColumn("_is_first", F.col("_least").eqNullSafe(at)).drop("_least").select(*df.columns, "_is_first")


def allocated(df: DataFrame, name: str, order: Sequence[str], tries: Sequence[Column] = (), paths: bool = False, out: str = "unique_name") -> DataFrame:
    """Adds ``out``, which no two rows share: the name itself for its first row in ``order`` (a total order without nulls), else the first of
    ``tries`` that is free when the rows before it in the order have chosen, else the last try (or the name) with a number.

    With ``paths`` numbers go before the extension. A null name stays null.
    """
    order = list(order)
    named = df.filter(F.col(name).isNotNull())
    # each step is written out: the next ones read it several times and would compute it, and all before it, each time
    state = checkpointed(_first_of(named, name, order))
    settled = state.filter("_is_first").drop("_is_first").withColumn(out, F.col(name))
    left = state.filter("NOT _is_first").drop("_is_first")
    taken = checkpointed(named.select(F.col(name).alias("_name")).distinct()) if tries else named.select(F.col(name).alias("_name")).distinct()
    for make in tries:
        asked = left.withColumn("_try", make)
        free = asked.join(taken.withColumnRenamed("_name", "_try"), "_try", "left_anti")
        state = checkpointed(_first_of(free, "_try", order))
        won = state.filter("_is_first").drop("_is_first")
        settled = settled.unionByName(won.withColumn(out, F.col("_try")).drop("_try"))
        taken = taken.union(won.select("_try"))
        left = checkpointed(left.join(won.select(*order), order, "left_anti"))
    base = tries[-1] if tries else F.col(name)
    head, tail = (F.regexp_extract(base, _STEM, 1), F.regexp_extract(base, _STEM, 2)) if paths else (base, F.lit(""))
    numbers = _suffixed(left.withColumn("_head", head).withColumn("_tail", tail), order, taken)
    settled = settled.unionByName(numbers.withColumn(out, F.col("_made")).select(*df.columns, out))
    return settled.unionByName(df.filter(F.col(name).isNull()).withColumn(out, F.lit(None).cast("string")))


def unique_names(df: DataFrame, name: str, order: Sequence[str], out: str = "unique_name") -> DataFrame:
    """The first entry of a name keeps it, later ones get _1, _2 and so on, whatever is not the name of another entry."""
    return allocated(df, name, order, out=out)


def unique_paths(df: DataFrame, path: str, ident: str, pos: str, out: str = "safe_path") -> DataFrame:
    """The first entry of a path keeps it; later ones get their id before the extension; where that is taken, id and position;
    where that is taken too, a number behind them."""
    by_id = F.concat(F.lit("_"), F.coalesce(F.col(ident).cast("string"), F.lit("")))
    both = F.concat(by_id, F.lit("_"), F.col(pos).cast("string"))
    return allocated(df, path, [pos], [with_suffix(F.col(path), by_id), with_suffix(F.col(path), both)], True, out)
