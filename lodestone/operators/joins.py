"""Index lookups between tables as equi-joins; what cannot be resolved is reported, not dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_header(streams: DataFrame, headers: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """Each stream with ``value`` of its last header in ``order``; null without one."""
    last = headers.groupBy(*key).agg(F.max_by(value, order).alias(value))
    return streams.join(last, list(key), "left")


def first_match(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """The least position of each key; a key that several entries have means the first of them."""
    return left.join(right.groupBy(key).agg(F.min(position).alias(position)), key, "left")


def by_bank(waves: DataFrame, entries: DataFrame, streamed: Column, memory_id: str, stream_id: str, bank: str, ident: str) -> DataFrame:
    """Waves to entries by the id that belongs to their bank: streamed ones by one column, others by another."""
    keyed = waves.withColumn(bank, F.when(streamed, "stream").otherwise("memory")).withColumn(ident, F.when(streamed, F.col(stream_id)).otherwise(F.col(memory_id)))
    return keyed.join(entries, [bank, ident], "left")


def companions(files: DataFrame, path: str, source: str, target: str) -> DataFrame:
    """(path, companion): files of one extension with the file of the other that has the same stem, if there is one."""
    stem = F.regexp_extract(path, r"^(.*)\.[^./]*$", 1)
    is_a = lambda e: F.endswith(F.lower(F.col(path)), F.lit(e))
    a = files.filter(is_a(source)).select(F.col(path), stem.alias("_s"))
    b = files.filter(is_a(target)).groupBy(stem.alias("_s")).agg(F.min(path).alias("companion"))
    return a.join(b, "_s", "left").drop("_s")


def resolve_index(rows: DataFrame, index: str, names: DataFrame, position: str, name: str, none: int = 0xFFFF) -> DataFrame:
    """Adds ``name`` by index. ``none`` means no reference; ``dangling`` marks an index that points nowhere."""
    at = names.select(F.col(position).alias("_p"), F.col(name), F.lit(True).alias("_hit"))
    joined = rows.join(at, rows[index] == at["_p"], "left")
    return joined.withColumn("dangling", (F.col(index) != none) & F.col("_hit").isNull()).drop("_p", "_hit")


def append_absent(rows: DataFrame, key: Sequence[str], value: str, order: str, out: str) -> DataFrame:
    """Different values of each key in the order they first come."""
    seen = rows.groupBy(*key, value).agg(F.min(order).alias("_o"))
    listed = seen.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_o", value))).alias("_l"))
    return listed.select(*key, F.transform("_l", lambda x: x[value]).alias(out))


def disagreeing(rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys whose rows differ in a column that must be the same for all."""
    counted = rows.groupBy(*key).agg(*[F.min(c).alias(f"least_{c}") for c in columns], *[F.max(c).alias(f"most_{c}") for c in columns])
    differs = [F.col(f"least_{c}") != F.col(f"most_{c}") for c in columns]
    return counted.filter(F.greatest(*[d.cast("int") for d in differs]) == 1 if len(differs) > 1 else differs[0])


def inferred_lengths(rows: DataFrame, key: Sequence[str], start: str, length: str) -> DataFrame:
    """The end of the latest part of each key."""
    return rows.groupBy(*key).agg(F.max(F.col(start) + F.col(length)).alias("inferred"))


def routed(items: DataFrame, item: str, hops: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(item, route, name): the name that the first successful of several routes leads to.

    ``hops`` has (route, hop, src, dst): a route walks its hops from 1 on, ``most`` at the most, and routes are tried in
    order of their number. ``names`` has (route, hop, node, name): what a route finds at a node after so many hops. All routes walk
    in the same joins, one a hop. Of several names of the winning route the least counts; an item that no route
    names has a null route and name.
    """
    front = items.select(F.col(item)).distinct().join(F.broadcast(hops.select("route").distinct())).select(item, "route", F.col(item).alias("node"))
    found = None
    for hop in range(1, most + 1):
        step = hops.filter(F.col("hop") == hop).select("route", F.col("src").alias("node"), "dst").distinct()
        front = front.join(step, ["route", "node"]).select(item, "route", F.col("dst").alias("node")).distinct()
        here = front.join(names.filter(F.col("hop") == hop).drop("hop"), ["route", "node"]).filter("name IS NOT NULL").select(item, F.struct("route", "name").alias("r"))
        found = here if found is None else found.union(here)
    best = found.groupBy(item).agg(F.min("r").alias("r"))
    return items.join(best, item, "left").select(*items.columns, F.col("r.route").alias("route"), F.col("r.name").alias("name"))
