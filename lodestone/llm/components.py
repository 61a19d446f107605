"""Connected components of a distributed edge list.

Alternates two star steps until the edges stop changing. In the large-star step each node hands the least of
its neighbours to the greater ones, in the small-star step to the lesser ones. Each step sends one row per
edge; minima are taken by partial aggregation, so a hub costs one row per task, and AQE can split its join.
Every round is checkpointed; nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import checkpointed, discard


def _step(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    # now u > v on every row
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the pairs (first two columns); the root is the component's least node."""
    a, b = pairs.columns[:2]
    edges = checkpointed(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not now[0] or now == seen:
            break
        seen, before = now, edges
        edges = checkpointed(_step(edges))
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
