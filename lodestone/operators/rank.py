"""Evidence, score, rank: candidate tables with a score and the evidence behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Candidates kept by default (fixed value of the reports).
KEPT = 10


def top(df: DataFrame, order: Sequence[Column], most: int = KEPT) -> DataFrame:
    """The best candidates over all rows: each task keeps its own best, one merges them."""
    return df.orderBy(*order).limit(most)


def top_each(df: DataFrame, group: Sequence[str], order: Sequence[Column], most: int = KEPT, out: str = "place") -> DataFrame:
    """The best candidates of each group; Spark limits each group before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(out) <= most)


def with_ties(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows that tie for the best of their group: an aggregate and a join, so groups can be large."""
    key = F.struct(*order)
    best = df.groupBy(*group).agg(F.min(key).alias("_best"))
    return df.withColumn("_key", key).join(best, list(group)).filter(F.col("_key") == F.col("_best")).drop("_key", "_best")


def merge_scores(df: DataFrame, key: Sequence[str], score: str, support: str) -> DataFrame:
    """Candidates of one key become one: mean score weighted by support, and the summed support."""
    return df.groupBy(*key).agg((F.sum(F.col(score) * F.col(support)) / F.sum(support)).alias(score), F.sum(support).alias(support))


def consensus(df: DataFrame, key: str, mask: int, source: str, score: str) -> DataFrame:
    """Candidates compatible on the masked bits of the key: how many sources agree, and the best score."""
    low = F.col(key).bitwiseAND(F.lit(mask))
    return df.groupBy(low.alias("shared_bits")).agg(F.countDistinct(source).alias("sources"), F.count("*").alias("evidence"), F.max(score).alias("best_score"))


def dedupe_by_signature(df: DataFrame, signature: Column, order: str) -> DataFrame:
    """Rows of one signature become one: the least ``order`` stands for them, with how many there were."""
    return df.groupBy(signature.alias("signature")).agg(F.min(order).alias("first"), F.count("*").alias("members"))


def best_by(df: DataFrame, key: Sequence[str], support: str, score: str, value: str) -> DataFrame:
    """The value with the most support, then the highest score, then the least value."""
    return df.groupBy(*key).agg(F.max(F.struct(F.col(support), F.col(score), (-F.col(value)).alias("_v"))).alias("b")).select(*key, F.col(f"b.{support}"), F.col(f"b.{score}"), (-F.col("b._v")).alias(value))


def byte_histogram(df: DataFrame, text: str, period: int) -> DataFrame:
    """(slot, byte, n): how often each byte stands at each position modulo ``period``.

    Positions unfold inside one stage and are counted there first, so the shuffle has period x 256 rows a task.
    """
    spread = df.select(F.posexplode(F.split(F.hex(F.col(text).cast("binary")), "(?<=\\G..)")).alias("i", "h")).filter("h <> ''")
    return spread.groupBy(F.pmod(F.col("i"), F.lit(period)).cast("int").alias("slot"), F.conv("h", 16, 10).cast("int").alias("byte")).agg(F.count("*").alias("n"))
