"""Exact duplicates: static binary-fuse filters of an immutable snapshot screen each incoming batch.

A snapshot is written once: its classes (one row per text) and, for each bucket of digests, one three-wise binary fuse
filter (8-bit, about 9 bits a digest, never a false negative) as a row of bytes. It is loaded as it was written. The
batch is grouped on its own, one row per text; its digests meet their bucket's filter. What a filter rejects is new
and goes no further. What it lets through joins the exact bucket of classes, and all copies are compared byte for
byte with the text that stands for their class.

Both sides are aggregated to one row per text before anything is joined, so a hot text costs one row per task.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, discard, ship, table, whole_text
from lodestone.session import delete, shared_folder

#: Digests that a bucket's filter holds on average.
BUCKET = 100_000
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * _MIX[0]
        h = (h ^ (h >> np.uint64(33))) * _MIX[1]
        return h ^ (h >> np.uint64(33))


class FuseFilter:
    """Three-wise binary fuse filter of distinct 64-bit keys, built by peeling whole layers at a time."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        # segments overlap like fuses: a key's three slots lie in three segments that follow each other
        self.segment = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        self.segments = max(1, -(-int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 8))) + 16) // self.segment))
        self.cells = np.zeros((self.segments + 2) * self.segment, np.uint8)
        for seed in range(1, 200):
            self.seed = seed
            if n == 0 or self._build(keys):
                return
        raise RuntimeError("no seed gives a filter")

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = ((h >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        mask = np.uint64(self.segment - 1)
        at = np.stack([first * np.uint64(self.segment) + (h & mask), (first + np.uint64(1)) * np.uint64(self.segment) + ((h >> np.uint64(18)) & mask), (first + np.uint64(2)) * np.uint64(self.segment) + (_mixed(h, 7) & mask)])
        return at.astype(np.int64), ((h ^ (h >> np.uint64(29))) & np.uint64(255)).astype(np.uint8)

    def _build(self, keys: np.ndarray) -> bool:
        slots, print_ = self._slots(_mixed(keys, self.seed * 0x9E3779B97F4A7C15 & (1 << 63) - 1))
        n, size = len(keys), len(self.cells)
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the keys in a slot: the key itself once it is alone
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n))
        left, layers = n, []
        ready = np.nonzero(count == 1)[0]
        while len(ready):
            who, pick = np.unique(owner[ready], return_index=True)  # a key alone in two slots is taken in one
            layers.append((who, ready[pick]))
            left -= len(who)
            touched = slots[:, who]
            for row in touched:
                np.bitwise_xor.at(owner, row, who)
                np.subtract.at(count, row, 1)
            near = np.unique(touched)
            ready = near[count[near] == 1]
        if left:
            return False
        for who, where in reversed(layers):  # the keys of a layer share no slot that is assigned in it
            three = slots[:, who]
            self.cells[where] = 0
            self.cells[where] = print_[who] ^ self.cells[three[0]] ^ self.cells[three[1]] ^ self.cells[three[2]]
        return True

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        slots, print_ = self._slots(_mixed(keys.astype(np.uint64), self.seed * 0x9E3779B97F4A7C15 & (1 << 63) - 1))
        return (self.cells[slots[0]] ^ self.cells[slots[1]] ^ self.cells[slots[2]]) == print_

    def pack(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.cells.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> FuseFilter:
        self = cls.__new__(cls)
        self.seed, self.segment, self.segments = np.frombuffer(raw[:24], np.int64).tolist()
        self.cells = np.frombuffer(raw[24:], np.uint8)
        return self


def _key(digest: Column) -> Column:
    """64 bits of a hex digest, as a signed long."""
    return F.xxhash64(digest)


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.hash(digest, F.lit(17)), F.lit(buckets))


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter binary): one filter for each bucket of distinct (digest) rows."""
    ship(digests.sparkSession)

    def build(key: tuple, t: pa.Table) -> pa.Table:
        made = FuseFilter(t.column("key").to_numpy().view(np.uint64)).pack()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made], pa.binary())})

    keyed = digests.select(_bucket(F.col("digest"), buckets).alias("bucket"), _key(F.col("digest")).alias("key"))
    return keyed.groupBy("bucket").applyInArrow(build, "bucket int, filter binary")


def classes(digested: DataFrame) -> DataFrame:
    """(digest, keep, n): one row per text of a table of (doc_id, digest), its largest doc_id and its rows."""
    return digested.groupBy("digest").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n"))


@dataclass(frozen=True)
class Snapshot:
    """What ``save_snapshot`` has written: classes (digest, keep, n), filters (bucket, filter), number of buckets."""

    classes: DataFrame
    filters: DataFrame
    buckets: int


def save_snapshot(digested: DataFrame, folder: str, bucket_size: int = BUCKET) -> None:
    """Writes the snapshot of a table of (doc_id, digest) to a new folder, once and for all."""
    spark = digested.sparkSession
    classes(digested).write.parquet(f"{folder}/classes")
    held = spark.read.parquet(f"{folder}/classes")
    buckets = max(1, -(-held.count() // bucket_size))
    build_filters(held.select("digest"), buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/filters")


def load_snapshot(spark: SparkSession, folder: str) -> Snapshot:
    """The snapshot in a folder, filters as they were built."""
    filters = spark.read.parquet(f"{folder}/filters")
    row = filters.select("buckets").first()
    return Snapshot(spark.read.parquet(f"{folder}/classes"), filters.drop("buckets"), row[0] if row else 1)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The (digest, keep, n) classes of a batch with ``positive``: false is certain, true is to be verified.

    A bucket without a filter holds nothing. A bucket with more than BUCKET digests of the batch is cut into slices,
    each of which gets the filter.
    """
    ship(batch.sparkSession)
    slices = max(1, -(-batch.count() // (snapshot.buckets * BUCKET)))

    def test(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            hit = np.zeros(left.num_rows, bool)
        else:
            hit = FuseFilter.unpack(right.column("filter")[0].as_py()).may_hold(left.column("key").to_numpy().view(np.uint64))
        return left.select(["digest", "keep", "n"]).append_column("positive", pa.array(hit))

    key = _key(F.col("digest"))
    cut = lambda c: F.pmod(c, F.lit(slices)).cast("int").alias("slice")
    keyed = batch.select(_bucket(F.col("digest"), snapshot.buckets).alias("bucket"), cut(F.shiftright(key, 20)), "digest", key.alias("key"), "keep", "n")
    filters = snapshot.filters.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "filter")
    by = ["bucket", "slice"]
    return keyed.groupBy(*by).cogroup(filters.groupBy(*by)).applyInArrow(test, "digest string, keep long, n long, positive boolean")


def differing(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of (doc_id, digest, text) that are not the bytes of the row that stands for their (digest, keep) class."""
    # both right sides grow with the table: joined by shuffles whatever their sizes, so all sizes have one plan
    wanted = wanted.hint("merge")
    named = (texts["digest"] == wanted["digest"]) & texts["doc_id"].eqNullSafe(wanted["keep"])
    stands = checkpointed(texts.join(wanted, named).select(texts["digest"], "text").dropDuplicates(["digest"]))
    found = texts.join(stands.withColumnRenamed("text", "_stands").hint("merge"), "digest").filter(F.col("text") != F.col("_stands"))
    found._lodestone_at = stands._lodestone_at  # goes with what it is compared with
    return found


def exact_duplicates(docs: DataFrame, in_snapshot: Column, bucket_size: int = BUCKET) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    ``in_snapshot`` marks the rows that stand for the immutable snapshot; the others are the incoming batch.
    Of equal texts the row with the largest doc_id stays. Defined cases: null text is empty; of rows that
    repeat the largest doc_id each is kept; a null doc_id counts in its group and is kept only if the group
    has no other; an empty table gives an empty result; other columns are ignored. Two different texts with one
    SHA-256 digest raise an error.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", whole_text().alias("text"), F.coalesce(in_snapshot, F.lit(False)).alias("old")).withColumn("digest", F.sha2("text", 256))
    digested = checkpointed(texts.select("doc_id", "old", "digest"))
    folder = f"{shared_folder(spark)}/lodestone-{spark.sparkContext.applicationId}/snapshot-{uuid.uuid4().hex}"
    save_snapshot(digested.filter("old").drop("old"), folder, bucket_size)
    snapshot = load_snapshot(spark, folder)
    batch = checkpointed(classes(digested.filter("not old")))
    screened = checkpointed(screen(batch, snapshot))
    discard(batch)
    exact = snapshot.classes.select("digest", F.col("keep").alias("old_keep"), F.col("n").alias("old_n"))
    passed = checkpointed(screened.filter("positive").join(exact, "digest", "left"))
    met = passed.filter("old_n IS NOT NULL")
    apart = snapshot.classes.join(met.select("digest"), "digest", "left_anti")
    fresh = screened.filter("not positive").select("digest", "keep", "n").union(passed.filter("old_n IS NULL").select("digest", "keep", "n"))
    copied = fresh.filter("n > 1").union(apart.filter("n > 1")).select("digest", "keep").union(met.select("digest", "old_keep"))
    copied = checkpointed(copied)
    wrong = differing(texts, copied)
    if not wrong.isEmpty():
        raise ValueError("two different texts have one SHA-256 digest")
    both = met.select("digest", F.greatest("old_keep", "keep").alias("keep_id"), (F.col("old_n") + F.col("n")).alias("group_size"))
    # written out, so that the join below has a plain exchange on either side and hot digests can be split
    groups = checkpointed(fresh.union(apart).union(both))
    discard(screened, passed, copied, wrong)
    delete(spark, folder)
    rows = digested.join(groups, "digest").withColumnsRenamed({"keep": "keep_id", "n": "group_size", "digest": "text_sha256"})
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def older_half(docs: DataFrame) -> Column:
    """Rows up to the middle of the doc_id range: what an earlier crawl would have delivered."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= F.lit(((lo or 0) + (hi or 0)) // 2)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_duplicates(docs, older_half(docs))
