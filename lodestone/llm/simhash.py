"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits. Up to CROSSING fingerprints it is cut into three segments of 21, 21 and 22 bits. If two
fingerprints differ in at most 4 bits, the differences cannot fill all of (two, two, one): so the first or second
segment differs in at most one bit, or the third in none. Each fingerprint therefore looks up the Hamming balls of
radius 1 around its first two segments and the third segment itself: 45 probes, each of which meets about n / 2^21
others by chance. Beyond CROSSING those outweigh the probes, and two segments of 32 bits with balls of radius 2 and 1
are taken: 562 probes, each of which meets n / 2^32. Every match is verified on all 64 bits inside the join, so only
true links leave it.

Rows with one fingerprint are one class before anything is probed; hot groups of copies cost one row here.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, map_texts
from lodestone.llm.components import components

#: (shift, bits, radius) of the segments; sum of (radius + 1) = 5 = threshold + 1.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
WIDE_SEGMENTS = ((0, 32, 2), (32, 32, 1))
#: Fingerprints above which matches by chance cost more than further probes.
CROSSING = 1 << 30
THRESHOLD = 4
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; fewer words give one hash, none give none."""
    from xxhash import xxh64_intdigest as h

    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) < words:
        return np.array([h(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))


def majorities(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the hashes of each row of a matrix; none for no hashes.

    Byte lanes add up to 255 hashes at a time, so 8 shifted sums replace 64 bit columns.
    """
    rows, n = hashes.shape
    if not n:
        return np.zeros(rows, np.uint64)
    cuts = np.arange(0, n, 255)
    counts = np.empty((rows, 8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts, axis=1)
        counts[:, :, bit] = lanes.astype("<u8").view(np.uint8).reshape(rows, -1, 8).sum(1, dtype=np.int64)
    bits = (2 * counts.reshape(rows, 64) > n).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def majority(hashes: np.ndarray) -> int:
    """The same of one row."""
    return int(majorities(hashes[None, :])[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long; null and wordless texts give 0."""

    def of(keys: pa.Array, texts: list[str]) -> dict:
        fps = np.array([majority(shingle_hashes(t, words)) for t in texts], np.uint64)
        return {"doc_id": keys, "fp": fps.view(np.int64)}

    return map_texts(docs, of, "doc_id long, fp long")


def _segment(fp: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _keys(fp: Column, segments: tuple, probe: bool) -> Column:
    """Array of table keys: the segment's number above bit 32, its value below."""
    keys = []
    for number, (shift, bits, radius) in enumerate(segments):
        value = _segment(fp, shift, bits).bitwiseOR(F.lit(number << 32))
        flips = [sum(1 << i for i in flipped) for size in range(radius + 1 if probe else 1) for flipped in combinations(range(bits), size)]
        keys.append(F.array(*[value.bitwiseXOR(F.lit(x).cast("long")) for x in flips]))
    return F.flatten(F.array(*keys))


def links(classes: DataFrame, threshold: int = THRESHOLD, segments: tuple | None = None) -> DataFrame:
    """(a, b): all pairs of different fingerprints in ``classes.fp`` (distinct, nonnull) within the threshold."""
    segments = segments or (SEGMENTS if classes.count() <= CROSSING else WIDE_SEGMENTS)
    if sum(radius + 1 for _, _, radius in segments) < threshold + 1:
        raise ValueError("the segments do not guarantee this threshold")
    table = classes.select(F.col("fp").alias("b"), F.explode(_keys(F.col("fp"), segments, False)).alias("key"))
    probes = classes.select(F.col("fp").alias("a"), F.explode(_keys(F.col("fp"), segments, True)).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return probes.join(table, (probes["key"] == table["key"]) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    Defined cases: null or wordless text has fingerprint 0 and links like any other; repeated rows share a
    component; an empty table gives an empty result; other columns of ``docs`` are ignored. The component is
    named by its smallest doc_id.
    """
    fps = checkpointed(fingerprints(docs, words))
    classes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    pairs = checkpointed(links(classes, threshold))
    roots = components(pairs)
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written out, so that the joins below have plain exchanges on either side and large components can be split
    least = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = checkpointed(rooted.join(least, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    from lodestone.session import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
