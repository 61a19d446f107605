"""SimHash near-dedup at a Jaccard similarity: wide fingerprints, multi-index hashing, verified shingle sets.

At a similarity of 0.8 two fingerprints differ in some 15 % of their bits, too many for 64 bits and a distance of 4.
Here the fingerprint of a text's set of five-word shingles has several 64-bit lanes, cut into segments. Every
fingerprint enumerates the Hamming ball of radius 1 around each of its segments and looks all of it up: two texts meet
where a segment differs in at most two bits. What meets is verified on the complete distance inside the join, and
after that on the whole shingle sets. ``geometry`` sets the segments so that a pair at SIMILARITY is missed with
probability MISS at most, and so that segments are as wide as the number of texts asks for.

Texts with equal shingle sets are one node. Nodes are first compared with one node of equal segments, which joins large groups of near copies cheaply; then all pairs of different components so far are looked up. Of a group that is
alike but mostly under SIMILARITY, the join passes on few pairs: a parity bit map of each set bounds what two sets differ in from below.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, discard, map_texts
from lodestone.llm.components import components
from lodestone.llm.simhash import majorities, shingle_hashes

WORDS, SIMILARITY, MISS = 5, 0.8, 0.002
#: Bits of a segment at least; more as soon as there are more texts than segment values.
SEGMENT_BITS = 20
#: Rounds of one node against its group; more than one are worth it if one node in HOT or
#: more lies in the same component.
ROUNDS, HOT = 3, 100
#: 64-bit words of the parity bit map of a set.
MAPS = 4
#: Pairs whose sets are compared at a time, for each set that is sent: sets are sent no more often than pairs ask for.
PAIRS_A_SET = 2


@dataclass(frozen=True)
class Geometry:
    """``lanes`` of 64 bits with ``per_lane`` segments of ``bits`` each, and the greatest ``distance`` of a pair."""

    bits: int
    per_lane: int
    lanes: int
    distance: int


def geometry(texts: int) -> Geometry:
    """Segments for a number of texts.

    The share p of differing bits follows from the angle between two sets of SIMILARITY; a segment is met if it
    differs in two bits or fewer, and the distance is two and a half standard deviations above its mean.
    """
    p = acos(2 * SIMILARITY / (1 + SIMILARITY)) / pi
    bits = min(32, max(SEGMENT_BITS, texts.bit_length()))
    met = sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    per_lane = 64 // bits
    lanes = ceil(log(MISS) / log(1 - met) / per_lane)
    return Geometry(bits, per_lane, lanes, int(64 * lanes * p + 2.5 * sqrt(64 * lanes * p * (1 - p))))


def _shingles(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


def _name(shingles: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest as h

    return h(shingles.tobytes())


def wide(shingles: np.ndarray, lanes: int) -> np.ndarray:
    """The lanes of a set's fingerprint; each lane is the majority of its own hash of the shingles."""
    k = np.arange(lanes, dtype=np.uint64)[:, None]
    h = shingles[None, :] * (np.uint64(2) * k + np.uint64(0x9E3779B97F4A7C15)) + k
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return majorities(h ^ (h >> np.uint64(32)))


def parity(shingles: np.ndarray) -> np.ndarray:
    """MAPS words with a bit for each place by the hash, set where an odd number of shingles falls: two maps differ in no
    more bits than the sets do in shingles."""
    odd = np.bincount((shingles & np.uint64(64 * MAPS - 1)).astype(np.int64), minlength=64 * MAPS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _least(shingles: np.ndarray) -> list[int]:
    """Sets of four, and those of five without one shingle: the only ones of at least 0.8 that differ below nine."""
    if len(shingles) == 5:
        return [_name(np.delete(shingles, i)) for i in range(5)]
    return [_name(shingles)] if len(shingles) == 4 else []


def signatures(docs: DataFrame, lanes: int) -> DataFrame:
    """(doc_id, text_sha256, node, lanes, small, size, maps): the set's name, its fingerprint (null without words), keys of
    tiny sets, the set's size and its parity bit map."""

    def of(keys: pa.Array, texts: list[str]) -> dict:
        sets = [_shingles(t) for t in texts]
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        return {
            "doc_id": keys, "text_sha256": [sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], "node": signed([_name(s) for s in sets]), "lanes": [wide(s, lanes).view(np.int64) if len(s) else None for s in sets],
            "small": [signed(_least(s)) for s in sets], "size": np.array([len(s) for s in sets], np.int32), "maps": [parity(s) for s in sets],
        }

    return map_texts(docs, of, "doc_id long, text_sha256 string, node long, lanes array<long>, small array<long>, size int, maps array<long>")


def _segment(lane: Column, g: Geometry, at: int | Column) -> Column:
    shifted = F.call_function("shiftrightunsigned", lane, F.lit(at).cast("int") * g.bits)
    return shifted.bitwiseAND(F.lit((1 << g.bits) - 1))


def _carried(g: Geometry) -> list[str]:
    return [*[f"l{k}" for k in range(g.lanes)], "size", *[f"p{k}" for k in range(MAPS)]]


def _side(nodes: DataFrame, g: Geometry, segments: range, name: str, ball: bool) -> DataFrame:
    """(key, <name> columns): the node under some of its segments, or under each value of their balls."""
    values = [F.col(c).alias(f"{name}_{c}") for c in _carried(g)]
    of = F.array(*[_segment(F.col(f"l{k // g.per_lane}"), g, k % g.per_lane).bitwiseOR(F.lit(k << 40)) for k in segments])
    cut = nodes.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"), *values, F.explode(of).alias("key"))
    if not ball:
        return cut
    flips = F.array(*[F.lit(x).cast("long") for x in [0, *(1 << i for i in range(g.bits))]])
    return cut.withColumn("_flip", F.explode(flips)).withColumn("key", F.col("key").bitwiseXOR(F.col("_flip"))).drop("_flip")


def _distance(g: Geometry) -> Column:
    bits = [F.bit_count(F.col(f"a_l{k}").bitwiseXOR(F.col(f"b_l{k}"))) for k in range(g.lanes)]
    return sum(bits[1:], bits[0])


def _may_meet() -> Column:
    """False only for sets that cannot have SIMILARITY: one is too small, or their maps differ in more bits than such sets do in shingles."""
    bits = [F.bit_count(F.col(f"a_p{k}").bitwiseXOR(F.col(f"b_p{k}"))) for k in range(MAPS)]
    room = (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col("a_size") + F.col("b_size")) + 1e-6
    return (F.least("a_size", "b_size") >= SIMILARITY * F.greatest("a_size", "b_size") - 1e-6) & (sum(bits[1:], bits[0]) <= room)


def _once(g: Geometry, number: int) -> Column:
    """True for one of the rows on which a pair meets under a segment's number: if that is the first segment that both balls share,
    the row at ``a``'s own value or, if two bits differ, at ``a``'s with the lower one flipped."""
    apart = [_segment(F.col(f"a_l{k // g.per_lane}").bitwiseXOR(F.col(f"b_l{k // g.per_lane}")), g, k % g.per_lane) for k in range(number + 1)]
    flip = F.col("key").bitwiseAND(F.lit((1 << g.bits) - 1)).bitwiseXOR(_segment(F.col(f"a_l{number // g.per_lane}"), g, number % g.per_lane))
    d = apart[number]
    own = flip == F.when(F.bit_count(d) == 2, d.bitwiseAND(-d)).otherwise(F.lit(0))
    for before in apart[:number]:
        own = own & (F.bit_count(before) > 2)
    return own


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, one row each."""

    def of(keys: pa.Array, texts: list[str]) -> dict:
        sets = [_shingles(t) for t in texts]
        return {"node": np.array([_name(s) for s in sets], np.uint64).view(np.int64), "shingles": [s.view(np.int64) for s in sets]}

    # null doc_ids meet no row in the join
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").union(docs.filter("doc_id IS NULL").select("doc_id", "text"))
    return map_texts(texts, of, "node long, shingles array<long>").dropDuplicates(["node"])


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) whose whole shingle sets have SIMILARITY or more in common.

    A slice of pairs takes PAIRS_A_SET times the room of all sets at most, and the sets that all slices send are
    in proportion to the pairs, whatever their number.
    """
    members = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = checkpointed(_sets(docs, nodes.join(members, "node", "left_semi").select(F.col("first").alias("doc_id"))))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    slices = max(1, -(-pairs.count() // (PAIRS_A_SET * max(1, sets.count()))))
    out = []
    for k in range(slices):
        met = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k).join(side("a"), "a").join(side("b"), "b")
        out.append(checkpointed(met.filter(both >= SIMILARITY * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")))
    discard(sets)
    links = out[0]
    for more in out[1:]:
        links = links.union(more)
    return links


def _rooted(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with the least node of its component of links as ``root``."""
    roots = components(links)
    out = checkpointed(nodes.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    discard(nodes)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, component_id, kept) for every document, linked at SIMILARITY or more of five-word shingle
    sets. Of a component the text with the smallest doc_id, then digest, is kept.

    Defined cases: null is empty; wordless texts are copies of each other; a text under WORDS words has one shingle;
    rows with a null doc_id link like any other and come last; rows that share a doc_id are told apart by their texts,
    rows that share both are all kept or all dropped; an empty table gives an empty result; other columns are ignored.
    The component is named by its smallest doc_id.
    """
    g = geometry(docs.count())
    signed = checkpointed(signatures(docs, g.lanes))
    text = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_sha256")
    one = signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(text).alias("text"), F.first("lanes").alias("lanes"), F.first("small").alias("small"), F.first("size").alias("size"), F.first("maps").alias("maps"))
    named = checkpointed(signed.select("doc_id", "text_sha256", "node"))
    nodes = checkpointed(one.select("node", "first", "text", "small", *[F.get("lanes", F.lit(k)).alias(f"l{k}") for k in range(g.lanes)], "size", *[F.get("maps", F.lit(k)).alias(f"p{k}") for k in range(MAPS)]))
    discard(signed)
    tiny = nodes.select("node", F.explode("small").alias("key"))
    links = tiny.filter("node = key").select(F.col("node").alias("a"), "key").join(tiny.filter("node <> key").select(F.col("node").alias("b"), "key"), "key").select("a", "b")
    near = (_distance(g) <= g.distance) & _may_meet()
    placed = checkpointed(nodes.filter("l0 IS NOT NULL").drop("first", "text", "small").withColumn("root", F.col("node")))
    known, tested, largest, hot = links, None, 0, True
    # a node of each group of equal segments against the others: a row for each at most, however many are alike
    for again in range(ROUNDS):
        side = _side(placed, g, range(g.lanes * g.per_lane), "b", False)
        one = F.struct("b", "b_root", *[f"b_{c}" for c in _carried(g)])
        lead = side.groupBy("key").agg(F.min("b_root").alias("low"), F.max("b_root").alias("high"), F.min_by(one, F.xxhash64("b", F.lit(again))).alias("s")).filter("low <> high")
        # written out: the join then has a plain exchange on either side, so a segment of very many texts can be split
        lead = checkpointed(lead.select("key", F.col("s.b").alias("a"), F.col("s.b_root").alias("a_root"), *[F.col(f"s.b_{c}").alias(f"a_{c}") for c in _carried(g)]))
        met = side.join(lead, "key").filter((F.col("a_root") != F.col("b_root")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        led = checkpointed(met if tested is None else met.join(tested, ["a", "b"], "left_anti"))
        discard(lead)
        tested = led if tested is None else tested.union(led)
        known = checkpointed(known.union(verified(docs, nodes, led)).distinct())
        placed = _rooted(known, placed)
        largest, size = next(iter(placed.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1).collect()), (0, 0))
        hot = HOT * size > placed.count()
        if not hot:
            break
    # then every pair of two roots; one end of a pair lies outside the largest group
    outside = placed.filter(F.col("root") != largest) if hot else placed
    turn = (F.col("a") < F.col("b")) | (F.col("b_root") == largest) if hot else F.col("a") < F.col("b")
    found = []
    # a segment at a time: where there are many shuffle partitions, the rows of a ball lie apart and do not pack
    for n in range(g.lanes * g.per_lane):
        a, b = _side(outside, g, range(n, n + 1), "a", True), _side(placed, g, range(n, n + 1), "b", True)
        found.append(checkpointed(a.join(b, "key").filter((F.col("a_root") != F.col("b_root")) & turn & near & _once(g, n)).select("a", "b")))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    fresh = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(tested, ["a", "b"], "left_anti")
    fresh = checkpointed(fresh)
    links = checkpointed(known.union(verified(docs, nodes, fresh)))
    discard(placed, fresh, *found)
    roots = components(links)
    rooted = checkpointed(nodes.select("node", "text").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    discard(nodes)
    least = checkpointed(rooted.groupBy("root").agg(F.min("text").alias("best")))
    best = checkpointed(rooted.join(least, "root").select("node", "best"))
    discard(rooted, least)
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_sha256") == F.col("best.text_sha256"))
    return named.join(best, "node").select("doc_id", "text_sha256", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))
