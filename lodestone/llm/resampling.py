"""Importance resampling towards a target distribution: hashed n-gram gains, Gumbel scores, and a merged top draw.

Two passes over the texts count n-grams by bucket and add up the gains of each document's n-grams, both as arrays over
all words of a slice of texts at once. The draw takes the best scores: every partition writes its eligible documents as
sorted runs, cut where the score ranges end; a range is merged by a tournament tree that holds one block of each run,
since blocks arrive in the order of their first rows. Ranges know their first rank from the sizes of those before
them, so they are merged in parallel, and merging stops after the exact draw count: what lies behind it is passed on
unmerged.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, pieces, ship, spread, table, whole_text, word_spans

GRAMS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Words that are hashed at a time, and the length from which a word is hashed on its own.
SLICE, LONG = 1 << 20, 64
#: Rows of a sorted run and of a block; rows of a range of scores; ranges at most, and sampled rows for each.
RUN, BLOCK, RANGE, RANGES, SAMPLE = 1 << 20, 4096, 1 << 16, 4096, 32
#: Bytes that stand in words, after A-Z became a-z: all but these ranges of ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, bool)
IN_WORD[0x00:0x30] = IN_WORD[0x3A:0x61] = IN_WORD[0x7B:0x80] = False


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each span of the bytes, one byte of all spans at a time."""
    out = np.empty(len(starts), np.uint32)
    for lo in range(0, len(starts), SLICE):
        at, n = starts[lo : lo + SLICE], sizes[lo : lo + SLICE]
        c = np.full(len(at), 0xFFFFFFFF, np.uint32)
        live = np.arange(len(at))
        for k in range(LONG):
            live = live[n[live] > k]
            if not len(live):
                break
            now = c[live]
            c[live] = CRC[(now ^ data[at[live] + k]) & 0xFF] ^ (now >> 8)
        c = ~c
        for i in live[n[live] > LONG].tolist() if len(live) else ():
            c[i] = zlib.crc32(data[at[i] : at[i] + n[i]])
        out[lo : lo + SLICE] = c
    return out


def gram_buckets(texts: pa.Array, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, n-grams of each text, words of each text); n-grams of a text stand together, shorter first."""
    data, starts, sizes, owner = word_spans(texts, IN_WORD, LOWER)
    words = np.bincount(owner, minlength=len(texts))
    found = [crc32s(data, starts, sizes) % np.uint32(buckets)]
    owners = [owner]
    if grams > 1:  # words of a text one space apart, so that each n-gram is a span
        joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = data[np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)]
        starts = np.cumsum(sizes + 1) - sizes - 1
        for n in range(2, grams + 1):
            at = np.nonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])[0] if len(owner) >= n else np.empty(0, int)
            found.append(crc32s(joined, starts[at], starts[at + n - 1] + sizes[at + n - 1] - starts[at]) % np.uint32(buckets))
            owners.append(owner[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable") if grams > 1 else slice(None)
    return np.concatenate(found).astype(np.int64)[order], np.bincount(owner, minlength=len(texts)), words


def bucket_counts(texts: DataFrame, grams: int, buckets: int) -> np.ndarray:
    """N-grams of all texts by bucket: each task counts what it reads, so ``buckets`` rows a task are added up."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch, 0):
                held += np.bincount(gram_buckets(piece.column(0), grams, buckets)[0], minlength=buckets)
        some = np.nonzero(held)[0]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), "n": pa.array(held[some])})

    counted = spread(texts.select(whole_text().alias("t"))).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    k = len(source)
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """The thousandths of a Gumbel variate that the seed and a doc_id give."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, grams: int, seed: int) -> DataFrame:
    """(doc_id, n_features, weight, score, words) of each document."""
    ship(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                found, each, words = gram_buckets(piece.column(1), grams, len(gain))
                ends = np.cumsum(each)
                total = np.append(0, np.cumsum(gain[found]))
                weight = total[ends] - total[ends - each]
                noise = np.array([gumbel(d, seed) for d in piece.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column(0), "n_features": pa.array(each.astype(np.int64)), "weight": pa.array(weight), "score": pa.array(weight + noise), "words": pa.array(words.astype(np.int64))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t"))
    return spread(texts).mapInArrow(score, "doc_id long, n_features long, weight long, score long, words long")


class Tournament:
    """A tree of matches over players that each have a next key; the least one wins. Players may join at any time."""

    def __init__(self) -> None:
        self.players: list[Iterator] = []
        self.keys: list[tuple | None] = []
        self.free: list[int] = []
        self.wins: list[int] = []
        self.size = 0

    def _better(self, a: int, b: int) -> int:
        x, y = self.keys[a], self.keys[b]
        return a if y is None or (x is not None and x < y) else b

    def _replay(self, leaf: int) -> None:
        at = (leaf + self.size) >> 1
        while at:
            self.wins[at] = self._better(self.wins[2 * at], self.wins[2 * at + 1])
            at >>= 1

    def join(self, player: Iterator) -> None:
        if not self.free:
            more = max(1, self.size)
            self.free = list(range(self.size, self.size + more))
            self.keys += [None] * more
            self.players += [iter(())] * more
            self.size += more
            self.wins = [0] * self.size + list(range(self.size))
            for at in range(self.size - 1, 0, -1):
                self.wins[at] = self._better(self.wins[2 * at], self.wins[2 * at + 1])
        leaf = self.free.pop()
        self.players[leaf] = player
        self._next(leaf)

    def _next(self, leaf: int) -> None:
        self.keys[leaf] = next(self.players[leaf], None)
        if self.keys[leaf] is None:
            self.free.append(leaf)
        self._replay(leaf)

    def best(self) -> tuple | None:
        return self.keys[self.wins[1 if self.size > 1 else 0]] if self.size else None

    def pop(self) -> tuple | None:
        best = self.best()
        if best is not None:
            self._next(self.wins[1 if self.size > 1 else 0])
        return best

    def rest(self) -> Iterator[tuple]:
        """What is left of all players, in no common order."""
        for key, player in zip(self.keys, self.players):
            if key is not None:
                yield key
                yield from player


_KEY = ("score", "doc_id", "salt")


def _key(score: int, doc_id: int | None, salt: int) -> tuple:
    return (-score, doc_id is None, doc_id or 0, salt)


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("rank", pa.int64())])


def _runs(eligible: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Sorted runs in blocks of one range each: (range, size, the first row's key, the rows' columns as arrays)."""
    columns = ("score", "doc_id", "salt", "weight", "n_features")
    schema = "range int, size int, score long, doc_id long, salt long, " + ", ".join(f"{c}s array<long>" for c in columns)

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        order = pc.sort_indices(t, sort_keys=[("score", "descending"), ("doc_id", "ascending"), ("salt", "ascending")], null_placement="at_end")
        t = t.take(order).combine_chunks()
        score, doc_id, salt = (t.column(c).chunk(0) for c in _KEY)
        key = lambda i: _key(score[i].as_py(), doc_id[i].as_py(), salt[i].as_py())
        ends = [0, *(bisect_left(range(t.num_rows), b, key=key) for b in bounds), t.num_rows]
        blocks = [(r, lo, min(lo + BLOCK, hi)) for r, (a, hi) in enumerate(zip(ends, ends[1:])) for lo in range(a, hi, BLOCK)]
        first = pa.array([lo for _, lo, _ in blocks])
        cuts = pa.array([lo for _, lo, _ in blocks] + [t.num_rows], pa.int32())
        out = {"range": pa.array([r for r, _, _ in blocks], pa.int32()), "size": pa.array([hi - lo for _, lo, hi in blocks], pa.int32())}
        out |= {c: t.column(c).chunk(0).take(first) for c in _KEY} | {f"{c}s": pa.ListArray.from_arrays(cuts, t.column(c).chunk(0)) for c in columns}
        yield pa.RecordBatch.from_pydict(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= RUN:
                yield from run(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from run(pa.Table.from_batches(held))

    return eligible.select(*columns).mapInArrow(cut, schema)


def _merged(blocks: DataFrame, ranks: dict[int, int], draws: int) -> DataFrame:
    """Rows with their ranks, from blocks that are sorted by range and first key; ``ranks`` has the rows before a range."""

    def rows(block: pa.RecordBatch, i: int) -> Iterator[tuple]:
        each = [block.column(block.schema.get_field_index(f"{c}s"))[i].values.to_pylist() for c in ("score", "doc_id", "salt", "weight", "n_features")]
        return ((*_key(s, d, x), w, n) for s, d, x, w, n in zip(*each))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                r, _, s, d, x = (batch.column(k)[i].as_py() for k in range(5))
                yield r, _key(s, d, x), rows(batch, i)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        blocks = listed(batches)
        block = next(blocks, None)
        while block:
            here, tree, rank = block[0], Tournament(), ranks[block[0]]
            while rank < draws:
                # a block is opened once a row of it may come next, so each run has one open at most
                while block and block[0] == here and ((best := tree.best()) is None or block[1] < best[:4]):
                    tree.join(block[2])
                    block = next(blocks, None)
                row = tree.pop()
                if row is None:
                    break
                rank += 1
                yield row, rank
            yield from ((row, None) for row in tree.rest())
            while block and block[0] == here:
                yield from ((row, None) for row in block[2])
                block = next(blocks, None)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        cols = zip(*((None if row[1] else row[2], row[5], row[4], -row[0], rank) for row, rank in held))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_ROWS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for item in ranked(batches):
            held.append(item)
            if len(held) >= 2 * BLOCK:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return blocks.mapInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long")


def draw(rows: DataFrame, least_words: int, percent: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of scored rows that are written out: the best ``percent`` hundredths of those
    with enough words are ranked by score, then doc_id."""
    spark = rows.sparkSession
    ship(spark)
    rows = checkpointed(rows.withColumn("salt", F.monotonically_increasing_id()))  # tells equal rows apart
    eligible = rows.filter(F.col("words") >= least_words)
    total = eligible.count()
    draws = percent * total // 100
    ranges = min(RANGES, -(-total // RANGE))
    bounds = []
    if ranges > 1:  # a sample sets where ranges end; their sizes are counted
        sampled = sorted(_key(*r) for r in eligible.select(*_KEY).sample(min(1.0, SAMPLE * ranges / total), 7).collect())
        bounds = sorted({sampled[i * len(sampled) // ranges] for i in range(1, ranges)}) if sampled else []
    blocks = checkpointed(_runs(eligible, bounds))
    sizes = dict(blocks.groupBy("range").agg(F.sum("size")).collect())  # RANGES rows at most
    ranks, before = {}, 0
    for r in sorted(sizes):
        ranks[r] = before
        before += sizes[r]
    reached = [r for r in ranks if ranks[r] < draws]
    last = max(reached, default=-1)
    needed = blocks.filter(F.col("range") <= last).repartition(max(1, len(reached)), "range").sortWithinPartitions("range", F.desc("score"), F.asc_nulls_last("doc_id"), "salt")
    behind = blocks.filter(F.col("range") > last).select(F.inline(F.arrays_zip("doc_ids", "n_featuress", "weights", "scores")))
    behind = behind.toDF("doc_id", "n_features", "weight", "score")
    short = rows.filter(F.col("words") < least_words).select("doc_id", "n_features", "weight", "score")
    return _merged(needed, ranks, draws).union(behind.union(short).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ranks of the drawn ones, null for the rest.

    Defined cases: null is empty; a text without words has no n-grams, a weight of 0 and no rank; ties go to the
    smaller doc_id; repeated rows are drawn one by one; a null doc_id draws its noise from the seed alone and comes last
    among ties; an empty target or corpus counts as zero n-grams; very long texts are counted whole; an empty table
    gives an empty result; other columns are ignored.
    """
    source, wanted = bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets)
    return draw(scored(docs, gains(source, wanted), grams, seed), least_words, percent)


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
