"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with its transpose.

Rows of the matrix are the different n-gram sets (classes), columns are n-grams. Columns are ordered by how many documents
hold them, counted over all documents, rare ones first. Two sets that are similar enough have one of their first
``leading`` columns in common, so the product needs these entries only: they are dealt out into blocks of columns,
each block multiplies its part on its own, and the overlap counts of a pair are added up over the blocks. A pair goes
as soon as its sizes, its counts so far, or the parity bit maps of its sets show that it stays below the bound
that follows from the sizes; what is left is compared set by set.

Columns that very many documents hold (HOT) lead only sets that consist of such columns. They are not multiplied out:
their sets meet one leader a column and round, which joins large groups of near copies, and after that only sets of
different components. Equal sets are one class from the start. Every test that discards is exact, so the links between
classes of different components are complete, and so are the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, discard, pieces, ship, spread, table, whole_text, word_spans
from lodestone.llm.components import components

WORDS, PERCENT = 5, 80
#: Bits of an n-gram's hash; those above them hold its frequency class.
BITS = 59
#: Longs of a set's parity bit map, and how many of them travel with an entry of a hot column.
LANES, NEAR_LANES = 16, 16
#: Most columns whose frequency is sent to all executors; the most frequent ones are taken.
HOT_MOST = 1 << 21
#: Documents of a column from which its frequency is kept, as a power of two.
LEAST_CLASS = 4
#: Most classes of a column that a block multiplies out.
COLUMN = 64
#: Entries that a task gathers before it hands them on, and entries of a block.
FLUSH, BLOCK = 1 << 20, 1 << 19
#: Rounds of one leader a hot column.
ROUNDS = 2
#: Bits of the screen that thins the texts before sets are compared.
SCREEN = 1 << 24
#: Bytes of a word from which it is hashed on its own, and bytes that are hashed at a time.
LONG, SLICE = 1 << 12, 1 << 18
#: A-Z become a-z; words are runs of all bytes but these six.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, bool)
IN_WORD[9:14] = IN_WORD[32] = False


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


FACTORS = _mixed(_mixed(np.arange(1, LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: sums of their bytes times a factor a place, mixed with their length."""
    from xxhash import xxh3_64_intdigest as h

    out = np.empty(len(starts), np.uint64)
    ends = np.cumsum(np.minimum(sizes, LONG))
    lo = 0
    while lo < len(starts):  # a bounded number of bytes at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        n = np.minimum(sizes[lo:hi], LONG)
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        values = (data[np.repeat(starts[lo:hi], n) + place].astype(np.uint64) + np.uint64(1)) * FACTORS[place]
        out[lo:hi] = np.add.reduceat(values, first)
        lo = hi
    out = _mixed(out + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in np.nonzero(sizes > LONG)[0].tolist():
        out[i] = h(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return out


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The set of ``words``-word n-grams of each text as sorted hashes of BITS bits; fewer words are one n-gram, none are
    none."""
    data, starts, sizes, owner = word_spans(texts, IN_WORD, LOWER)
    w = word_hashes(data, starts, sizes)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    out = []
    h = np.full(max(0, len(w) - words + 1), words, np.uint64)  # of the words from each place on, whatever text they are of
    for k in range(words):
        h = _mixed(h) * np.uint64(0x9E3779B97F4A7C15) + w[k : len(h) + k]
    h = _mixed(h) >> np.uint64(64 - BITS)
    for at, n in zip(first.tolist(), count.tolist()):
        if n >= words:
            s = np.sort(h[at : at + n - words + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif n:
            short = np.full(1, n, np.uint64)
            for k in range(n):
                short = _mixed(short) * np.uint64(0x9E3779B97F4A7C15) + w[at + k]
            out.append(_mixed(short) >> np.uint64(64 - BITS))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def least_overlap(a: int, b: int, percent: int) -> int:
    """The least intersection of linked sets of these sizes: 100 * both >= percent * either."""
    return -(-percent * (a + b) // (100 + percent))


def leading(n: int, percent: int) -> int:
    """How many first columns of a set of ``n`` hold a column of every linked set: all but its least overlap, and one."""
    return n + percent * n // -100 + 1


def name(shingles: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest as h

    return h(shingles.tobytes())


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """LANES longs; a bit is the parity of the n-grams that fall on it, so two maps differ in no more bits than two sets
    in n-grams."""
    bits = np.bincount((shingles & np.uint64(64 * LANES - 1)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def classes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, node, map) of each document: its set's size, name and bit map; a document without words has no node."""

    def of(keys: pa.Array, sets: list[np.ndarray]) -> dict:
        names = pa.array(_signed([name(s) for s in sets]), mask=np.array([not len(s) for s in sets]))
        maps = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([parity_map(s) for s in sets])), LANES).cast(pa.list_(pa.int64()))
        return {"doc_id": keys, "n": pa.array([len(s) for s in sets], pa.int32()), "node": names, "map": maps}

    return _map_sets(docs, words, of, "doc_id long, n int, node long, map array<long>")


def _map_sets(docs: DataFrame, words: int, f: Callable[[pa.Array, list[np.ndarray]], dict], schema: str) -> DataFrame:
    """Applies ``f(doc_ids, sets)`` to slices of the documents."""
    ship(docs.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                yield pa.RecordBatch.from_pydict(f(piece.column(0), shingle_sets(piece.column(1), words)))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t"))
    return spread(texts).mapInArrow(over, schema)


def _gathered(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[list[np.ndarray]]:
    """Sets of texts, about FLUSH n-grams at a time."""
    held, size = [], 0
    for batch in batches:
        for piece in pieces(batch, 0):
            for s in shingle_sets(piece.column(0), words):
                if len(s):
                    held.append(s)
                    size += len(s)
                if size >= FLUSH:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _lists(columns: dict[str, np.ndarray], cuts: np.ndarray) -> dict[str, pa.Array]:
    """Arrow lists of each column, cut at the same places."""
    offsets = pa.array(cuts.astype(np.int32))
    return {k: pa.ListArray.from_arrays(offsets, pa.array(v)) for k, v in columns.items()}


def _part_batch(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each part of columns that are sorted by it."""
    first = np.nonzero(np.append(True, part[1:] != part[:-1]))[0]
    lists = _lists(columns, np.append(first, len(part)))
    return pa.RecordBatch.from_pydict({"part": pa.array(part[first].astype(np.int32)), **lists})


def _power(n: float) -> int:
    return max(3, int(np.ceil(np.log2(max(n, 1)))))


def frequencies(docs: DataFrame, words: int, total: int) -> DataFrame:
    """(key, level): the columns that at least 2^LEAST_CLASS documents hold, by the first 32 bits of their hash, with the
    binary logarithm of their number. Every n-gram of every document is counted, in blocks of hash ranges."""
    ship(docs.sparkSession)
    bits = _power(total / (4 * BLOCK))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _gathered(batches, words):
            keys, n = np.unique((np.concatenate(sets) >> np.uint64(BITS - 32)).astype(np.uint32), return_counts=True)
            yield _part_batch(keys >> np.uint32(32 - bits), {"keys": keys.view(np.int32), "n": n.astype(np.int32)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (keys, n) in _parts(batches, ("keys", "n")):
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order].astype(np.int64)
            first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
            level = np.frexp(np.add.reduceat(n, first))[1] - 1
            keep = level >= LEAST_CLASS
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[first][keep]), "level": pa.array(level[keep].astype(np.int32))})

    packed = spread(docs.select(whole_text().alias("t"))).mapInArrow(count, "part int, keys array<int>, n array<int>")
    return packed.repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(add, "key int, level int")


def _parts(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of one part after the other, from rows sorted by part."""
    part, held = None, []

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held)]

    for batch in batches:
        lists = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        for i, p in enumerate(batch.column(0).to_pylist()):
            if p != part and held:
                yield part, joined()
                held = []
            part = p
            held.append([x[i].values.to_numpy(zero_copy_only=False) for x in lists])
    if held:
        yield part, joined()


def hot_columns(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, levels, least): the most frequent columns, HOT_MOST at most, levels from 1; the rest have ``least``
    documents or fewer, columns of one frequency being taken or left together."""
    sizes = dict(counted.groupBy("level").count().collect())  # a row a power of two
    least, held = 1 + max(sizes, default=LEAST_CLASS), 0
    while least > LEAST_CLASS and held + sizes.get(least - 1, 0) <= HOT_MOST:
        least -= 1
        held += sizes.get(least, 0)
    hot = counted.filter(F.col("level") >= least).toArrow()
    keys = hot.column("key").to_numpy().astype(np.int32).view(np.uint32)
    order = np.argsort(keys)
    levels = np.minimum(hot.column("level").to_numpy() - least + 1, 2 ** (64 - BITS) - 1)
    return keys[order], levels[order].astype(np.uint8), 1 << least


def ordered(shingles: np.ndarray, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set's columns in the common order: frequency level above, hash below."""
    short = (shingles >> np.uint64(BITS - 32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(keys, short), max(len(keys) - 1, 0))
    level = np.where(keys[at] == short, levels[at], 0) if len(keys) else np.zeros(len(short), np.uint8)
    return np.sort(shingles | level.astype(np.uint64) << np.uint64(BITS))


def products(docs: DataFrame, words: int, percent: int, hot: tuple[np.ndarray, np.ndarray], total: int) -> DataFrame:
    """The blocks' products over leading entries: rows (a, b, na, nb, rest, hits) of pairs with a partial overlap count, and
    rows (a, na, key) of the entries of columns that are too long to multiply out."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(hot)
    bits = _power(total * (100 - percent) / 100 / BLOCK)
    columns = ("keys", "nodes", "sizes", "rests")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = sent.value
        for sets in _gathered(batches, words):
            named = {}
            for s in sets:  # equal sets are one class
                named.setdefault(name(s), s)
            cols, sizes, rests = [], [], []
            for s in named.values():
                n = leading(len(s), percent)
                order = ordered(s, keys, levels)[:n]
                cols.append(order)
                sizes.append(len(s))
                # what may be shared behind the leading columns, or in hot ones
                rests.append(len(s) - n + int((order >> np.uint64(BITS)).astype(bool).sum()))
            each = [len(c) for c in cols]
            col = np.concatenate(cols)
            part = (col & np.uint64((1 << bits) - 1)).astype(np.int64)
            part = np.where(col >> np.uint64(BITS) == 0, part, -1 - part)
            order = np.argsort(part, kind="stable")
            all_ = {"keys": col.view(np.int64), "nodes": np.repeat(_signed(list(named)), each), "sizes": np.repeat(np.array(sizes, np.int32), each), "rests": np.repeat(np.array(rests, np.int32), each)}
            yield _part_batch(part[order], {k: v[order] for k, v in all_.items()})

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("rest", pa.int32()), ("hits", pa.int32()), ("key", pa.int64())])

    def rows(**given) -> pa.RecordBatch:
        n = len(given["a"])
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in out], schema=out)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cold() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    if one.column(0)[0].as_py() >= 0:
                        yield one
                    else:
                        made.append(one)

        made: list[pa.RecordBatch] = []

        def entries() -> Iterator[pa.RecordBatch]:
            while made:
                one = made.pop()
                key, node, size = (one.column(k)[0].values.to_numpy() for k in (1, 2, 3))
                yield rows(a=node, na=size, key=key)

        for _, (key, node, size, rest) in _parts(cold(), columns):
            yield from entries()
            order = np.lexsort((node, key))
            key, node, size, rest = key[order], node[order], size[order], rest[order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node, size, rest = key[fresh], node[fresh], size[fresh], rest[fresh]
            first = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
            length = np.repeat(each := np.diff(np.append(first, len(key))), each)
            long = length > COLUMN
            if long.any():
                yield rows(a=node[long], na=size[long], key=key[long])
            some = (length > 1) & ~long
            key, node, size, rest = key[some], node[some], size[some], rest[some]
            found = []
            for step in range(1, COLUMN):
                i = np.nonzero(key[step:] == key[:-step])[0] if step < len(key) else ()
                if not len(i):
                    break
                j = i + step
                fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]).astype(np.int64)
                found.append((i[fits], j[fits]))
            if not found:
                continue
            i, j = (np.concatenate(x) for x in zip(*found))
            # nodes of a column are in order, so node[i] < node[j]
            order = np.lexsort((node[j], node[i]))
            i, j = i[order], j[order]
            if len(i):
                first = np.nonzero(np.append(True, (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1])))[0]
                hits = np.diff(np.append(first, len(i))).astype(np.int32)
                i, j = i[first], j[first]
                yield rows(a=node[i], b=node[j], na=size[i], nb=size[j], rest=np.maximum(rest[i], rest[j]), hits=hits)
        yield from entries()

    packed = spread(docs.select(whole_text().alias("t"))).mapInArrow(deal, "part int, keys array<long>, nodes array<long>, sizes array<int>, rests array<int>")
    return packed.repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(multiply, "a long, b long, na int, nb int, rest int, hits int, key long")


def _needed(a: str, b: str, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (F.col(a).cast("long") + F.col(b)) / F.lit(100 + percent))


def _fits(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(F.col(a).cast("long"), F.col(b)) >= percent * F.greatest(F.col(a).cast("long"), F.col(b))


def _alike(a: str, b: str, lanes: int, percent: int) -> Column:
    """Whether the first lanes of two bit maps allow enough common n-grams: each bit apart is an n-gram apart."""
    apart = sum((F.bit_count(F.col(f"{a}_m{k}").bitwiseXOR(F.col(f"{b}_m{k}"))) for k in range(lanes)), F.lit(0))
    return apart <= F.col(f"{a}_n").cast("long") + F.col(f"{b}_n") - 2 * _needed(f"{a}_n", f"{b}_n", percent)


def _side(nodes: DataFrame, name: str, lanes: int) -> DataFrame:
    return nodes.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), *[F.col(f"m{k}").alias(f"{name}_m{k}") for k in range(lanes)])


def _screen(wanted: DataFrame) -> np.ndarray:
    """A bit for each hash of the wanted doc_ids: SCREEN bits, however many they are."""
    place = F.pmod(F.xxhash64(F.col("first").cast("long")), F.lit(SCREEN))
    words = wanted.groupBy((place / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(SCREEN // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that are linked, written out: whole bit maps first, then whole sets.

    Texts of wanted sets are read again; a screen of bounded size over their doc_ids drops most others before they are
    cut into n-grams, and the exact join by set follows.
    """
    spark = docs.sparkSession
    met = pairs.select("a", "b").join(_side(nodes, "a", LANES), "a").join(_side(nodes, "b", LANES), "b")
    close = checkpointed(met.filter(_alike("a", "b", LANES, percent)).select("a", "b", "a_n", "b_n"))
    members = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    wanted = checkpointed(nodes.join(members, "node", "left_semi").select("node", "first"))
    screen = spark.sparkContext.broadcast(_screen(wanted))

    held = _wanted_sets(docs, screen, words)
    sets = checkpointed(held.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    out = checkpointed(close.join(side("a"), "a").join(side("b"), "b").filter(both >= _needed("a_n", "b_n", percent)).select("a", "b"))
    discard(close, wanted, sets)
    return out


def _wanted_sets(docs: DataFrame, screen, words: int) -> DataFrame:
    """(node, shingles) of the rows whose doc_id is in the screen, or null."""
    ship(docs.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = screen.value
        for batch in batches:
            place = batch.column(1).to_numpy(zero_copy_only=False)
            hit = (bits[place // 64] >> (place % 64)) & 1 == 1
            for piece in pieces(batch.filter(pa.array(hit | batch.column(0).is_null().to_numpy(zero_copy_only=False))), 2):
                sets = shingle_sets(piece.column(2), words)
                each = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(each, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_pydict({"node": pa.array(_signed([name(s) for s in sets])), "shingles": lists})

    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SCREEN))
    return docs.select("doc_id", place.alias("place"), whole_text().alias("t")).mapInArrow(over, "node long, shingles array<long>")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links)
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def hot_links(docs: DataFrame, nodes: DataFrame, entries: DataFrame, links: DataFrame, words: int, percent: int) -> DataFrame:
    """``links`` with those of hot columns: each class against one leader, in ROUNDS, then all pairs of different components
    that the first NEAR_LANES of their bit maps allow. Of a column's largest component only pairs with others are made."""
    near = (F.col("a_root") != F.col("b_root")) & _fits("a_n", "b_n", percent) & _alike("a", "b", NEAR_LANES, percent)
    fields = ["node", "root", "n", *[f"m{k}" for k in range(NEAR_LANES)]]
    tested = entries.sparkSession.createDataFrame([], "a long, b long")
    share = entries.groupBy("node").agg(F.count("*").alias("hot"))  # what others changed least is hot in most columns
    nodes = checkpointed(nodes.join(share, "node"))

    def named(c: str, at) -> list[Column]:
        return [at("node").alias(c), *[at(f).alias(f"{c}_{f}") for f in fields[1:]]]

    def placed() -> DataFrame:
        rooted = checkpointed(_rooted(nodes, links).select(*fields, (F.col("hot") / F.col("n")).alias("central")))
        side = checkpointed(entries.join(rooted, "node"))
        discard(rooted)
        return side

    def fresh(met: DataFrame) -> DataFrame:
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return checkpointed(pairs.join(tested, ["a", "b"], "left_anti"))

    # what a column tells of its rows is written out: the joins then have plain exchanges on either side and can be split
    for again in range(ROUNDS):
        side = placed()
        chance = F.xxhash64("node", F.lit(again))
        first = F.struct(*([-F.col("central"), chance] if not again else [chance]))
        lead = side.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct(*fields), first).alias("s"))
        lead = checkpointed(lead.filter("low <> high").select("key", *named("a", lambda f: F.col(f"s.{f}"))))
        met = side.select("key", *named("b", F.col)).join(lead, "key").filter(near).groupBy("a", "b").agg(F.count("*").alias("c"))
        # of the leaders that a class meets, the one that it meets most often
        met = fresh(met.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")))
        discard(side, lead)
        if met.isEmpty():
            discard(met)
            break
        tested = tested.union(met)
        links = links.union(verified(docs, nodes, met, words, percent))
    side = placed()
    roots = side.groupBy("key", "root").agg(F.countDistinct("node").alias("c"))
    most = roots.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("largest"))
    most = checkpointed(most.filter("roots > 1").drop("roots"))
    outside = checkpointed(side.join(most, "key").filter("root <> largest").select("key", "largest", *named("a", F.col)))
    turn = (F.col("a") < F.col("b")) | (F.col("b_root") == F.col("largest"))
    met = fresh(outside.join(side.select("key", *named("b", F.col)), "key").filter(turn & near))
    discard(side, most, outside)
    links = links.union(verified(docs, nodes, met, words, percent))
    discard(nodes)
    return links


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; two are linked if their n-gram sets have a Jaccard similarity
    of at least ``percent`` hundredths, and a component has the name of its smallest doc_id.

    Defined cases: null is empty; a text without words has an empty set, is linked with nothing and bears its own doc_id;
    fewer words than ``words`` are one n-gram; texts of equal sets are one class, whatever their number; rows with a null
    doc_id link like any other and take the component's smallest doc_id that is not null; very long texts are cut whole; an
    empty table gives an empty result; other columns are ignored. Sets are told apart by 64-bit names.
    """
    signed = checkpointed(classes(docs, words))
    total = signed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    maps = [F.get(F.first("map"), F.lit(k)).alias(f"m{k}") for k in range(LANES)]
    nodes = checkpointed(signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), *maps))
    rows = checkpointed(signed.select("doc_id", "n", "node"))
    discard(signed)
    counted = checkpointed(frequencies(docs, words, total))
    keys, levels, least = hot_columns(counted)
    discard(counted)
    made = checkpointed(products(docs, words, percent, (keys, levels), total))
    added = made.filter("key IS NULL").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("rest").alias("rest"), F.sum("hits").alias("hits"))
    if least <= COLUMN:  # then blocks multiply out all columns that are not hot, and the counts are whole
        added = added.filter(F.col("hits") + F.col("rest") >= _needed("na", "nb", percent))
    links = verified(docs, nodes, added, words, percent)
    entries = checkpointed(made.filter("key IS NOT NULL").select("key", F.col("a").alias("node")).distinct())
    discard(made)
    links = hot_links(docs, nodes, entries, links, words, percent)
    rooted = checkpointed(_rooted(nodes.select("node", "first"), links))
    discard(nodes, entries)
    # written out, so that the joins below have plain exchanges on either side and large components can be split
    best = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = checkpointed(rooted.join(best, "root").select("node", "component_id"))
    discard(rooted, best)
    alone = rows.filter("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter("node IS NOT NULL").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def op12_jaccard_join(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")
