"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a mask of five of up to nine neighbouring words; what it skips may differ. Each mask's hash is taken at
every word of every text and of every benchmark item; equal hashes put the two texts on a diagonal (text
position minus item position), along which whole items are compared word by word. The longest run with at least
four equal words in five is taken.

Items too short for that (under MIN_WORDS words) are found where they stand word for word.

Positions are unfolded inside one generated stage that reads the texts once. While the benchmark's seeds and words
stay under BROADCAST_BYTES (their number is checked) both are broadcast, each once; beyond it they meet the texts in
shuffle joins. Only texts with hits are read again and compared, once for each diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, table, whole_text

#: Word offsets of each mask. None covers all residues modulo 5, so one substitution in five never hides a copy.
MASKS = ((0, 1, 2, 3, 6), (0, 1, 3, 5, 8), (0, 2, 3, 5, 7))
SPAN = 1 + max(map(max, MASKS))
#: Least words of a reported overlap, and least share of equal words.
MIN_WORDS, SIMILARITY = 10, 0.8
#: Bytes of seeds (SEED_BYTES each) and item words (8 each) up to which they are broadcast.
BROADCAST_BYTES, SEED_BYTES = 48 << 20, 48


def words(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits of a text."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    found = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))
    return F.transform(found, lambda w: F.xxhash64(w))


def _unfolded(df: DataFrame, *keep: str) -> DataFrame:
    """One row per position and mask of ``h``, with the seed's hash; ``h`` itself is only read, not copied."""
    # outer: an inner explode would infer a filter on the array and hash all words twice
    starts = F.when(F.size("h") >= SPAN, F.sequence(F.lit(0), F.size("h") - SPAN))
    at = df.select(*keep, "h", F.explode_outer(starts).alias("at")).filter(F.col("at").isNotNull())
    seed = lambda n, mask: F.xxhash64(F.lit(n), *[F.get("h", F.col("at") + k) for k in mask])
    return at.select(*keep, "h", "at", F.explode(F.array(*[seed(n, m) for n, m in enumerate(MASKS)])).alias("seed"))


def _compared(h: Column, item: Column, diagonal: Column, skipped: Column) -> Column:
    """Whether each word of the item, from the first that lies inside the text, equals the text's word on the diagonal."""
    inside = F.slice(item, skipped + 1, F.greatest(F.least(F.size(item), F.size(h) - diagonal) - skipped, F.lit(0)))
    return F.transform(inside, lambda w, q: F.coalesce(F.get(h, q + skipped + diagonal) == w, F.lit(False)))


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _scan(values: Column, pick) -> Column:
    """Running ``pick`` (least or greatest) of an array."""
    return F.aggregate(values, F.array().cast("array<int>"), lambda s, v: F.concat(s, F.array(pick(F.get(s, F.size(s) - 1), v))))


def _longest(equal: Column) -> Column:
    """The longest run with at least SIMILARITY equal words that begins and ends with one, as struct(first, n_words, n_equal).

    With +1 for an equal word and -4 for another it is the widest pair of a prefix sum and one not below it: the
    least sum up to each start and the greatest from each end on fall, so two pointers meet all widest pairs.
    """
    sums = F.aggregate(equal, F.array(F.lit(0)), lambda s, e: F.concat(s, F.array(F.get(s, F.size(s) - 1) + F.when(e, 1).otherwise(-4))))

    def bounds(p: Column) -> Column:
        starts = F.transform(equal, lambda e, i: F.when(e, F.get(p, i)).otherwise(1 << 30))
        ends = F.transform(equal, lambda e, i: F.when(e, F.get(p, i + 1)).otherwise(-(1 << 30)))
        return F.struct(_scan(starts, F.least).alias("low"), F.reverse(_scan(F.reverse(ends), F.greatest)).alias("high"))

    def widest(b: Column) -> Column:
        zero = F.struct(*[F.lit(0).alias(c) for c in ("i", "j", "first", "n_words")])

        def step(s: Column, _: Column) -> Column:
            fits = F.coalesce(F.get(b["low"], s["i"]) <= F.get(b["high"], s["j"]), F.lit(False))
            wider = fits & (s["j"] - s["i"] + 1 > s["n_words"])
            return F.struct(
                F.when(fits, s["i"]).otherwise(s["i"] + 1).alias("i"), F.when(fits, s["j"] + 1).otherwise(s["j"]).alias("j"),
                F.when(wider, s["i"]).otherwise(s["first"]).alias("first"), F.when(wider, s["j"] - s["i"] + 1).otherwise(s["n_words"]).alias("n_words"),
            )

        return F.aggregate(F.concat(equal, equal), zero, step)

    counted = lambda r: F.size(F.filter(F.slice(equal, r["first"] + 1, r["n_words"]), lambda e: e))
    return _let(_let(_let(sums, bounds), widest), lambda r: F.struct(r["first"].alias("first"), r["n_words"].alias("n_words"), counted(r).alias("n_equal")))


def _overlap(equal: Column, skipped: Column, n: Column) -> Column:
    """The best run as struct(first, n_words, n_equal): the item of ``n`` words as a whole if enough of it is in place,
    else the longest run with enough equal words."""
    hits = F.size(F.filter(equal, lambda e: e))
    whole = F.struct(F.lit(0).alias("first"), n.alias("n_words"), hits.alias("n_equal"))
    moved = _let(_longest(equal), lambda r: F.struct((r["first"] + skipped).alias("first"), r["n_words"].alias("n_words"), r["n_equal"].alias("n_equal")))
    # fewer equal words than this are no overlap wherever they stand
    return F.when(hits >= SIMILARITY * n, whole).when(hits >= SIMILARITY * MIN_WORDS, moved)


def _short_overlaps(texts: DataFrame, short: DataFrame, small: bool) -> DataFrame:
    """(doc_id, item_id, doc_word, n_words, n_equal) of items of under MIN_WORDS words, at their first place in a text."""
    lengths = sorted(r[0] for r in short.select(F.size("h")).distinct().collect())  # MIN_WORDS - 1 at most
    seed = lambda at, n: F.xxhash64(F.lit(n), *[F.get("h", at + k) for k in range(n)])
    at = texts.select("doc_id", "h", F.explode_outer(F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1))).alias("at")).filter(F.col("at").isNotNull())
    cuts = F.array(*[F.struct(F.lit(n).alias("n"), seed(F.col("at"), n).alias("seed")) for n in lengths])
    cut = at.select("doc_id", "h", "at", F.explode(cuts).alias("s")).select("doc_id", "h", "at", "s.n", "s.seed")
    items = short.select("item_id", F.col("h").alias("item"), F.size("h").alias("k")).withColumn("seed", F.coalesce(*[F.when(F.col("k") == n, F.xxhash64(F.lit(n), *[F.get("item", F.lit(i)) for i in range(n)])) for n in lengths]))
    met = cut.join(F.broadcast(items) if small else items, "seed").filter(F.slice("h", F.col("at") + 1, F.col("n")) == F.col("item"))
    return met.groupBy("doc_id", "item_id").agg(F.min("at").alias("doc_word"), F.first("n").alias("n_words"), F.first("n").alias("n_equal"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, n_words, n_equal): the best verified overlap of each text with each item.

    Overlaps have MIN_WORDS words or more, at least SIMILARITY of them equal; parts of an item begin and end with an
    equal word. Items of fewer words overlap as a whole, word for word. Of several overlaps of a text with an item the
    one with the most equal words is returned, then the shorter, then the earlier. Defined cases: null and empty texts
    and items have no words and no overlaps; very long texts and items are compared whole; rows that repeat a doc_id
    or item_id are texts of their own, and the best of them is returned; nulls among either are one id; empty tables give no rows; other columns are
    ignored.
    """
    numbered = benchmark.select("item_id", words(whole_text()).alias("h"), F.monotonically_increasing_id().alias("item_no"))
    items = checkpointed(numbered.filter(F.size("h") > 0))
    seeds = _unfolded(items, "item_no").select("item_no", F.col("at").alias("item_at"), "seed")
    n_seeds = F.greatest(F.size("h") - SPAN + 1, F.lit(0)) * len(MASKS)
    small = (items.agg(F.sum((n_seeds * SEED_BYTES + F.size("h") * 8).cast("long"))).first()[0] or 0) <= BROADCAST_BYTES
    texts = docs.select("doc_id", words(whole_text()).alias("h"))
    compared = items.withColumnRenamed("h", "item")
    diagonal = F.col("at") - F.col("item_at")
    once = lambda c: F.explode(F.array(c))  # noqa: E731  filters on the fields do not copy the expression below it
    hits = _unfolded(texts, "doc_id").select("doc_id", "at", "seed").join(F.broadcast(seeds) if small else seeds, "seed")
    # all hits on a diagonal ask for the same comparison
    pairs = checkpointed(hits.select(F.col("doc_id").alias("_doc"), "item_no", diagonal.alias("diagonal")).distinct())
    # they grow with the texts: joined by a shuffle whatever their number, so all sizes have one plan
    asked = docs.select("doc_id", "text").join(pairs.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")))
    met = asked.select("doc_id", "item_no", "diagonal", once(words(whole_text())).alias("h"))
    met = met.join(F.broadcast(compared) if small else compared, "item_no").withColumn("skipped", F.greatest(-F.col("diagonal"), F.lit(0)))
    lines = met.select("doc_id", "item_id", "diagonal", "skipped", F.size("item").alias("n"), once(_compared(F.col("h"), F.col("item"), F.col("diagonal"), F.col("skipped"))).alias("equal"))
    found = lines.select("doc_id", "item_id", "diagonal", once(_overlap(F.col("equal"), F.col("skipped"), F.col("n"))).alias("o"))
    good = found.filter((F.col("o.n_words") >= MIN_WORDS) & (F.col("o.n_equal") >= SIMILARITY * F.col("o.n_words")))
    rank = F.struct("o.n_equal", -F.col("o.n_words"), -(F.col("diagonal") + F.col("o.first")))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct(rank.alias("r"), (F.col("diagonal") + F.col("o.first")).alias("doc_word"), F.col("o.n_words").alias("n_words"), F.col("o.n_equal").alias("n_equal"))).alias("b"))
    best = best.select("doc_id", "item_id", "b.doc_word", "b.n_words", "b.n_equal")
    short = items.filter(F.size("h") < MIN_WORDS)
    return best if short.isEmpty() else best.union(_short_overlaps(texts, short, small))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose texts overlap no benchmark item, whatever their doc_ids are."""
    digest = F.sha2(whole_text(), 256)
    tainted = checkpointed(overlaps(docs.select(digest.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("digest")).distinct())
    tainted = tainted.hint("merge")  # grows with the texts
    return docs.join(tainted, digest == tainted["digest"], "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
