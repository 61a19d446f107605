"""Substring dedup with suffix arrays built by two-stage sorting.

Every byte covered by a 100-byte string that also starts earlier is removed. To keep equal strings together
without one array over the whole corpus, each 100-byte window belongs to the least hash among its 32-byte
grams: equal windows have equal owners, and consecutive windows of one owner form a snippet. Owners seen once
cannot hold a repeat and go no further. Equal snippets become one row that remembers its first place, so
copied documents and passages shrink to single rows before they meet; each bucket of owners then gets one
suffix array over its snippets.

The array is sorted in two stages: suffixes smaller than their successor are sorted directly, by the bytes that
matter; all others are induced by scanning the buckets of first bytes in rising order, one vectorised step a
bucket. Adjacent common prefixes of 100 bytes or more then show which windows are the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, pieces, ship, spread, table, whole_text

LENGTH = 100
GRAM = 32
#: Bytes of a text that are hashed at a time.
SEGMENT = 1 << 20
#: Bytes of snippets in a bucket, on average.
BUCKET_BYTES = 2 << 20
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position; each step joins neighbours of half the length."""
    h = raw.astype(np.uint64) + np.uint64(1)
    width = 1
    for factor in _STEPS:
        a = h[:-width] * factor
        a ^= a >> np.uint64(31)
        a += h[width:]
        h, width = a, 2 * width
    h *= _STEPS[0]
    h ^= h >> np.uint64(32)
    return h


def _sliding(h: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        h, done = best(h[:-done], h[done:]), 2 * done
    return best(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


def owners(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one owner: (owner hash, first window, windows, whether its gram repeats nearby)."""
    n = len(raw) - LENGTH + 1
    if n < 1:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e, e, e.astype(bool)
    span = LENGTH - GRAM + 1
    h = gram_hashes(raw)
    least = _sliding(h, span, np.minimum)
    starts = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1])
    hashes = least[starts]
    # grams that own a window, each place once
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    chosen = h[h == _sliding(padded, span, np.maximum)]
    seen, times = np.unique(chosen, return_counts=True)
    again = np.isin(hashes, seen[times > 1])
    return hashes, starts, np.diff(np.append(starts, n)), again


def text_runs(raw: bytes):
    """(owners, first windows, windows, repeats) of a whole text, a segment at a time; a run may be cut in two."""
    whole = np.frombuffer(raw, np.uint8)
    for at in range(0, max(1, len(whole) - LENGTH + 1), SEGMENT):
        hashes, starts, counts, again = owners(whole[at : at + SEGMENT + LENGTH - 1])
        if len(hashes):
            yield hashes, starts + at, counts, again


def _directly_sorted(padded: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the ``depth`` bytes from each: eight bytes at a time, and only what is still tied."""
    words = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    order, tied, group = places.copy(), np.arange(len(places)), np.zeros(len(places), np.int64)
    for k in range(0, depth if len(places) else 0, 8):
        key = words[order[tied] + k].astype(np.uint64)
        by = np.lexsort((key, group)) if k else np.argsort(key, kind="stable")
        order[tied], key, group = order[tied][by], key[by], group[by]
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        group = np.cumsum(new)
        more = ~new | ~np.append(new[1:], True)
        tied, group = tied[more], group[more]
        if not len(tied):
            break
    return order


def other_runs(raw: bytes, owner: int) -> list[tuple[int, int, int]]:
    """(other owner, first window, windows) of a snippet whose windows share the gram of ``owner`` (signed)."""
    h = gram_hashes(np.frombuffer(raw, np.uint8))
    other = (h ^ (h >> np.uint64(29))) * _STEPS[1]
    other[h == np.int64(owner).view(np.uint64)] = ~np.uint64(0)
    least = _sliding(other, LENGTH - GRAM + 1, np.minimum)
    starts = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1])
    return list(zip(least[starts].view(np.int64).tolist(), starts.tolist(), np.diff(np.append(starts, len(least))).tolist()))


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions of ``text`` (bytes, none 0) in the order of their suffixes, exact to ``depth`` bytes or more."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    after = np.append(text[1:], np.uint8(0))
    # a suffix is smaller than its successor if the next different byte rises
    place = np.where(text != after, np.arange(n, dtype=np.int32), np.int32(n))
    turn = np.minimum.accumulate(place[::-1])[::-1]
    small = text[turn] < after[turn]
    del place, turn
    # first stage: direct sorting of the small ones
    direct = _directly_sorted(np.concatenate([text, np.zeros(depth + 8, np.uint8)]), np.nonzero(small)[0], depth)
    # second stage: buckets of first bytes in rising order; in each, induced suffixes come before direct ones
    sizes = np.bincount(text, minlength=257)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.searchsorted(text[direct], np.arange(258))
    out = np.full(n, -1, np.int64)
    heads = begins[:-1].copy()
    for c in range(256):
        ends = begins[c + 1]
        mine = direct[cuts[c] : cuts[c + 1]]
        out[ends - len(mine) : ends] = mine

    def induce(order: np.ndarray, last: bool = False) -> None:
        before = order[order > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        first = text[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        new, at, times = np.unique(first, return_index=True, return_counts=True)
        rank = np.arange(len(first)) - np.repeat(at, times)
        out[heads[first] + rank] = before
        heads[new] += times

    induce(np.array([n]))  # the last suffix follows the empty one
    for c in np.nonzero(sizes)[0].tolist():
        done = begins[c]
        while done < heads[c]:  # runs of one byte induce into their own bucket
            upto = heads[c]
            induce(out[done:upto])
            done = upto
        induce(out[done : begins[c + 1]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Whether each suffix shares ``most`` bytes with the one before it in the order: adjacent common prefixes, cut there."""
    padded = np.concatenate([text, np.zeros(most, np.uint8)])
    alive = np.arange(1, len(order))
    words = np.ndarray((len(text) + most - 7,), dtype="<u8", buffer=padded, strides=(1,))
    offsets = [*range(0, most - 7, 8)] + ([most - 8] if most % 8 else [])
    for k in reversed(offsets):  # far bytes differ first
        alive = alive[words[order[alive] + k] == words[order[alive - 1] + k]]
    same = np.zeros(len(order), bool)
    same[alive] = True
    return same


def repeated_windows(snippets: list[bytes], keys: np.ndarray) -> list[np.ndarray]:
    """For each snippet the window starts whose 100 bytes also start at a lesser key.

    ``keys`` is (doc_id, start) of each snippet as two columns; a window's place is its document and start.
    """
    lens = np.fromiter(map(len, snippets), np.int64, len(snippets))
    begins = np.concatenate([[0], np.cumsum(lens + 1)])
    # bytes of UTF-8 end below 0xF5: one more leaves 0 for the end, and 0xFF parts the snippets
    text = np.frombuffer(b"\xfe".join(snippets) + b"\xfe", np.uint8) + np.uint8(1)
    order = suffix_array(text)
    owner = np.repeat(np.arange(len(snippets)), lens + 1)
    offset = np.arange(len(text)) - begins[owner]
    fits = offset <= lens[owner] - LENGTH
    order = order[fits[order]]  # what is left are windows; equal ones are neighbours still
    same = common_prefixes(text, order)
    group = np.cumsum(~same) if len(order) else np.empty(0, np.int64)
    who, where = owner[order], offset[order]
    doc, at = keys[who, 0], keys[who, 1] + where
    by = np.lexsort((at, doc, group))
    g = group[by]
    first = np.append(True, g[1:] != g[:-1]) if len(g) else np.empty(0, bool)
    lead = by[np.nonzero(first)[0]][np.cumsum(first) - 1] if len(g) else by
    later = (doc[by] != doc[lead]) | (at[by] != at[lead])
    late_who, late_where = who[by][later], where[by][later]
    by = np.lexsort((late_where, late_who))
    late_who, late_where = late_who[by], late_where[by]
    return np.split(late_where, np.searchsorted(late_who, np.arange(1, len(snippets))))


def spans_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [begin, end) covered by LENGTH bytes from each of the rising starts."""
    if not len(starts):
        return []
    gap = np.nonzero(np.diff(starts) > LENGTH)[0]
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + LENGTH).tolist()))


#: Bytes of distinct snippets of one owner above which its windows are dealt out by their other grams.
OWNER_BYTES = 4 << 20
_PLACE = "doc_id long, tid int, start int, windows int"


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text): tid tells rows apart that repeat a doc_id with another text."""
    return docs.select("doc_id", F.xxhash64(whole_text()).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tid"), whole_text().alias("text"))


def _map_runs(texts: DataFrame, schema: str, f) -> DataFrame:
    """``f(doc_id, tid, raw, runs)`` gives a dict of columns for each text with windows."""
    ship(texts.sparkSession)
    out = texts.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def over(batches):
        for batch in batches:
            for piece in pieces(batch, 2):
                parts = []
                for doc, tid, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    for run in text_runs(raw):
                        parts.append(f(doc, tid, raw, run))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[n.name] for p in parts]), type=n.type, from_pandas=False) for n in arrow], schema=arrow)

    return spread(texts).mapInArrow(over, out)


def _owner_rows(doc, tid, raw, run) -> dict:
    hashes, _, _, again = run
    return {"owner": hashes.view(np.int64), "again": again}


def _place_rows(doc, tid, raw, run) -> dict:
    from xxhash import xxh3_64_intdigest as h

    hashes, starts, counts, _ = run
    same = np.array([h(raw[a : a + n + LENGTH - 1]) for a, n in zip(starts.tolist(), counts.tolist())], np.uint64)
    return {"owner": hashes.view(np.int64), "same": same.view(np.int64), "doc_id": np.full(len(starts), doc), "tid": np.full(len(starts), tid, np.int32), "start": starts.astype(np.int32), "windows": counts.astype(np.int32)}


def shared_places(texts: DataFrame) -> DataFrame:
    """(owner, same, doc_id, tid, start, windows) of every snippet whose owner is seen more than once."""
    seen = _map_runs(texts, "owner long, again boolean", _owner_rows)
    hot = seen.groupBy("owner").agg(F.count("*").alias("n"), F.max("again").alias("again")).filter("n > 1 or again").select("owner")
    # written out: the join then has a plain exchange on either side, so an owner of very many places can be split
    hot = checkpointed(hot)
    return _map_runs(texts, f"owner long, same long, {_PLACE}", _place_rows).join(hot, "owner")


def _cut(texts: DataFrame, first: DataFrame, buckets: int) -> DataFrame:
    """(bucket, doc_id, tid, start, snippet, windows): the bytes of first places; those of overfull owners in shorter
    snippets, by the least other hash of the grams that are not the owner's.

    Windows without other grams are one repeated byte, one string a byte. They do not travel: a task sends its first
    place of each byte, and all others as spans (no snippet, ``windows`` long), since they are repeats.
    """
    ship(texts.sparkSession)
    wanted = first.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "windows", "owner", "big")).alias("at"))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
        cols = list(zip(*rows)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "doc_id", "tid", "start", "snippet", "windows"])

    def over(batches):
        first: dict[int, tuple[int, int, int]] = {}  # of each byte
        for batch in batches:
            for piece in pieces(batch, 2):
                rows = []
                for doc, tid, text, at in zip(*(piece.column(i).to_pylist() for i in range(4))):
                    raw = text.encode("utf-8", "surrogatepass")
                    repeat = lambda d, t, at, m: (-1 - d % buckets, d, t, at, None, m)
                    for p in at:
                        a, n = p["start"], p["windows"]
                        if not p["big"]:
                            rows.append((p["owner"] % buckets, doc, tid, a, raw[a : a + n + LENGTH - 1], None))
                            continue
                        for o, i, m in other_runs(raw[a : a + n + LENGTH - 1], p["owner"]):
                            if o != -1:
                                rows.append((o % buckets, doc, tid, a + i, raw[a + i : a + i + m + LENGTH - 1], None))
                                continue
                            if m > 1:
                                rows.append(repeat(doc, tid, a + i + 1, m - 1))
                            here = (doc, tid, a + i)
                            known = first.setdefault(raw[a + i], here)
                            if known != here:
                                first[raw[a + i]] = min(known, here)
                                rows.append(repeat(*max(known, here), 1))
                yield batch_of(rows)
        yield batch_of([(-1 % buckets, *place, bytes([b]) * LENGTH, None) for b, place in first.items()])

    return texts.join(wanted, ["doc_id", "tid"]).select("doc_id", "tid", "text", "at").mapInArrow(over, "bucket int, doc_id long, tid int, start int, snippet binary, windows int")


def _later_spans(t: pa.Table) -> pa.Table:
    """Spans (doc_id, tid, begin, end) of the repeated windows of one bucket's snippets, and those known already."""
    known = t.filter(pc.is_null(t.column("snippet")))
    if known.num_rows:
        begin = known.column("start")
        end = pc.add(begin, pc.add(known.column("windows"), LENGTH - 1)).cast(pa.int32())
        return pa.table({"doc_id": known.column("doc_id"), "tid": known.column("tid"), "begin": begin, "end": end})
    t = t.sort_by([("doc_id", "ascending"), ("tid", "ascending"), ("start", "ascending")])
    docs, tids, starts = (t.column(c).to_numpy() for c in ("doc_id", "tid", "start"))
    out = []
    for doc, tid, start, late in zip(docs.tolist(), tids.tolist(), starts.tolist(), repeated_windows(t.column("snippet").to_pylist(), np.stack([docs, starts.astype(np.int64)], 1))):
        out += [(doc, tid, start + a, start + b) for a, b in spans_of(late)]
    cols = list(zip(*out)) or [[]] * 4
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "tid", "begin", "end"), cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, begin, end) in bytes: spans of repeats, which may overlap; their union is what is removed.

    A snippet's first place is the least (doc_id, start). All other places of the same snippet are repeats as a
    whole; the first places go to the suffix arrays.
    """
    # rows without a doc_id keep all and are nobody's first place
    spark, texts = docs.sparkSession, _texts(docs).filter("doc_id IS NOT NULL")
    places = checkpointed(shared_places(texts))
    first = places.groupBy("owner", "same").agg(F.min(F.struct("doc_id", "tid", "start", "windows")).alias("p")).select("owner", "same", "p.*")
    first = checkpointed(first)
    size = F.col("windows").cast("long") + (LENGTH - 1)
    total = first.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    big = first.groupBy("owner").agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > OWNER_BYTES).select("owner", F.lit(True).alias("big"))
    marked = first.join(big, "owner", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    spans = _cut(texts, marked, buckets).groupBy("bucket").applyInArrow(_later_spans, "doc_id long, tid int, begin int, end int")
    spans = checkpointed(spans)
    head = first.select("owner", "same", *[F.col(c).alias(f"first_{c}") for c in ("doc_id", "tid", "start")])
    later = (F.col("doc_id") != F.col("first_doc_id")) | (F.col("tid") != F.col("first_tid")) | (F.col("start") != F.col("first_start"))
    copies = places.join(head, ["owner", "same"]).filter(later).select("doc_id", "tid", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("end"))
    return copies.union(spans)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of every row.

    Texts are UTF-8 bytes; what is kept may end inside a character. Defined cases: null is empty; a text under
    LENGTH bytes loses nothing; repeated rows are one document seen twice, and both give the same result; rows
    that share a doc_id but not the text are different documents, neither of which starts earlier by doc_id
    alone (the lesser text hash goes first); null doc_ids keep all; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    spans = repeated_spans(docs).groupBy("doc_id", "tid").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = _texts(docs).join(spans, ["doc_id", "tid"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text

    def over(batches):
        for batch in batches:
            for piece in pieces(batch, 1):
                rows = []
                for doc, text, found in zip(*(piece.column(i).to_pylist() for i in range(3))):
                    raw = text.encode("utf-8", "surrogatepass")
                    gone = merged([(s["begin"], s["end"]) for s in found or []])
                    kept = b"".join(raw[a:b] for a, b in zip([0, *[b for _, b in gone]], [*[a for a, _ in gone], len(raw)]))
                    rows.append((doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return joined.mapInArrow(over, schema)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
