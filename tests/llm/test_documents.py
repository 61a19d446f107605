"""Each document operator against brute force, with nulls, empty and long texts, ties, repeated rows and no rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, decontaminate, exact_dedup, passages, quality, sharding, simhash, suffix_dedup, toxicity
from lodestone.llm.components import components

RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "É É"), (905, "x" * 30000), (906, "ab " * 4000)]


def groups(rng, n=40):
    base = [prose(rng, rng.randint(30, 160)) for _ in range(n)]
    return [(i, rng.choice(base)) for i in range(2 * n)]


# exact duplicates


def test_exact_duplicates(frame):
    rows = groups(random.Random(1)) + ODD + [(950, None), (951, ""), (903, "one")]
    docs = frame(rows)
    for old in (F.col("doc_id") < 40, F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0):
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs, old, 20).collect())
        by = {}
        for i, t in rows:
            by.setdefault(t or "", []).append(i)
        assert got == Counter((i, max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert exact_dedup.exact_duplicates(frame([]), F.lit(True)).count() == 0


def test_snapshot_stays_as_written(spark, tmp_path):
    old = spark.range(500).select(F.col("id").alias("doc_id"), F.sha2((F.col("id") % 300).cast("string"), 256).alias("digest"))
    exact_dedup.save_snapshot(old, f"{tmp_path}/s", 50)
    snapshot = exact_dedup.load_snapshot(spark, f"{tmp_path}/s")
    assert (snapshot.buckets, snapshot.filters.count(), snapshot.classes.count()) == (6, 6, 300)
    batch = spark.range(200, 5000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    got = exact_dedup.screen(exact_dedup.classes(batch), snapshot).collect()
    assert len(got) == 4800 and all(r.positive for r in got if r.keep < 300) and sum(r.positive for r in got) < 200
    plan = exact_dedup.screen(exact_dedup.classes(batch), snapshot)._jdf.queryExecution().toString()
    assert "Join" not in plan
    with pytest.raises(Exception):
        exact_dedup.save_snapshot(old, f"{tmp_path}/s", 50)


def test_bytes_are_compared(spark):
    rows = spark.createDataFrame([(1, "d", "x"), (2, "d", "x"), (3, "d", "y"), (None, "e", "z"), (None, "e", "w")], "doc_id long, digest string, text string")
    wanted = spark.createDataFrame([("d", 2), ("e", None)], "digest string, keep long")
    got = {(r.doc_id, r.digest) for r in exact_dedup.differing(rows, wanted).collect()}
    assert got == {(3, "d"), (None, "e")}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 20000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    f = exact_dedup.FuseFilter.unpack(exact_dedup.FuseFilter(np.concatenate([keys, keys])).pack())
    assert f.may_hold(keys).all()
    if n > 1000:
        assert len(f.cells) < 1.4 * n
        assert f.may_hold(np.random.default_rng(1 + n).integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.01


# near duplicates


def near_rows(rng):
    rows = groups(rng)
    for i, (_, t) in enumerate(rows[:30]):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    return rows + ODD + [(903, "one")]


@pytest.mark.parametrize("words", [4, 5])
def test_simhash(frame, words):
    rows = near_rows(random.Random(2))
    got = simhash.near_duplicates(frame(rows), words).collect()
    fps = [simhash.majority(simhash.shingle_hashes(t or "", words)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    want = Counter((i, np.uint64(fps[a]).view(np.int64).item(), least[find(a)]) for a, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == want
    assert simhash.near_duplicates(frame([])).count() == 0


def test_majority_by_bits():
    from xxhash import xxh64_intdigest

    words = prose(random.Random(3), 700).split()
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.majority(simhash.shingle_hashes(" ".join(words), 4)) == want


def test_every_ball_is_probed(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    made = set(base)
    for b in base:
        for _ in range(3):
            made.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))))
    signed = [int(np.uint64(x).view(np.int64)) for x in made]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}


def test_wide_segments_are_complete_too(spark):
    rng = random.Random(27)
    made = set()
    for _ in range(25):
        b = rng.getrandbits(64)
        made |= {b, *(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))) for _ in range(3))}
    signed = [int(np.uint64(x).view(np.int64)) for x in made]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, simhash.WIDE_SEGMENTS).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for a, b in pairs:
        for x in (a, b):
            assert got.get(x, x) == find(x)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# substring duplicates


def removed(rows):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if seen.setdefault(w, (i, k)) != (i, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("owner_bytes", [1 << 25, 300])
def test_substring_dedup(frame, monkeypatch, owner_bytes):
    monkeypatch.setattr(suffix_dedup, "OWNER_BYTES", owner_bytes)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 5000)
    rng = random.Random(6)
    shared = [prose(rng, 40) for _ in range(5)]
    rows = [(i, prose(rng, rng.randint(5, 60)) + " " + rng.choice(shared)[rng.randint(0, 60) :] + " " + prose(rng, 20)) for i in range(50)]
    rows += groups(rng, 6) and [(100 + i, t) for i, t in groups(rng, 6)] + [r for r in ODD if r[0] != 905] + [(907, "y" * 3000)]
    got = suffix_dedup.remove_repeats(frame(rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter(removed(rows))
    assert suffix_dedup.remove_repeats(frame([])).count() == 0


def test_long_runs_of_one_byte_do_not_meet_in_one_bucket(frame, monkeypatch):
    """Very many texts with a run of one byte: one owner, whose windows are one string a byte."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffix_dedup, "OWNER_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 5000)
    rng = random.Random(12)
    rows = [(i, prose(rng, 6) + rng.choice("--- A") * rng.randint(100, 400) + prose(rng, 6)) for i in range(300)]
    rows += [(400, "-" * 1000), (401, "-" * 99), (-3, "A" * 100), (402, "é" * 300), (403, "é" * 301)]
    sizes, real = [], suffix_dedup._cut

    def cut(texts, first, buckets):
        out = real(texts, first, buckets)
        hot = first.filter("big").groupBy("owner").count().count()
        sizes.append((hot, out.agg(F.sum(F.octet_length("snippet"))).first()[0], out.groupBy("bucket").agg(F.sum(F.octet_length("snippet")).alias("n")).agg(F.max("n")).first()[0]))
        return out

    monkeypatch.setattr(suffix_dedup, "_cut", cut)
    got = suffix_dedup.remove_repeats(frame(rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter(removed(rows))
    hot, _, largest = sizes[0]
    assert hot >= 2 and largest < 20_000  # one in four of the runs would be over 15,000 bytes a byte


def test_memory_of_a_large_bucket():
    import tracemalloc

    rng = random.Random(26)
    common = prose(rng, 12).encode()[:40]
    snippets = [(prose(rng, 12).encode() + common + prose(rng, 12).encode())[:168] for _ in range(12000)]
    keys = np.stack([np.arange(len(snippets)), np.zeros(len(snippets), np.int64)], 1)
    size = sum(map(len, snippets))
    tracemalloc.start()
    suffix_dedup.repeated_windows(snippets, keys)
    assert tracemalloc.get_traced_memory()[1] < 60 * size
    tracemalloc.stop()


def test_repeated_rows_are_one_document(frame):
    text = prose(random.Random(8), 60)
    got = suffix_dedup.remove_repeats(frame([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, len(text))]


def test_segments_join(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 150)
    rng = random.Random(9)
    rows = [(1, prose(rng, 200)), (2, prose(rng, 90))]
    rows += [(3, rows[0][1][100:700] + rows[1][1])]
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(frame(rows)).collect()) == Counter(removed(rows))


def test_suffix_array():
    rng = random.Random(10)
    for _ in range(200):
        s = bytes(rng.choice(rng.choice([b"a", b"ab", b"abcdef"])) for _ in range(rng.randint(0, 200)))
        assert suffix_dedup.suffix_array(np.frombuffer(s, np.uint8), 300).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


# passages


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def changed(rng, words, kind, times):
    out = list(words)
    for _ in range(times):
        at = rng.randrange(5, len(out) - 5)
        if kind == "replace":
            out[at] = "other"
        elif kind == "insert":
            out.insert(at, "other")
        else:
            del out[at]
    return out


def test_passages_against_all_windows(frame):
    rng = random.Random(11)
    base = [prose(rng, 60).split() for _ in range(3)]
    rows = []
    for i in range(36):
        kind = rng.choice(["replace", "insert", "delete"])
        middle = changed(rng, base[i % 3], kind, rng.randint(0, 3)) if i % 4 else prose(rng, 55).split()
        rows.append((i, " ".join(prose(rng, rng.randint(3, 12)).split() + middle + prose(rng, 6).split()).title()))
    rows += ODD + [(950, None), (7, rows[7][1])]
    got = passages.near_passages(frame(rows)).collect()
    texts = {i: (t or "").lower().split() for i, t in rows}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        a, b = texts[r.first_id][r.first_word : r.first_word + r.first_words], texts[r.doc_id][r.word : r.word + r.n_words]
        assert r.first_id < r.doc_id and min(r.first_words, r.n_words) >= 50
        assert len(a) == r.first_words and len(b) == r.n_words and abs(jaccard(shingle_set(a), shingle_set(b)) - r.similarity) < 1e-9 and r.similarity >= 0.8
        root[find(r.doc_id)] = find(r.first_id)
    # all pairs of windows of 50 words
    sets = {i: [shingle_set(w[k : k + 50]) for k in range(len(w) - 49)] for i, w in texts.items() if i < 36}
    want = [(i, j) for i in sets for j in sets if i < j and any(jaccard(x, y) >= 0.8 for x in sets[i] for y in sets[j])]
    assert len(want) > 30 and np.mean([find(i) == find(j) for i, j in want]) >= 0.98
    assert passages.near_passages(frame([])).count() == 0


def test_passage_recall(frame):
    rng, rows, pairs = random.Random(17), [], []
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for size in (50, 80, 150):
        for kind in ("replace", "insert", "delete"):
            made = 0
            while made < 30:
                a = fresh(size + 5 * (size == 50))
                b = changed(rng, a, kind, rng.randint(1, max(1, size // 40)))
                if jaccard(shingle_set(a), shingle_set(b)) >= 0.8:
                    rows += [(len(rows), " ".join(fresh(60) + a + fresh(40))), (len(rows) + 1, " ".join(fresh(30) + b + fresh(70)))]
                    pairs.append((size, kind, len(rows) - 2))
                    made += 1
    got = {(r.first_id, r.doc_id) for r in passages.near_passages(frame(rows)).collect()}
    assert all(b == a + 1 and a % 2 == 0 for a, b in got)
    for size in (50, 80, 150):
        for kind in ("replace", "insert", "delete"):
            assert np.mean([(i, i + 1) in got for s, k, i in pairs if (s, k) == (size, kind)]) >= 0.9


def test_a_shared_line_hides_no_passage(frame):
    rng, rows = random.Random(18), []
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for g in range(20):
        around, line = fresh(30), fresh(34)
        rows += [(3 * g, " ".join(fresh(40) + line + fresh(40))), *[(3 * g + k, " ".join(fresh(25) + around[:12] + line + around[12:] + fresh(25))) for k in (1, 2)]]
    rows += [(100 + i, " ".join(fresh(30) + rows[0][1].split()[40:74] + fresh(30))) for i in range(30)]
    got = {(r.first_id, r.doc_id) for r in passages.near_passages(frame(rows)).collect()}
    assert got == {(3 * g + 1, 3 * g + 2) for g in range(20)}


def test_compact_windows():
    values = np.random.default_rng(0).integers(0, 2**63, 700).astype(np.uint64)
    values[300:330] = values[300]
    owner = np.repeat(np.arange(5), [0, 290, 30, 180, 200])
    want = set()

    def split(lo, hi):  # the Cartesian tree, node by node
        if hi - lo + 1 >= passages.LEAST:
            c = min(range(lo, hi + 1), key=lambda k: (int(values[k]) >> 32, k))
            want.add((lo, c, hi))
            split(lo, c - 1)
            split(c + 1, hi)

    for text in range(5):
        inside = np.nonzero(owner == text)[0]
        if len(inside):
            split(int(inside[0]), int(inside[-1]))
    found = passages.compact_windows(values, owner)
    assert set(zip(*[x.tolist() for x in found])) == want
    other = passages.compact_windows(values[::-1].copy(), owner)
    i, j = passages.joined(found, other)
    both = {(a, b) for a in range(len(found[0])) for b in range(len(other[0])) if max(found[0][a], other[0][b]) <= min(found[1][a], other[1][b]) and max(found[1][a], other[1][b]) <= min(found[2][a], other[2][b]) and min(found[2][a], other[2][b]) - max(found[0][a], other[0][b]) + 1 >= passages.LEAST > abs(int(found[1][a] - other[1][b]))}
    assert set(zip(i.tolist(), j.tolist())) == both


def test_word_hashes(monkeypatch):
    text = "Some words, a\ttab \r\n and É then Some\x0bwords again " * 9
    monkeypatch.setattr(passages, "BLOCK", 50)
    h, at = passages.word_hashes(text.encode())
    words = text.encode().split()
    assert len(h) == len(words) and [text.encode()[k:].startswith(w) for k, w in zip(at.tolist(), words)]
    lowered = [w.lower() if w.isascii() else w for w in words]
    assert len(set(zip(h.tolist(), lowered))) == len(set(lowered)) == len(set(h.tolist()))


# benchmark overlaps


def test_decontamination(frame, spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(15, 50))) for i in range(12)] + [(50, None), (51, ""), (52, "short one"), (53, "twoabc threeabc, Fourabc")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for i in range(60):
        t = prose(rng, 60)
        if i % 3 == 0:
            item, passage = items[i % 12]
            w = passage.upper().split()
            if i % 2:
                for k in range(4, len(w), 9):
                    w[k] = "subst"
            t, want = prose(rng, i) + ", " + " ".join(w) + ". " + t, want | {(i, item)}
        rows.append((i, t))
    rows += ODD + [(960, "so twoabc THREEABC fourabc twoabc threeabc fourabc"), (961, "twoabc threeabc"), (962, "twoabc other threeabc fourabc")]
    want.add((960, 53))
    for bound in (10**6, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
        got = decontaminate.overlaps(frame(rows), bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert all(r.n_equal >= 0.8 * r.n_words and r.n_words >= 10 or r[:] == (960, 53, 1, 3, 3) for r in got)
    clean = decontaminate.decontaminate(frame(rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in rows if i not in {a for a, _ in want})
    assert decontaminate.overlaps(frame([]), bench).count() == 0
    assert decontaminate.overlaps(frame(rows), bench.limit(0)).count() == 0


def test_decontamination_against_all_runs(frame, spark):
    rng = random.Random(20)
    items = [(i, prose(rng, n)) for i, n in enumerate((12, 20, 35, 60))]
    rows = []
    for i in range(120):
        part = items[i % 4][1].split()[rng.randint(0, 8) :]
        part = [w if rng.random() < rng.choice((0.7, 0.9, 1)) else "other" for w in part]
        rows.append((i, " ".join(prose(rng, rng.randint(0, 9)).split() + part + prose(rng, 5).split())))
    want = {}
    for d, t in rows:
        for k, item in items:
            a, b = t.split(), item.split()
            for shift in range(-len(b), len(a)):
                equal = [0 <= q + shift < len(a) and a[q + shift] == b[q] for q in range(len(b))]
                if any(sum(equal[x:y]) >= 0.8 * (y - x) for x in range(len(b)) for y in range(x + 10, len(b) + 1) if equal[x] and equal[y - 1] or y - x == len(b)):
                    want[d, k] = True
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 40 and got <= want.keys() and len(got) >= 0.97 * len(want)


def test_a_very_long_item(frame, spark):
    rng = random.Random(25)
    long = ["w%d" % rng.randrange(10**6) for _ in range(20000)]
    rows = [(1, " ".join(long[500:530])), (2, " ".join(long)), (3, prose(rng, 500))]
    got = decontaminate.overlaps(frame(rows), spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.n_equal) for r in got} == {(1, 30), (2, 20000)}


# shards


def test_sharding(frame):
    rows = groups(random.Random(13)) + ODD + [(903, "one"), (None, "nobody")]
    rows += [(3000 + i, "hot") for i in range(200)]
    got = sharding.shard_rows(frame(rows), 16).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in counts)
    sizes = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == sizes
    # the same as serving the ring row by row
    points = sharding.ring(16)
    arcs = Counter(sharding.arc_number(int(hashlib.md5((t or "").encode()).hexdigest()[:8], 16), points) for _, t in rows)
    room = [len(rows) // 16 + (s < len(rows) % 16) for s in range(16)]
    want = Counter()
    for arc in range(len(points)):
        for _ in range(arcs[arc]):
            at = arc
            while want[points[at % len(points)][1]] >= room[points[at % len(points)][1]]:
                at += 1
            want[points[at % len(points)][1]] += 1
    assert counts == want
    assert sharding.shard_rows(frame([])).count() == 0


# tokens


def test_bpe_equals_the_library(frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(14)
    letters = ["ab", "aab \n", "hello wrd'st.,", "éèêñßü ", "0123 ", "  \t\n x", "日本語 ", "🙂 a", "=-_ "]
    rows = [(i, "".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    rows += ODD + [(950, "<|endoftext|> a<|endoftext|>"), (951, "a" * 5000), (952, " " * 99 + "x"), (953, "I'll  we've\n\n they're")]
    got = {r.doc_id: r for r in bpe.round_trip(frame(rows)).collect()}
    for i, t in rows:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        back = ref.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), t
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(rows))).collect()}
    assert texts == {i: t or "" for i, t in rows}
    assert bpe.round_trip(frame([])).count() == 0


def test_cache_turns_over(monkeypatch):
    t = bpe.tokenizer(bpe._spec(None))
    texts = [prose(random.Random(i), 50) for i in range(60)]
    first = [x.tolist() for x in t.encode(texts)]
    monkeypatch.setattr(t.words, "most", 5)
    monkeypatch.setattr(t.chunks, "most", 5)
    assert [t.encode([x])[0].tolist() for x in texts] == first


# chats


def test_chat_folding(spark):
    log = [
        (1, 0, "message", 1, "user", "hi"), (1, 1, "message", 2, "assistant", "he"), (1, 2, "delta", 2, None, "llo"), (1, 3, "edit", 1, None, "Hi</s>"),
        (1, 4, "message", 3, "user", "more"), (1, 5, "regenerate", 2, None, ""), (1, 6, "delta", 2, None, "again"), (1, 7, "delta", None, None, "!"),
        (2, 0, None, None, None, None), (3, 1, "message", 1, "a\nb\\", "[INST]\\"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.format_chats(events).collect()}
    assert chat.parse(got[1].formatted) == [("user", "Hi</s>"), ("assistant", "again!")]
    assert [got[1].formatted[s.begin : s.end] for s in got[1].loss] == ["again!"]
    assert chat.parse(got[2].formatted) == [("", "")] and chat.parse(got[3].formatted) == [("a\nb\\", "[INST]\\")]
    assert chat.format_chats(events.limit(0)).count() == 0


def test_chat_query(spark):
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/conversations.parquet").collect()
    by = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.op3_chat(spark, data).collect()}
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = sorted(turns)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_escapes():
    rng = random.Random(15)
    parts = ["<", "s", ">", "/", "\\", "[INST]", "</s>", "n", "\n", "<<SYS>>", "|im_start|>", "<|"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)
        assert chat.parse(chat.render([(t, t), ("assistant", t)])[0]) == [(t, t), ("assistant", t)]


# classifiers


def labelled(rng, n=900):
    docs, labels = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.25, rng.random() < 0.3
        t = prose(rng, rng.randint(20, 90))
        if toxic:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["awfulword", "nastyword"]))
            t = " ".join(w)
        if junk:
            t = t.upper().replace(" ", "!! ")
        docs.append((i, t))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return docs, labels


@pytest.mark.parametrize("module, column, cut, mod, rest", [(toxicity, "toxic", 0.5, 5, 0), (quality, "quality", 0.7, 4, 2)])
def test_classifiers(spark, frame, module, column, cut, mod, rest):
    docs, labels = labelled(random.Random(16))
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = module.train(frame(docs + ODD), marked)
    scores = {r.doc_id: r.score for r in module.score(frame(docs + ODD + [(903, "one")]), model).collect()}
    assert scores.keys() == {i for i, _ in docs + ODD} and all(0 <= s <= 1 for s in scores.values())
    truth = {r[0]: r[1] if column == "quality" else r[2] for r in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % mod == rest]
    assert np.mean([(scores[i] >= cut) == (truth[i] == 1) for i in held]) > 0.95
    # labels of held-out rows have no say
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % mod == rest else q, 1 - t if zlib.crc32(str(i).encode()) % mod == rest else t) for i, q, t in labels]
    other = module.train(frame(docs + ODD), spark.createDataFrame(flipped, marked.schema))
    again = {r.doc_id: r.score for r in module.score(frame(docs + ODD), other).collect()}
    assert all(abs(again[i] - scores[i]) < 1e-9 for i in again)
    empty = module.train(frame([]), marked.limit(0))
    assert all(0 <= r.score <= 1 for r in module.score(frame(docs[:5] + ODD), empty).collect())
    assert module.score(frame([]), model).count() == 0


def test_sample_counts_rows(spark, frame, monkeypatch):
    docs, labels = labelled(random.Random(28), 200)
    marked = spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int")
    seen = []
    for module in (toxicity, quality):
        monkeypatch.setattr(module, "fit", lambda *a: seen.append([len(x) for x in a if not isinstance(x, float)]))
        module.train(frame(docs * 3), marked)
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 != 0]
    assert seen[0] == [sum(t for i, _, t in labels if i in held), len(held)]
    assert seen[1] == [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, _ in labels)] * 2


def area(scores, truth):
    """Share of (positive, negative) pairs in the right order."""
    good, bad = (np.array([scores[i] for i, t in truth.items() if t == k]) for k in (1, 0))
    return np.mean([(x > bad).mean() + (x == bad).mean() / 2 for x in good])


def test_forward_solves_the_triangle():
    rng = np.random.default_rng(4)
    factor = np.tril(rng.normal(size=(9, 9))) + 3 * np.eye(9)
    b = rng.normal(size=(9, 50))
    assert np.allclose(factor @ quality.forward(factor, b), b)


def test_held_out_order(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for query, column, least in ((toxicity.op1_toxicity, "toxic", 0.85), (quality.op9_quality, "quality", 0.98)):
        rows = [r for r in query(spark, data).collect() if r.held_out and r.doc_id in labels]
        scores, truth = {r.doc_id: r.score for r in rows}, {r.doc_id: labels[r.doc_id][column] for r in rows}
        assert area(scores, truth) >= least
