"""Importance resampling against brute force; the tournament against a sort."""

import math
import random
import re
import zlib
from hashlib import sha256

from lodestone.llm import resampling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def brute(rows, target, n=1, buckets=10_000, seed=2024, least=20, percent=10):
    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = {}, {}
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for g in grams(x, n)[0]:
                counts[at(g)] = counts.get(at(g), 0) + 1
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (big_s + buckets) / ((s.get(b, 0) + 1) * (big_t + buckets))))
    out = []
    for d, x in rows:
        found, words = grams(x, n)
        weight = sum(gain(at(g)) for g in found)
        h = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((r[:5] for r in out), key=str)


def result(df):
    return sorted((list(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    pool = [rng.choice(["alpha", "Beta", "né", "x1", "ЖУК", "10"]) + str(rng.randrange(40)) for _ in range(200)]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(rng.choice([3, 19, 20, 60])))) for i in range(n)]


def test_equals_brute_force(spark, frame):
    rows, target = corpus(1, 300), [x for _, x in corpus(2, 20)]
    items = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    assert result(resampling.resampled(frame(rows), items)) == brute(rows, target)
    assert result(resampling.resampled(frame(rows), items, grams=3, buckets=97, percent=35)) == brute(rows, target, 3, 97, percent=35)


def test_many_runs_ranges_and_blocks(spark, frame, monkeypatch):
    rows, target = corpus(3, 600), ["alpha1 beta2"]
    items = spark.createDataFrame([(1, target[0])], "item_id long, text string")
    for name, value in (("RUN", 20), ("BLOCK", 7), ("RANGE", 30)):
        monkeypatch.setattr(resampling, name, value)
    for percent in (0, 10, 100):
        assert result(resampling.resampled(frame(rows), items, percent=percent)) == brute(rows, target, percent=percent)


def test_corner_cases(spark, frame):
    same = " ".join(["tie"] * 25)
    rows = [(1, None), (2, ""), (3, "!!! ???"), (4, same), (4, same), (None, same), (None, same), (5, "A\x00b" * 30), (6, " ".join(f"w{i}" for i in range(40000))), (-7, "é" * 300 + " " + same), (8, "Z" * 100_000)]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert result(resampling.resampled(frame(rows), empty, percent=50)) == brute(rows, [], percent=50)
    assert result(resampling.resampled(spark.createDataFrame([], "doc_id long, text string"), empty)) == []


def test_tournament_merges_players_that_join_late():
    rng = random.Random(4)
    runs = [sorted((rng.randrange(100), i, k) for k in range(rng.randrange(6))) for i in range(13)]
    tree, out = resampling.Tournament(), []
    for i, r in enumerate(runs):
        tree.join(iter(r))
        if i == 6:
            early = [tree.pop() for _ in range(4)]
            assert early == sorted(x for q in runs[:7] for x in q)[:4]
    while (row := tree.pop()) is not None:
        out.append(row)
    assert out == sorted(x for q in runs for x in q if x not in early)


def test_checksums():
    import numpy as np

    words = [b"a", b"abc", b"x" * 64, b"y" * 65, b"z" * 5000]
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    assert resampling.crc32s(data, np.cumsum(sizes) - sizes, sizes).tolist() == [zlib.crc32(w) for w in words]
