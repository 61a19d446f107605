"""Hard negatives against brute force: corner cases, pruning, blocks."""

import math
import random

from lodestone.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, relabel=7):
    kept = []
    for v, e, lab in rows:
        if v is None or lab is None or e is None or any(x is None or not math.isfinite(x) or abs(x) >= hard_negatives.LARGEST for x in e):
            continue
        lab = (lab + 1) % 10 if v % relabel == 0 else lab
        kept.append((v, [math.floor(256 * x) for x in e], lab))
    out = []
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    for v, q, lab in kept:
        if v % 100:
            continue
        best = sorted((-dot(q, y), w) for w, y, other in kept if other == lab and w != v)[:5]
        for s, p in best:
            hard = sorted((-dot(q, y), w) for w, y, other in kept if other != lab and 80 * -s <= 100 * dot(q, y) <= 100 * -s)[:5]
            out += [(v, p, k + 1, w, -s, -n) for k, (n, w) in enumerate(hard)]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def clustered(seed, n=400, dims=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 2) for _ in range(dims)] for _ in range(6)]
    return [(i, [f32(c + rng.gauss(0, 0.2)) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]


def test_equals_brute_force_in_small_blocks(spark, monkeypatch):
    rows = clustered(1)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    assert result(hard_negatives.mined(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_rows_out_of_reach_are_not_sent(spark):
    rows = clustered(2, 800)
    df = spark.createDataFrame(rows, SCHEMA)
    data = hard_negatives.quantised(df)
    cells = hard_negatives.cells_of(data, 8)
    placed = hard_negatives.placed(data, cells, False).selectExpr("*", "0 AS block")
    near = hard_negatives.served(placed, cells, {g: 100.0 for g in range(8)}, "all")
    assert 0 < near.count() < 0.5 * 8 * 800


def test_corner_cases(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(100 * i, [1.0, 0.5, f32(0.1 * i)], i % 3) for i in range(4)]
    rows += [(i, [f32(i % 5 / 4), 0.25, -0.5], i % 3) for i in range(1, 40)]
    rows += [(50, None, 1), (51, [nan, 1.0, 1.0], 1), (52, [inf, 0.0, 0.0], 1), (53, [None, 0.0, 1.0], 1), (54, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(55, [], 1), (56, [1.0], 2), (57, [1e20, 0.0, 0.0], 2), (58, [1.0, 0.5, 0.0], 1), (58, [1.0, 0.5, 0.0], 1), (300, [1.0, 0.5, f32(0.3)], 0)]
    rows += [(500, [-1.0, -1.0, -1.0], 0), (600, [0.0, 0.0, 0.0], 0), (700, [60000.0, -60000.0, 1.0], 2), (59, [60000.0, -59000.0, 1.0], 1), (60, [60000.0, -60000.0, 1.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("row", "q", "cell", "to", "score")])
    assert result(hard_negatives.mined(df)) == brute(rows)
    assert result(hard_negatives.mined(spark.createDataFrame([], SCHEMA))) == []
    assert result(hard_negatives.mined(spark.createDataFrame([(100, [1.0], 1)], SCHEMA))) == []


def test_one_vector_that_a_third_of_all_rows_hold(spark, monkeypatch):
    rows = clustered(3, 200)
    rows += [(1000 + i, rows[0][1], i % 4) for i in range(100)]
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 16)
    assert result(hard_negatives.mined(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
