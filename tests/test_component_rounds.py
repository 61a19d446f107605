"""Rounds and joins of strongly connected components: rings that are told from walks, counted sides, odd edges."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph


def walked(to):
    """Component of each node where each has one way out."""
    out = {n: n for n in {*to, *to.values()}}
    for n in to:
        seen, at = {n}, to[n]
        while at in to and at not in seen:
            seen.add(at)
            at = to[at]
        if at == n:
            ring, at = [n], to[n]
            while at != n:
                ring.append(at)
                at = to[at]
            out[n] = min(ring)
    return out


def tailed(rng, ring, tail, base, up):
    """A ring with a tail that leads into it; the tail's numbers go up or down, and lie below or above those of the ring."""
    ring_at, tail_at = (base, base + ring) if up else (base + tail, base)
    order = list(range(ring_at, ring_at + ring))
    rng.shuffle(order)
    way = list(range(tail_at, tail_at + tail))[:: 1 if rng.random() < 0.5 else -1] + [order[0]]
    return dict(zip(order, [*order[1:], order[0]])) | dict(zip(way, way[1:]))


def graph_of(spark, to, kind="long"):
    text = (lambda n: f"n{n:06}") if kind == "string" else int
    return spark.createDataFrame([(text(a), text(b)) for a, b in to.items()], f"src {kind}, dst {kind}"), {text(a): text(b) for a, b in walked(to).items()}


@pytest.mark.parametrize("kind, most", [("long", None), ("long", 0), ("string", None)])
def test_rings_with_tails_and_random_walks(spark, monkeypatch, kind, most):
    """Broadcast or not, and of numbers or texts."""
    if most is not None:
        monkeypatch.setattr(graph, "BROADCAST_BYTES", most)
    rng, to = random.Random(7), {}
    for i, (ring, tail) in enumerate([(2, 0), (2, 40), (3, 70), (50, 3), (7, 7), (33, 64), (4, 1), (16, 16), (17, 90)]):
        to |= tailed(rng, ring, tail, 1000 * i, i % 2)
    for i in range(20, 24):
        to |= {1000 * i + n: 1000 * i + rng.randrange(60) for n in range(60)}
    to |= {50_000 + n: 50_001 + n for n in range(200)}  # a chain that ends
    df, want = graph_of(spark, to, kind)
    assert dict(graph.strong_components(df).collect()) == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nodes_taken_out_of_long_walks_come_back(spark, monkeypatch, kind):
    """Rings, tails and chains, some of which are taken out as a whole but for one node."""
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 32 * 20)
    monkeypatch.setattr(graph, "LONG", 2)
    rng, to = random.Random(11), {}
    for i, (ring, tail) in enumerate([(2, 0), (2, 40), (90, 70), (3, 3), (1, 0), (40, 0)]):
        to |= tailed(rng, ring, tail, 1000 * i, i % 2)
    to |= {20_000 + n: 20_000 + rng.randrange(n) for n in range(1, 80)} | {30_000 + n: 30_001 + n for n in range(90)}
    df, want = graph_of(spark, to, kind)
    assert dict(graph.strong_components(df).collect()) == want
    ends, n, ring, n_ring = graph._followed(df.filter("src <> dst").toDF("node", "to"), len(to))
    assert {r.node for r in ring.collect()} == {n for n in want if list(want.values()).count(want[n]) > 1} and ring.count() == n_ring
    got = {r.node: r.to for r in ends.collect()}
    text = (lambda n: f"n{n:06}") if kind == "string" else int
    assert len(got) == n and got.items() >= {text(20_000 + n): text(20_000) for n in range(1, 80)}.items() and all(got[text(30_000 + n)] == text(30_090) for n in range(90))


def test_long_walks_send_less_than_by_doubling(spark, monkeypatch):
    """Rows on the larger side of a join shrink with the rounds: of a ring, less than half of what doubling writes."""
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 32 * 200)
    sizes, real = [], graph._counted
    monkeypatch.setattr(graph, "_counted", lambda df, *c: (lambda out: (sizes.append(out[1]), out)[1])(real(df, *c)))
    ring = spark.range(4000).selectExpr("id AS node", "(id + 1) % 4000 AS to")
    ends, n, found, n_ring = graph._followed(ring, 4000)
    assert (n, n_ring, found.distinct().count(), found.select("component").distinct().count()) == (0, 4000, 4000, 1)
    assert sum(1 for x in sizes if x > 3000) <= 12


def test_small_rings_take_few_rounds(spark, monkeypatch):
    """As many as the longest ring asks for, not the whole table."""
    steps, real = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df, *a: (steps.append(1), real(df, *a))[1])
    rings = spark.range(3000).selectExpr("id AS src", "id - id % 5 + (id + 1) % 5 AS dst")
    assert graph.strong_components(rings).groupBy("component").count().filter("count = 5 AND component % 5 = 0").count() == 600
    assert len(steps) <= 14


def test_tails_are_cut_before_walks_are_followed(spark, monkeypatch):
    """A ring whose nodes have tails in and out is followed once."""
    walks, real = [], graph._jumped
    monkeypatch.setattr(graph, "_jumped", lambda steps, *a: (walks.append(1), real(steps, *a))[1])
    edges = spark.range(400).selectExpr("id AS src", "(id + 1) % 400 AS dst").union(spark.range(1, 100).selectExpr("IF(id % 2 = 0, -id, id)", "IF(id % 2 = 0, id, -id)"))
    assert sorted(r.node for r in graph.on_cycles(edges).collect()) == list(range(400)) and len(walks) == 1


def test_only_counted_numbers_are_broadcast(spark):
    few, texts = spark.range(3), spark.range(3).select(F.col("id").cast("string"))
    hinted = lambda df: "isBroadcast" in str(df._jdf.queryExecution().logical()) or "ResolvedHint" in str(df._jdf.queryExecution().analyzed())
    assert hinted(graph._side(few, 3)) and not hinted(graph._side(few, graph.BROADCAST_BYTES)) and not hinted(graph._side(texts, 3))


def test_null_ends_and_repeated_edges(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (None, 1), (2, None), (None, None), (3, 3), (3, 3), (4, 1)], "src long, dst long")
    assert sorted(map(tuple, graph.strong_components(edges).collect())) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert graph.strong_components(edges.limit(0)).count() == 0
    assert graph.strong_components(edges.filter("src = 3")).collect() == [(3, 3)]


def test_one_large_component_is_no_hot_key(spark):
    """Neither components nor nodes on cycles are dealt out by component while there are few of them; nodes on their own loop count, single ones don't."""
    edges = spark.createDataFrame([(n, (n + 1) % 50) for n in range(50)] + [(60, 61), (61, 60), (70, 70), (80, 0), (1, 90), (70, 60), (None, None)], "src long, dst long")
    found = graph.on_cycles(edges)
    assert sorted(r.node for r in found.collect()) == [*range(50), 60, 61, 70]
    assert "rightHint=(strategy=broadcast)" in graph.strong_components(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
