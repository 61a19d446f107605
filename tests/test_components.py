"""Strongly connected components against reachability, and their growth on one long ring."""

import random

from lodestone.operators import graph


def brute(edges):
    nodes = {n for e in edges for n in e}
    to = {n: {d for s, d in edges if s == n} for n in nodes}

    def reach(n):
        seen, work = set(), [n]
        while work:
            for d in to[work.pop()]:
                if d not in seen:
                    seen.add(d)
                    work.append(d)
        return seen

    r = {n: reach(n) for n in nodes}
    return {n: min([n, *(m for m in r[n] if n in r[m])]) for n in nodes}, {n for n in nodes if n in r[n]}


def components(spark, edges):
    return dict(graph.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect())


SHAPES = {
    "chain into a ring into a chain": [(0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5)],
    "two rings that share a node": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2)],
    "a chain beside the ring that it ends in": [(5, 6), (6, 7), (7, 0), (0, 1), (1, 0), (1, 2), (2, 7), (2, 9), (8, 6)],
    "own loop and repeated edges": [(1, 1), (1, 2), (1, 2), (3, 3)],
    "no cycle": [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)],
}


def test_shapes_and_random_graphs(spark):
    """All of them side by side in one graph."""
    edges = []
    for seed, n, m in ((1, 40, 50), (2, 40, 90), (3, 30, 36)):
        rng = random.Random(seed)
        edges += [(1000 * seed + rng.randrange(n), 1000 * seed + rng.randrange(n)) for _ in range(m)]
    for k, shape in enumerate(SHAPES.values()):
        edges += [(100 * k + a, 100 * k + b) for a, b in shape]
    assert components(spark, edges) == brute(edges)[0]


def test_nodes_on_cycles(spark):
    edges = [(1, 1), (1, 2), (2, 3), (3, 2), (4, 1)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node for r in graph.on_cycles(df).collect()} == brute(edges)[1]
    assert graph.on_cycles(df.limit(0)).count() == 0


def test_one_long_ring_takes_few_rounds_and_no_square_of_rows(spark, monkeypatch):
    n, sizes = 3000, []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df, *a: (lambda out: (sizes.append(out.count()), out)[1])(real(df, *a)))
    ring = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    assert {r.component for r in graph.strong_components(ring).collect()} == {0}
    assert max(sizes) <= n and len(sizes) < 30
