"""Walks beyond 64 steps."""

from lodestone.operators import graph


def test_long_cycle(spark):
    n = 70
    ring = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    roots = spark.range(1).selectExpr("id AS root")
    assert sorted(r.distance for r in graph.distances(ring, roots).collect()) == list(range(n))
    assert graph.on_cycles(ring).count() == n
