"""Operators against small brute-force versions, and every registered query against its SQL."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import compact, entries, graph, layout, rank, stream
from lodestone.plans import catalog, edits, formats  # noqa: F401
from lodestone.session import table

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = sql.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: [(v is None, str(v)) for v in r]
    a = sorted(map(key, (tuple(r) for r in got.select(*columns).collect())))
    b = sorted(map(key, want.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert a == b


def test_running_offset_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(i * 3, rng.choice([None, 0, 5, 17])) for i in range(500)]
    got = {r.k: r.o for r in layout.running_offset(spark.createDataFrame(rows, "k long, n long"), "n", ["k"], "o", 7).collect()}
    at = 0
    for k, n in rows:
        assert got[k] == at
        at += n or 0


def test_layout_of_nothing(spark):
    empty = spark.createDataFrame([], "k long, n long")
    assert layout.running_offset(empty, "n", ["k"], "o").count() == 0
    assert layout.gcd_of(empty, "n", ["k"]).count() == 0
    assert entries.assign_ids(empty, "n", ["k"]).count() == 0


def test_gcd(spark):
    rows = [("a", 12), ("a", 18), ("a", 0), ("a", None), ("b", 7)]
    assert {r.g: r.gcd for r in layout.gcd_of(spark.createDataFrame(rows, "g string, v long"), "v", ["g"]).collect()} == {"a": 6, "b": 7}
    big = [(math.lcm(2**20, i),) for i in range(1, 3000)]
    assert layout.gcd_of(spark.createDataFrame(big, "v long"), "v").first().gcd == math.gcd(*[b[0] for b in big])


def test_auto_ids_fill_gaps_in_order(spark):
    rng = random.Random(2)
    for _ in range(3):
        used = rng.sample(range(60), 25)
        rows = [(i, used.pop() if used and rng.random() < 0.5 else None) for i in range(60)]
        got = {r.k: r.id for r in entries.assign_ids(spark.createDataFrame(rows, "k long, id long"), "id", ["k"]).collect()}
        taken, want, free = {v for _, v in rows if v is not None}, {}, 0
        for k, v in rows:
            if v is None:
                while free in taken:
                    free += 1
                v, free = free, free + 1
            want[k] = v
        assert got == want


def test_edits(spark):
    df = spark.range(6).select(F.col("id").alias("pos"), F.col("id").alias("v"))
    order = lambda d: [r.v for r in d.orderBy("pos").collect()]
    assert order(entries.move_entry(df, 1, 4)) == [0, 2, 3, 4, 1, 5]
    assert order(entries.move_entry(df, 4, 1)) == [0, 4, 1, 2, 3, 5]
    cut = entries.remove_entries(df, [0, 3])
    assert order(cut) == [1, 2, 4, 5] and [r.pos for r in cut.orderBy("pos").collect()] == [0, 1, 2, 3]
    assert order(entries.add_entries(cut, spark.createDataFrame([(0, 9)], "pos long, v long"))) == [1, 2, 4, 5, 9]


def test_distances_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r.root, r.node): r.distance for r in graph.distances(edges, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3}
    assert {r.node for r in graph.on_cycles(edges).collect()} == {"a", "b", "c"}


def test_constraints(spark):
    df = spark.sql("SELECT map('x', 'a') AS s, array(named_struct('name', 'x', 'value', 'a'), named_struct('name', 'y', 'value', 'q')) AS w")
    assert df.select(graph.passes_constraints(F.col("s"), F.col("w")).alias("p")).first().p
    other = df.withColumn("s", F.create_map(F.lit("x"), F.lit("b")))
    assert not other.select(graph.passes_constraints(F.col("s"), F.col("w")).alias("p")).first().p


def test_retyping_empties_a_column(spark):
    df = spark.range(2).withColumn("x", F.lit(5))
    assert [r.x for r in compact.retype_column(df, "x", "string").collect()] == [None, None]
    assert [r.x for r in compact.retype_column(df, "x", "int").collect()] == [5, 5]
    assert compact.visible_columns(["q", "ID", "w", "e", "r"], ["Name", "ID"]) == ["ID", "q", "w", "e"]


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 3, 1.0), ("b", 2, 2.0)], "k string, n long, s double")
    merged = {r.k: (r.s, r.n) for r in rank.merge_scores(df, ["k"], "s", "n").collect()}
    assert merged == {"a": (1.5, 4), "b": (2.0, 2)}
    assert len(rank.with_ties(spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "k string, n long"), ["k"], [F.col("n")]).collect()) == 2


def test_times(spark):
    one = spark.range(1)
    ms = 3_723_456
    row = one.select(text.srt_time(F.lit(ms)).alias("s"), text.ass_time(F.lit(ms)).alias("a"), text.parse_time(F.lit("1:02:03.45")).alias("p"), text.parse_time(F.lit("x")).alias("n")).first()
    assert (row.s, row.a, row.p, row.n) == ("01:02:03,456", "1:02:03.45", 3_723_450, None)
    assert one.select(stream.to_ticks(F.lit(999), 600).alias("t")).first().t == (999 * 600 + 500) // 1000


def test_plans_stay_narrow(spark):
    plan = table(spark, DATA, "documents").select("doc_id").filter("doc_id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "text" not in plan
