import pytest
from pyspark.sql import functions as F

from lodestone.operators import naming
from lodestone.session import checkpointed, table

PLANNED = ("spark.sql.autoBroadcastJoinThreshold", "10485760")


@pytest.fixture
def fresh(spark):
    """A session of the same application with Spark's own settings."""
    other = spark.newSession()
    other.conf.set(*PLANNED)
    return other


def test_small_files_of_many_rows_are_not_broadcast(fresh):
    rows = 400_000
    one = checkpointed(fresh.range(rows).select("id", F.lit(1).alias("x"), F.lit("a constant takes no room in a file").alias("y")))
    met = one.join(one.select("id", F.col("x").alias("z")), "id").agg(F.count("*"), F.sum("z"))
    assert met.collect() == [(rows, rows)]
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_tables_that_pack_well_are_not_broadcast(fresh, tmp_path):
    rows = 400_000
    fresh.range(rows).select(F.col("id").alias("k"), F.lit("of one name").alias("name")).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    named = table(fresh, str(tmp_path), "t")
    met = named.join(fresh.range(10).select(F.col("id").alias("k")).join(named.select("k"), "k"), "k")
    assert met.count() == 10
    whole = naming._first_of(named, "name", ["k"])
    assert "BroadcastExchange" not in whole._jdf.queryExecution().executedPlan().toString()
    assert whole.filter("_is_first").count() == 1 and whole.count() == rows


def test_a_stream_of_packets_is_no_one_group(spark):
    import re

    from lodestone.operators import stream

    rows = spark.range(1000).select(F.lit("all").alias("s"), "id", F.encode(F.lpad(F.col("id").cast("string"), 7, "0"), "utf-8").alias("raw"))
    found = stream.packets(rows, "s", ["id"], "raw", 64)
    assert not re.search(r"hashpartitioning\(s#\d+, \d+", found._jdf.queryExecution().executedPlan().toString())
    whole = b"".join(f"{i:07}".encode() for i in range(1000))
    assert {r.packet_no: bytes(r.content) for r in found.collect()} == {k: whole[64 * k : 64 * k + 64] for k in range(-(-len(whole) // 64))}
