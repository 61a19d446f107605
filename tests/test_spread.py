from lodestone import session
from lodestone.plans import walks


def test_starts_of_a_beam_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 50)
    rows = spark.range(1000).selectExpr("id % 7 AS l_suppkey", "id AS l_partkey", "CAST(id % 50 AS DOUBLE) AS l_quantity")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 1001).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    dealt = []
    beam = walks.chains.beam
    monkeypatch.setattr(walks.chains, "beam", lambda starts, *more: dealt.append(starts.rdd.getNumPartitions()) or beam(starts, *more))
    assert walks.beam_rounds(spark, str(tmp_path)).count() > 0
    assert dealt == [20]
