"""Readers as table functions of SQL."""

from lodestone.codecs import archives, stream
from lodestone.functions import register


def test_entries_and_chunks_in_sql(spark):
    register.register_tables(spark)
    made = [("a", archives.build_bank([(3, b"x"), (9, b"yy")])), ("b", b"nothing"), ("c", None), ("d", stream.build_chunk("@SFV", b"1", 2, time=5))]
    spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in made], "name string, content binary").createOrReplaceTempView("table_function_blobs")
    got = spark.sql("SELECT name, f.entry_id, f.file_size FROM table_function_blobs, LATERAL archive_entries(content) f ORDER BY 2").collect()
    assert [tuple(r) for r in got] == [("a", 3, 1), ("a", 9, 2)]
    got = spark.sql("SELECT name, f.magic, f.channel, f.frame_time FROM table_function_blobs, LATERAL stream_chunks(content) f WHERE name = 'd'").collect()
    assert [tuple(r) for r in got] == [("d", "@SFV", 2, 5)]
