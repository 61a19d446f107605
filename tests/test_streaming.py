"""Streaming forms of the chunk operators, over files as they come, and functions from SQL."""

from pyspark.sql import functions as F

from lodestone.functions.register import register
from lodestone.session import table
from lodestone.streaming import chunks

DATA = "/root/testdata/sf0.001"


def run(df, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName("out").start()
    try:
        q.processAllAvailable()
        return df.sparkSession.sql("SELECT * FROM out").collect()
    finally:
        q.stop()


def events(spark, tmp_path):
    rows = table(spark, DATA, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.length("props").alias("size"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_offsets_per_stream(spark, tmp_path):
    rows, live = events(spark, tmp_path)
    got = run(chunks.stream_offsets(live, "user_id", "event_id", "size"), "append")
    total = {r.user_id: r.n for r in rows.groupBy("user_id").agg(F.sum("size").alias("n")).collect()}
    size = {r.event_id: r.size for r in rows.collect()}
    assert len(got) == len(size)
    ends = {}
    for r in got:
        ends.setdefault(r.user_id, []).append((r.byte_offset, r.byte_offset + size[r.event_id]))
    for user, parts in ends.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == total[user] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_windows(spark, tmp_path):
    rows, live = events(spark, tmp_path)
    got = run(chunks.windowed_totals(live, "user_id", "ts", "size", late="1000 days"), "update")
    last = {}
    for r in got:
        key = (r.window_start, r.user_id)
        last[key] = max(last.get(key, (0, 0)), (r.chunks, r.payload_bytes))
    assert sum(v[0] for v in last.values()) == rows.count()


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT unmask_table(unmask_table(x)) = x AS m, decompress_payload(compress_payload(encode(repeat('ab', 200), 'utf-8'))) = encode(repeat('ab', 200), 'utf-8') AS c, checksum_769(x) AS s, crc16_msb(x) AS r, legacy_text(x) AS t, u16_list(x) AS u FROM (SELECT encode('ab', 'utf-8') AS x)").first()
    assert (row.m, row.c, row.s, row.t, row.u) == (True, True, ~(97 * 769 + 98) & 0xFFFFFFFF, "ab", [0x6162])
