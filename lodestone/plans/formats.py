"""Registered queries of the format functions and of readers and writers of single files, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.codecs import adx, media, stream
from lodestone.functions import formats, text
from lodestone.operators import graph, layout
from lodestone.plans.catalog import query
from lodestone.session import checkpointed, table
from lodestone.sources import files, sinks

#: First bytes by number, and what they are.
HEADS = (
    ("48434100", "hca", "hca"), ("C8C3C100", "hca", "hca"), ("8000002003", "adx", "adx"), ("8000002010", "ahx", "adx"), ("56414770", "vag", None), ("43574156", "3ds-adpcm", None), ("43574143", "wiiu-adpcm", None),
    ("01000080", "switch-opus", None), ("00000018667479704D3441", "m4a", None), ("FFF15080", "adts", None), ("FFFB9064", "mp3", None), ("FFFB0064", "unknown", None), ("494433", "mp3", None), ("664C6143", "flac", None),
    ("4F676753" + "00" * 22 + "011E" + "4F70757348656164", "opus", None), ("4F676753" + "00" * 22 + "011E" + "01766F72626973", "vorbis", None), ("4F676753" + "00" * 22 + "011E" + "5370656578202020", "speex", None), ("4F676753", "ogg", None),
    ("52494646000000005741564566" + "6D742010000000" + "7002", "atrac3", "wav"), ("524946460000000057415645" + "4C49535403000000" + "61626300" + "666D742010000000" + "6601", "xma2", "wav"),
    ("524946460000000057415645666D742028000000" + "FEFF" + "00" * 22 + "D242E147BA368D4D88FC61654F8C836C", "atrac9", "wav"), ("524946460000000057415645666D7420100000000100", "wav", "wav"),
    ("43504B20", "unknown", "cpk"), ("40555446", "unknown", "csb,acb,aax,utf"), ("0000000000000003", "unknown", "acx"), ("53465348", "unknown", "usm"), ("000001BA", "unknown", "sfd"),
)
_ALL = ",".join(formats.FALLBACK)


def _case(index: str, values: list) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _heads(spark, sf_dir) -> DataFrame:
    listed = F.array(*[F.lit(h) for h, _, _ in HEADS])
    return table(spark, sf_dir, "part").select("p_partkey", F.get(listed, (F.col("p_partkey") % len(HEADS)).cast("int")).alias("head"))


@query("payload_codecs", f"SELECT p_partkey, {_case(f'p_partkey % {len(HEADS)}', [c for _, c, _ in HEADS])} AS codec, {_case(f'p_partkey % {len(HEADS)}', [formats.CODECS[c][1] for _, c, _ in HEADS])} AS ext FROM part")
def payload_codecs(spark, sf_dir):
    named = _heads(spark, sf_dir).select("p_partkey", formats.payload_codec(F.col("head")).alias("codec"))
    return named.withColumn("ext", formats.codec_extension(F.col("codec")))


@query("candidate_formats", f"SELECT p_partkey, {_case(f'p_partkey % {len(HEADS)}', [f or _ALL for _, _, f in HEADS])} AS formats FROM part")
def candidate_formats(spark, sf_dir):
    return _heads(spark, sf_dir).select("p_partkey", F.array_join(formats.candidate_formats(F.col("head")), ",").alias("formats"))


@query(
    "aac_signatures",
    """
    SELECT substr(h, 1, 64) || substr(h, 73, 8) AS signature, COUNT(*) AS payloads FROM (SELECT hex(substr(text, 1, 60)) AS h FROM documents WHERE octet_length(encode(text)) >= 60)
    WHERE length(h) >= 80 GROUP BY 1
    """,
)
def aac_signatures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.octet_length("text") >= 60)
    signed = docs.select(formats.aac_signature(F.hex(F.substring("text", 1, 60))).alias("signature")).filter("signature IS NOT NULL")
    return signed.groupBy("signature").agg(F.count("*").alias("payloads"))


@query(
    "presets",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE (l_partkey % 2)::INT::VARCHAR || (l_suppkey % 2)::INT::VARCHAR || (l_orderkey % 2)::INT::VARCHAR || (l_linenumber % 2)::INT::VARCHAR
      WHEN '0100' THEN 'id' WHEN '1001' THEN 'filename' WHEN '1101' THEN 'filename_id' WHEN '1011' THEN 'filename_group' WHEN '1110' THEN 'id_group' WHEN '1111' THEN 'filename_id_group' ELSE 'custom' END AS preset
    FROM lineitem
    """,
)
def presets(spark, sf_dir):
    odd = [F.col(c) % 2 == 1 for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", formats.preset(*odd).alias("preset"))


_EVENT = [(c, n, m) for c, n, m in formats.EVENTS]


@query(
    "command_meanings",
    "WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {c}, {-1 if n is None else n}, '{m}')" for i, (c, n, m) in enumerate(_EVENT)) + f""") t(i, code, n, meaning))
    SELECT event_id, m.code, CASE WHEN n < 0 OR n = 2 * (event_id % 3) THEN meaning ELSE 'unknown' END AS meaning,
           CASE WHEN m.code = 2001 AND event_id % 3 = 2 THEN CAST(event_id * 1000 AS BIGINT) WHEN m.code = 2005 AND event_id % 3 = 1 THEN CAST(event_id % 65536 - CASE WHEN event_id % 65536 >= 32768 THEN 65536 ELSE 0 END AS BIGINT) END AS wait
    FROM events JOIN m ON event_id % {len(_EVENT)} = i
    """,
)
def command_meanings(spark, sf_dir):
    codes = F.array(*[F.lit(c) for c, _, _ in _EVENT])
    hexed = F.lpad(F.hex("event_id"), 8, "0")
    value = F.expr("event_id % 3").cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", F.get(codes, (F.col("event_id") % len(_EVENT)).cast("int")).alias("code"), F.when(value == 0, "").when(value == 1, F.substring(hexed, 5, 4)).otherwise(hexed).alias("v"))
    return rows.select("event_id", "code", formats.command_meaning(F.col("code"), F.length("v") / 2, F.lit(False)).alias("meaning"), formats.command_wait(F.col("code"), F.col("v")).alias("wait"))


@query(
    "sequence_names",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, COALESCE(" + _case("l_partkey % 10", [formats.SEQUENCES.get(i, "unknown") for i in range(10)]) + ", 'unknown') AS sequence, " + _case("l_suppkey % 13", [formats.REFERENCES.get(i, "unknown") for i in range(13)]) + " AS reference FROM lineitem",
)
def sequence_names(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").select(*keys, formats.sequence_name(F.col("l_partkey") % 10).alias("sequence"), formats.reference_name(F.col("l_suppkey") % 13).alias("reference"))


@query(
    "crc16",
    """
    SELECT p_partkey, list_reduce(list_prepend(0, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, CAST(i AS INT), 1)))),
      lambda c, b: list_reduce(list_prepend(xor(c, b * 256), range(8)), lambda x, i: CAST(CASE WHEN x >= 32768 THEN xor((x * 2) % 65536, 32773) ELSE x * 2 END AS BIGINT))) AS crc FROM part
    """,
)
def crc16(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", formats.crc16(F.col("p_name")).cast("long").alias("crc"))


@query("u16_lists", "SELECT p_partkey, CAST(list_sum(list_transform(range(CAST(floor(length(p_name) / 2) AS INT)), lambda i: ascii(substr(p_name, CAST(2 * i + 1 AS INT), 1)) * 256 + ascii(substr(p_name, CAST(2 * i + 2 AS INT), 1)))) AS BIGINT) AS total FROM part")
def u16_lists(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.aggregate(formats.u16_list(F.col("p_name")), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(
    "unsigned_numbers",
    """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN NULL WHEN 3 THEN CASE WHEN event_id * 1000000 < 4294967296 THEN event_id * 1000000 END END AS n FROM events
    """,
)
def unsigned_numbers(spark, sf_dir):
    said = F.element_at(F.array(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit("\t")), F.concat(F.lit("0x"), F.hex("event_id")), F.concat(F.lit("-"), F.col("event_id").cast("string")), (F.col("event_id") * 1000000).cast("string"), F.lit("0x")), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", formats.unsigned(said).alias("n"))


@query("json_texts", "SELECT event_id, CAST(to_json(props || chr(10) || '\"' || chr(92) || event_type) AS VARCHAR) AS quoted FROM events")
def json_texts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", formats.json_quoted(F.concat("props", F.lit('\n"\\'), "event_type")).alias("quoted"))


@query(
    "trimmed_names",
    """
    SELECT page_id, trim(url || ' ', ' ') AS trimmed, lower(url) = lower(upper(url)) AS same, starts_with(lower(url), 'http') AS web, replace(replace(url, '/', chr(10)), chr(10), chr(92) || 'N') AS marked FROM pages
    """,
)
def trimmed_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.trim_ascii(F.concat(F.lit("\t \0"), url, F.lit(" \r\n"))).alias("trimmed"), text.equals_nocase(url, text.upper_ascii(url)).alias("same"),
        text.starts_nocase(url, F.lit("HTTP")).alias("web"), text.escape_markup(F.regexp_replace(url, "/", "\n")).alias("marked"),
    )


@query(
    "packed_times",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRY_CAST(CAST(2000 + l_partkey % 30 AS VARCHAR) || '-' || lpad(CAST(l_suppkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_partkey % 31 AS VARCHAR), 2, '0') || ' 10:20:30' AS TIMESTAMP) AS stamp FROM lineitem
    """,
)
def packed_times(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    parts = F.array(*[c.cast("int") for c in (2000 + F.col("l_partkey") % 30, F.col("l_suppkey") % 14, F.col("l_partkey") % 31, F.lit(10), F.lit(20), F.lit(30))])
    return table(spark, sf_dir, "lineitem").select(*keys, text.packed_time(parts).alias("stamp"))


@query(
    "selector_constraints",
    """
    SELECT o_orderkey, NOT ((o_custkey % 3 <> o_orderkey % 3) OR (o_custkey % 2 = 0 AND o_orderkey % 5 <> 1)) AS passes FROM orders
    """,
)
def selector_constraints(spark, sf_dir):
    n = lambda c: c.cast("int")
    selected = F.map_filter(F.create_map(F.lit("a"), n(F.col("o_custkey") % 3), F.lit("b"), n(F.col("o_orderkey") % 5)), lambda k, _: (k == "a") | (F.col("o_custkey") % 2 == 0))
    wanted = F.array(F.struct(F.lit("a").alias("name"), n(F.col("o_orderkey") % 3).alias("value")), F.struct(F.lit("b").alias("name"), F.lit(1).alias("value")), F.struct(F.lit("c").alias("name"), F.lit(9).alias("value")))
    return table(spark, sf_dir, "orders").select("o_orderkey", graph.passes_constraints(selected, wanted).alias("passes"))


# files of one kind, built and read back


def _by_user(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("file", F.col("user_id").cast("string"))


@query(
    "wave_files",
    "SELECT CAST(user_id AS VARCHAR) AS file, 1 AS channels, 8000 AS rate, COUNT(*) AS samples, COUNT(*) * 2 AS data_size FROM events GROUP BY 1",
)
def wave_files(spark, sf_dir):
    samples = _by_user(spark, sf_dir).select("file", "event_id", (F.pmod(F.col("event_id"), F.lit(65536)) - 32768).alias("sample"))
    return files.waves(sinks.wave_file(samples, "file", "event_id", "sample", 8000)).select("file", "channels", "rate", "samples", "data_size")


@query(
    "frame_files",
    "SELECT CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no, event_id AS frame_time, octet_length(encode(props)) AS frame_size FROM events",
)
def frame_files(spark, sf_dir):
    built = sinks.frame_file(_by_user(spark, sf_dir).withColumn("payload", F.encode("props", "utf-8")), "file", "event_id", "payload")
    return files.frames(built).select("file", "frame_no", "frame_time", "frame_size")


@query(
    "video_units",
    "SELECT CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS unit_no, CAST(event_id % 32 AS INT) AS unit_type, 1 + octet_length(encode(event_type)) AS unit_size FROM events",
)
def video_units(spark, sf_dir):
    unit = F.concat(F.unhex(F.lpad(F.hex(F.col("event_id") % 32 + 0x60), 2, "0")), F.encode("event_type", "utf-8"))
    built = sinks.joined_file(_by_user(spark, sf_dir).withColumn("payload", F.concat(F.unhex(F.lit("000001")), unit)), "file", "event_id", "payload")
    return files.video_units(built).select("file", "unit_no", "unit_type", "unit_size")


@query(
    "srt_files",
    "SELECT CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS cue_no, event_id * 10 AS start, 1500 AS duration, event_type AS text FROM events",
)
def srt_files(spark, sf_dir):
    rows = _by_user(spark, sf_dir).select("file", "event_id", F.lit(0).alias("language_id"), F.lit(100).alias("time_unit"), F.col("event_id").alias("start"), F.lit(150).alias("duration"), F.col("event_type").alias("text"))
    return files.subtitles(sinks.srt_file(rows, "file", "event_id"), "srt").select("file", "cue_no", "start", "duration", "text")


@query(
    "ass_files",
    "SELECT CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS cue_no, event_id * 10 AS start, 1500 AS duration, event_type || chr(10) || 'more' AS text FROM events",
)
def ass_files(spark, sf_dir):
    start = F.col("event_id") * 10
    line = F.concat(F.lit("Dialogue: 0,"), text.ass_time(start), F.lit(","), text.ass_time(start + 1500), F.lit(r",Default,,0,0,0,,{\i1}"), F.col("event_type"), F.lit("\\Nmore\n"))
    built = sinks.joined_file(_by_user(spark, sf_dir).withColumn("payload", F.encode(line, "utf-8")), "file", "event_id", "payload")
    return files.subtitles(built, "ass").select("file", "cue_no", "start", "duration", "text")


@query(
    "command_files",
    "SELECT CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS command_no, CAST(event_id % 7000 + 1 AS INT) AS code, octet_length(encode(event_type)) AS size FROM events",
)
def command_files(spark, sf_dir):
    head = lambda n, width: F.unhex(F.lpad(F.hex(n), 2 * width, "0"))
    one = F.concat(head(F.col("event_id") % 7000 + 1, 2), head(F.octet_length("event_type").cast("long"), 1), F.encode("event_type", "utf-8"))
    built = sinks.joined_file(_by_user(spark, sf_dir).withColumn("payload", one), "file", "event_id", "payload")
    return files.commands(built).select("file", "command_no", "code", F.octet_length("value").cast("long").alias("size"))


@query(
    "program_files",
    "SELECT CAST(user_id AS VARCHAR) AS file, CAST(192 + event_id % 4 AS INT) AS stream_id, COUNT(*) AS packets, CAST(SUM(octet_length(encode(props))) AS BIGINT) AS payload_bytes FROM events GROUP BY ALL",
)
def program_files(spark, sf_dir):
    rows = _by_user(spark, sf_dir).select("file", "event_id", (F.col("event_id") % 4 + 192).cast("int").alias("stream_id"), F.encode("props", "utf-8").alias("payload"))
    packets = files.program_packets(sinks.program_file(rows, "file", "event_id", "stream_id", "payload"))
    return packets.groupBy("file", "stream_id").agg(F.count("*").alias("packets"), F.sum("payload_size").alias("payload_bytes"))


@query(
    "block_audio",
    "SELECT n_name AS file, CAST(1 + n_nationkey % 2 AS INT) AS channels, 22050 AS rate, 40 + n_nationkey AS samples, 4 * (1 + n_nationkey % 2) * (40 + n_nationkey) // 2 AS pcm_bytes FROM nation",
)
def block_audio(spark, sf_dir):
    def encoded(rows: list[dict]) -> bytes:
        import numpy as np

        samples, channels = 40 + rows[0]["n_nationkey"], 1 + rows[0]["n_nationkey"] % 2
        wave = (8000 * np.sin(np.arange(samples * channels) / 9)).astype(np.int64)
        return adx.encode(wave.reshape(samples, channels), 22050)

    built = sinks.built(table(spark, sf_dir, "nation").withColumnRenamed("n_name", "file"), "file", ["n_nationkey"], ["n_nationkey"], encoded)
    heads = files.audio_headers(built).select("file", "channels", "rate", "samples")
    return heads.join(files.decoded_audio(built).select("file", F.octet_length("pcm").cast("long").alias("pcm_bytes")), "file")


@query("looped_files", "SELECT r_name AS file, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INT) AS segment, n_nationkey % 2 = 1 AS loops, 32 + n_nationkey AS samples FROM nation JOIN region ON n_regionkey = r_regionkey")
def looped_files(spark, sf_dir):
    def segments(rows: list[dict]) -> bytes:
        import numpy as np

        return media.build_segments([(adx.encode(np.zeros((32 + r["n_nationkey"], 1), np.int64), 8000), bool(r["n_nationkey"] % 2)) for r in rows])

    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "file")
    return files.looped_segments(sinks.built(rows, "file", ["n_nationkey"], ["n_nationkey"], segments)).select("file", "segment", "loops", "samples")


@query("element_files", "SELECT CAST(n_regionkey AS VARCHAR) AS file, n_name AS path, n_nationkey % 3 = 0 AS streamed, 100 + n_nationkey AS samples, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE length(n_name) END AS size FROM nation")
def element_files(spark, sf_dir):
    def bank(rows: list[dict]) -> bytes:
        return media.build_elements([{"name": r["n_name"], "data": b"" if r["n_nationkey"] % 3 == 0 else r["n_name"].encode(), "fmt": 0, "nch": 1, "stmflg": int(r["n_nationkey"] % 3 == 0), "sfreq": 8000, "nsmpl": 100 + r["n_nationkey"]} for r in rows])

    rows = table(spark, sf_dir, "nation").withColumn("file", F.col("n_regionkey").cast("string"))
    return files.sound_elements(sinks.built(rows, "file", ["n_nationkey", "n_name"], ["n_nationkey"], bank)).select("file", "path", "streamed", "samples", "size")


@query("transform_headers", "SELECT n_name AS file, CAST(1 + n_nationkey % 8 AS INT) AS channels, 48000 AS rate, 10 + n_nationkey AS frames, (10 + n_nationkey) * 1024 - 128 - n_nationkey AS samples FROM nation")
def transform_headers(spark, sf_dir):
    def header(rows: list[dict]) -> bytes:
        k = rows[0]["n_nationkey"]
        return media.build_transform_header(1 + k % 8, 48000, 10 + k, 128, k, 512)

    built = sinks.built(table(spark, sf_dir, "nation").withColumnRenamed("n_name", "file"), "file", ["n_nationkey"], ["n_nationkey"], header)
    return files.transform_headers(built).select("file", "channels", "rate", "frames", "samples")


@query(
    "table_trees",
    """
    SELECT CAST(r_regionkey AS VARCHAR) AS file, '' AS place, 'Outer' AS table_name, COUNT(*) AS n_rows FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey
    UNION ALL SELECT CAST(n_regionkey AS VARCHAR), '/inner[' || CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS VARCHAR) || ']', 'Inner', n_nationkey % 4 FROM nation
    """,
)
def table_trees(spark, sf_dir):
    from lodestone.codecs import table as tables

    def tree(rows: list[dict]) -> bytes:
        inner = [tables.build(tables.Table("Inner", [tables.Column("n", 0x4)], [[i] for i in range(r["n_nationkey"] % 4)])) for r in rows]
        return tables.build(tables.Table("Outer", [tables.Column("inner", 0xB, 0x50)], [[b] for b in inner]))

    rows = table(spark, sf_dir, "nation").withColumn("file", F.col("n_regionkey").cast("string"))
    return files.nested_tables(sinks.built(rows, "file", ["n_nationkey"], ["n_nationkey"], tree)).select("file", "place", "table_name", "n_rows")


@query(
    "bank_parts",
    """
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS file, event_id, octet_length(encode(props)) AS size, COUNT(*) OVER (PARTITION BY user_id) * 12 + 20 AS head FROM events),
         p AS (SELECT *, CAST(SUM(((size + 31) // 32) * 32) OVER (PARTITION BY file ORDER BY event_id) AS BIGINT) - ((size + 31) // 32) * 32 AS before FROM e)
    SELECT file, CAST(((head + 31) // 32) * 32 + before AS BIGINT) AS file_offset, CAST(size AS BIGINT) AS bytes FROM p UNION ALL SELECT DISTINCT file, 0, CAST(head AS BIGINT) FROM e
    """,
)
def bank_parts(spark, sf_dir):
    rows = _by_user(spark, sf_dir).select("file", "event_id", F.encode("props", "utf-8").alias("payload"))
    return sinks.bank_parts(rows, "file", "event_id", "payload").select("file", "file_offset", F.octet_length("content").cast("long").alias("bytes"))


@query("alignment_by_kind", "SELECT o_orderstatus, o_orderpriority, CASE COUNT(*) WHEN 0 THEN 0 ELSE list_reduce(list(o_custkey * 12), lambda a, b: gcd(a, b)) END AS gcd FROM orders GROUP BY 1, 2")
def alignment_by_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_custkey") * 12).alias("n"))
    return layout.gcd_of(rows, "n", ["o_orderstatus", "o_orderpriority"])


@query(
    "demux_bytes",
    """
    SELECT user_id, CAST(event_id // 4096 AS BIGINT) AS part, md5(string_agg(props, '' ORDER BY event_id)) AS digest FROM events GROUP BY ALL
    """,
)
def demux_bytes(spark, sf_dir):
    from lodestone.operators import stream as streams

    chunks = table(spark, sf_dir, "events").select("user_id", "event_id", F.encode("props", "utf-8").alias("payload"))
    return streams.demux(chunks, chunks, ["user_id"], "event_id", "payload").select("user_id", "part", F.md5("bytes").alias("digest"))


# cue sheets: tables inside a table, read one by one and joined


def _sheets(spark, sf_dir) -> DataFrame:
    def sheet(rows: list[dict]) -> bytes:
        from lodestone.codecs import table as tables

        def inner(name: str, kinds: dict[str, int], cells: list[list]) -> bytes:
            return tables.build(tables.Table(name, [tables.Column(c, k, 0x50) for c, k in kinds.items()], cells))

        keys = [r["n_nationkey"] for r in rows]
        tracks = [b"".join((10 * k + i).to_bytes(2, "big") for i in range(k % 3)) for k in keys]
        parts = {
            "CueTable": inner("Cue", {"CueId": 0x4, "ReferenceType": 0x0, "ReferenceIndex": 0x2}, [[k, k % 4, 0xFFFF if k % 7 == 0 else k] for k in keys]),
            "CueNameTable": inner("CueName", {"CueName": 0xA, "CueIndex": 0x2}, [[r["n_name"], i] for i, r in reversed(list(enumerate(rows)))]),
            "SequenceTable": inner("Sequence", {"NumTracks": 0x2, "TrackIndex": 0xB}, [[k % 3, t] for k, t in zip(keys, tracks)]),
        }
        return tables.build(tables.Table("Header", [tables.Column(n, 0xB, 0x50) for n in parts], [list(parts.values())]))

    rows = table(spark, sf_dir, "nation").withColumn("file", F.col("n_regionkey").cast("string"))
    return checkpointed(sinks.built(rows, "file", ["n_nationkey", "n_name"], ["n_nationkey"], sheet))


CUE_TABLE = {"CueId": "bigint", "ReferenceType": "smallint", "ReferenceIndex": "int"}


@query("sheet_cues", "SELECT CAST(n_regionkey AS VARCHAR) AS file, CAST(n_nationkey AS BIGINT) AS cue_id, n_name AS cue_name, CASE n_nationkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'waveform' WHEN 2 THEN 'synth' ELSE 'sequence' END AS reference, CASE WHEN n_nationkey % 7 <> 0 THEN n_nationkey END AS ref FROM nation")
def sheet_cues(spark, sf_dir):
    sheets = _sheets(spark, sf_dir)
    named = files.sheet_table(sheets, "CueNameTable", {"CueName": "string", "CueIndex": "int"}).select("file", F.col("CueIndex").alias("row_no"), "CueName")
    cues_ = files.sheet_table(sheets, "CueTable", CUE_TABLE).join(named, ["file", "row_no"], "left")
    return cues_.select("file", F.col("CueId").alias("cue_id"), F.col("CueName").alias("cue_name"), formats.reference_name(F.col("ReferenceType")).alias("reference"), F.col("ReferenceIndex").alias("ref"))


@query(
    "sheet_edges",
    """
    WITH n AS (SELECT *, CAST(n_regionkey AS VARCHAR) AS file, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
    SELECT file || '/cue:' || CAST(i AS VARCHAR) AS src, CASE n_nationkey % 4 WHEN 1 THEN 'waveform' WHEN 2 THEN 'synth' ELSE 'sequence' END || ':' || CAST(n_nationkey AS VARCHAR) AS dst, 'reference' AS kind, 0 AS ordinal
    FROM n WHERE n_nationkey % 4 <> 0 AND n_nationkey % 7 <> 0
    UNION ALL SELECT file || '/sequence:' || CAST(i AS VARCHAR), 'track:' || CAST(n_nationkey * 10 + k AS VARCHAR), 'track', CAST(k AS INT) FROM n, range(3) t(k) WHERE k < n_nationkey % 3
    """,
)
def sheet_edges(spark, sf_dir):
    from lodestone.operators import cues

    sheets = _sheets(spark, sf_dir)
    place = lambda kind: F.concat("file", F.lit(f"/{kind}:"), F.col("row_no").cast("string"))
    references = cues.reference_edges(files.sheet_table(sheets, "CueTable", CUE_TABLE), place("cue"), F.col("ReferenceType"), F.col("ReferenceIndex"), "reference")
    sequences = files.sheet_table(sheets, "SequenceTable", {"NumTracks": "int", "TrackIndex": "binary"})
    return references.union(cues.list_edges(sequences, place("sequence"), F.slice(formats.u16_list(F.col("TrackIndex")), F.lit(1), F.col("NumTracks")), "track", "track"))
