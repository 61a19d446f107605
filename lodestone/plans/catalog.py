"""Registry of the queries over the driver's tables, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import names, text
from lodestone.operators import compact, cues, entries, graph, joins, layout, naming, rank, stream
from lodestone.session import checkpointed, table
from lodestone.sources import files, sinks

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "archive_layout",
    """
    SELECT doc_id, n_chars AS size, ((n_chars + 2047) // 2048) * 2048 AS stored,
           CAST(COALESCE(SUM(((n_chars + 2047) // 2048) * 2048) OVER
             (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset
    FROM documents
    """,
)
def archive_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size"))
    sized = docs.withColumn("stored", layout.align_up(F.col("size"), 2048))
    return layout.running_offset(sized, "stored", ["doc_id"], "file_offset")




@query(
    "archive_totals",
    """
    SELECT CAST(SUM(n_chars) AS BIGINT) AS packed, CAST(SUM(n_chars * 2) AS BIGINT) AS unpacked,
           CAST(SUM(((n_chars + 2047) // 2048) * 2048) AS BIGINT) AS aligned, COUNT(DISTINCT source) AS directories
    FROM documents
    """,
)
def archive_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "n_chars", (F.col("n_chars") * 2).alias("extract_size"))
    return entries.archive_totals(docs, "n_chars", "extract_size", "source", 2048)


@query(
    "bank_layout",
    """
    WITH e AS (SELECT p_partkey AS wave_id, p_size * 37 AS size, ((p_size * 37 + 31) // 32) * 32 AS step FROM part),
         l AS (SELECT wave_id, size, step, SUM(step) OVER (ORDER BY wave_id ROWS UNBOUNDED PRECEDING) - step AS rel FROM e)
    SELECT wave_id, CAST(size AS BIGINT) AS size, CAST(64 + rel AS BIGINT) AS file_offset, CAST(64 + rel + size AS BIGINT) AS end_offset,
           CAST(CASE WHEN rel = (SELECT MAX(rel) FROM l) THEN size ELSE step END AS BIGINT) AS stored
    FROM l
    """,
)
def bank_layout(spark, sf_dir):
    waves = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("wave_id"), (F.col("p_size") * 37).cast("long").alias("size"))
    return layout.padded_layout(waves, "size", ["wave_id"], 32, 40)


@query(
    "toc_order",
    """
    SELECT p_partkey, replace(lower(p_name), chr(92), '/') AS sort_path,
           CAST(row_number() OVER (ORDER BY replace(lower(p_name), chr(92), '/'), p_partkey) - 1 AS BIGINT) AS toc_pos
    FROM part
    """,
)
def toc_order(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", entries.path_key(F.col("p_name")).alias("sort_path"))
    return entries.numbered(parts, ["sort_path", "p_partkey"], "toc_pos")


@query(
    "index_override",
    """
    SELECT o_orderkey, COALESCE(c_custkey + 1000000, o_orderkey) AS entry_id
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey
    """,
)
def index_override(spark, sf_dir):
    toc = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("entry_id"))
    index = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") + 1000000).alias("entry_id"))
    return entries.override_ids(toc, index, "o_custkey", "entry_id")[0].select("o_orderkey", "entry_id")


@query("index_dangling", "SELECT c_custkey * 2 AS o_custkey FROM customer WHERE c_custkey * 2 NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def index_dangling(spark, sf_dir):
    toc = table(spark, sf_dir, "orders").select("o_custkey", F.lit(0).alias("entry_id"))
    index = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("o_custkey"), F.lit(0).alias("entry_id"))
    return entries.override_ids(toc, index, "o_custkey", "entry_id")[1].select("o_custkey")


@query(
    "auto_ids",
    """
    WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 + o_orderkey % 7 * 100000 END AS given FROM orders),
         used AS (SELECT DISTINCT given FROM e WHERE given IS NOT NULL),
         free AS (SELECT i, row_number() OVER (ORDER BY i) AS n FROM range(0, (SELECT COUNT(*) * 2 + 10 FROM orders)) t(i) WHERE i NOT IN (SELECT given FROM used)),
         need AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM e WHERE given IS NULL)
    SELECT o_orderkey, given AS entry_id FROM e WHERE given IS NOT NULL
    UNION ALL SELECT o_orderkey, i FROM need JOIN free USING (n)
    """,
)
def auto_ids(spark, sf_dir):
    given = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey div 2 + o_orderkey % 7 * 100000 END")
    listed = table(spark, sf_dir, "orders").select("o_orderkey", given.alias("entry_id"))
    return entries.assign_ids(listed, "entry_id", ["o_orderkey"])


@query("repeated_ids", "SELECT o_custkey, COUNT(*) AS entries FROM orders GROUP BY 1 HAVING COUNT(*) > 1")
def repeated_ids(spark, sf_dir):
    return entries.repeated_ids(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey")


@query("next_id", "SELECT MAX(s_suppkey) + 1 AS next_id FROM supplier")
def next_id(spark, sf_dir):
    return entries.next_id(table(spark, sf_dir, "supplier"), "s_suppkey")


@query(
    "presence_stats",
    """
    WITH s AS (SELECT l_linenumber AS slot, l_orderkey % 5 * 2048 AS off, CAST(l_quantity AS BIGINT) % 4 AS sz FROM lineitem)
    SELECT slot, COUNT(*) FILTER (off <> 0 OR sz <> 0) AS present, MIN(off) FILTER (off <> 0 OR sz <> 0) AS first_offset,
           MAX(off + sz) FILTER (off <> 0 OR sz <> 0) AS payload_end
    FROM s GROUP BY slot
    """,
)
def presence_stats(spark, sf_dir):
    slots = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("slot"), (F.col("l_orderkey") % 5 * 2048).alias("off"), (F.col("l_quantity").cast("long") % 4).alias("sz"))
    return entries.presence(slots, F.col("off"), F.col("sz"), ["slot"])


@query(
    "alignment_gcd",
    "SELECT o_orderpriority, list_reduce(list(DISTINCT o_custkey * 2048), lambda a, b: gcd(a, b)) AS gcd FROM orders GROUP BY 1",
)
def alignment_gcd(spark, sf_dir):
    offsets = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") * 2048).alias("off"))
    return layout.gcd_of(offsets, "off", ["o_orderpriority"])


@query(
    "entries_edited",
    """
    WITH e AS (SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS pos FROM part),
         m AS (SELECT p_partkey, CASE WHEN pos = 7 THEN 40 WHEN pos BETWEEN 8 AND 40 THEN pos - 1 ELSE pos END AS pos FROM e)
    SELECT p_partkey, pos - (CASE WHEN pos > 3 THEN 1 ELSE 0 END) - (CASE WHEN pos > 11 THEN 1 ELSE 0 END) AS pos FROM m WHERE pos NOT IN (3, 11)
    """,
)
def entries_edited(spark, sf_dir):
    listed = entries.numbered(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"])
    return entries.remove_entries(entries.move_entry(listed, 7, 40), [3, 11])


@query(
    "entries_replaced",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'R' || CAST(o_custkey AS VARCHAR) ELSE o_orderstatus END AS o_orderstatus FROM orders
    """,
)
def entries_replaced(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    changes = orders.filter("o_orderkey % 4 = 0").select("o_orderkey", F.concat(F.lit("R"), F.col("o_custkey").cast("string")).alias("o_orderstatus"))
    return entries.replace_values(orders.select("o_orderkey", "o_orderstatus"), changes, "o_orderkey", "o_orderstatus")


@query(
    "dedupe_names",
    """
    SELECT o_orderkey, o_clerk_like AS name, CASE WHEN n = 0 THEN o_clerk_like ELSE o_clerk_like || '_' || CAST(n AS VARCHAR) END AS unique_name
    FROM (SELECT o_orderkey, 'cust' || CAST(o_custkey AS VARCHAR) AS o_clerk_like, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
    """,
)
def dedupe_names(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("name"))
    return naming.unique_names(named, "name", ["o_orderkey"])


@query(
    "unique_names",
    """
    WITH e AS MATERIALIZED (SELECT o_orderkey, 'f' || CAST(o_custkey % 40 AS VARCHAR) || CASE WHEN o_orderkey % 11 = 0 THEN '_' || CAST(o_orderkey % 300 AS VARCHAR) ELSE '' END AS name FROM orders),
         f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o_orderkey) - 1 AS k FROM e),
         c AS (SELECT name, MAX(k) + 300 AS most FROM f GROUP BY 1),
         free AS (SELECT c.name, i, row_number() OVER (PARTITION BY c.name ORDER BY i) AS k FROM c, range(1, (SELECT MAX(most) FROM c) + 1) t(i) WHERE i <= most AND c.name || '_' || CAST(i AS VARCHAR) NOT IN (SELECT name FROM e))
    SELECT o_orderkey, f.name, CASE WHEN f.k = 0 THEN f.name ELSE f.name || '_' || CAST(i AS VARCHAR) END AS unique_name FROM f LEFT JOIN free ON free.name = f.name AND free.k = f.k
    """,
)
def unique_names(spark, sf_dir):
    """Entries whose own names look like numbered ones."""
    number = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("_"), (F.col("o_orderkey") % 300).cast("string"))).otherwise("")
    named = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string"), number).alias("name"))
    return naming.unique_names(named, "name", ["o_orderkey"])


@query(
    "unique_paths",
    """
    WITH e AS MATERIALIZED (SELECT p_partkey, p_size % 5 AS ident, CASE WHEN p_partkey % 7 = 0 THEN 'd/' || p_brand || '_' || CAST(p_partkey % 6 AS VARCHAR) ELSE 'd/' || p_brand END AS stem FROM part),
         a AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS n FROM e),
         b AS (SELECT *, stem || '_' || CAST(ident AS VARCHAR) AS t FROM a WHERE n > 1),
         b1 AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p_partkey) AS m FROM b WHERE t NOT IN (SELECT stem FROM e)),
         w AS (SELECT p_partkey, t FROM b1 WHERE m = 1),
         c AS (SELECT p_partkey, stem || '_' || CAST(ident AS VARCHAR) || '_' || CAST(p_partkey AS VARCHAR) AS t FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM w)),
         taken AS (SELECT stem AS t FROM e UNION SELECT t FROM w)
    SELECT p_partkey, stem || '.bin' AS safe_path FROM a WHERE n = 1 UNION ALL SELECT p_partkey, t || '.bin' FROM w
    UNION ALL SELECT p_partkey, t || CASE WHEN t IN (SELECT t FROM taken) THEN '_1' ELSE '' END || '.bin' FROM c
    """,
)
def unique_paths(spark, sf_dir):
    """Paths of which some look as if an id had been added already."""
    own = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("_"), (F.col("p_partkey") % 6).cast("string"))).otherwise("")
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("ident"), F.concat(F.lit("d/"), "p_brand", own, F.lit(".bin")).alias("path"))
    return naming.unique_paths(parts, "path", "ident", "p_partkey").select("p_partkey", "safe_path")


@query(
    "compact_profile",
    """
    SELECT 'l_returnflag' AS column_name, CASE WHEN COUNT(l_returnflag) = 0 THEN 'name' WHEN COUNT(*) > 1 AND COUNT(DISTINCT l_returnflag) = 1 AND COUNT(l_returnflag) = COUNT(*) THEN 'default' ELSE 'row' END AS storage FROM lineitem
    UNION ALL SELECT 'constant', 'default' UNION ALL SELECT 'missing', 'name' UNION ALL SELECT 'l_linenumber', 'row'
    """,
)
def compact_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.lit(5).alias("constant"), F.lit(None).cast("int").alias("missing"), "l_linenumber")
    return compact.storage_profile(rows)


@query(
    "dict_offsets",
    """
    WITH f AS (SELECT c_mktsegment AS value, MIN(c_custkey) AS first FROM customer GROUP BY 1)
    SELECT value, CAST(COALESCE(SUM(octet_length(encode(value)) + 1) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS string_offset FROM f
    """,
)
def dict_offsets(spark, sf_dir):
    return compact.dictionary(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey"])


@query(
    "demux_sizes",
    """
    SELECT event_type, COUNT(*) AS chunks, CAST(SUM(length(props)) AS BIGINT) AS payload_bytes FROM events
    WHERE event_type IN (SELECT DISTINCT event_type FROM events WHERE user_id < 50) GROUP BY 1
    """,
)
def demux_sizes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    directory = events.filter("user_id < 50").select("event_type").distinct()
    return stream.stream_totals(events.join(directory, "event_type", "left_semi"), ["event_type"], F.length("props").cast("long"))


@query(
    "demux_parts",
    """
    SELECT user_id, CAST(event_id // 4096 AS BIGINT) AS part, md5(string_agg(event_type, '' ORDER BY event_id)) AS digest FROM events GROUP BY 1, 2
    """,
)
def demux_parts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    parts = stream.demux(events, events.select("user_id"), ["user_id"], "event_id", "event_type")
    return parts.select("user_id", "part", F.md5("bytes").alias("digest"))


@query(
    "mux_order",
    "SELECT event_id, CAST(row_number() OVER (ORDER BY event_type, ts, user_id, event_id) - 1 AS BIGINT) AS mux_pos FROM events",
)
def mux_order(spark, sf_dir):
    chunks = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id")
    return stream.mux_order(chunks, ["event_type", "ts", "user_id", "event_id"]).select("event_id", "mux_pos")


@query(
    "merge_two",
    """
    WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events)),
         m AS (SELECT event_id, ts, CASE WHEN n = 1 THEN 0 ELSE 1 END AS is_second FROM events JOIN k USING (event_type) WHERE n <= 2)
    SELECT event_id, is_second, CAST(row_number() OVER (ORDER BY ts, is_second, event_id) - 1 AS BIGINT) AS mux_pos FROM m
    """,
)
def merge_two(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    a, b = (events.filter(F.col("event_type") == k) for k in (kinds + [None, None])[:2])
    return stream.merge_two(a, b, "ts", "event_id").select("event_id", "is_second", "mux_pos")


@query(
    "seek_index",
    """
    SELECT event_id, byte_offset FROM (SELECT event_id, user_id, CAST(COALESCE(SUM(length(props)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM events)
    WHERE user_id % 10 = 0
    """,
)
def seek_index(spark, sf_dir):
    chunks = table(spark, sf_dir, "events").select("event_id", "user_id", F.length("props").alias("n"))
    return layout.seek_index(chunks, "n", ["event_id"], F.col("user_id") % 10 == 0).select("event_id", "byte_offset")


@query(
    "head_bytes",
    """
    SELECT p_partkey, left(p_name, CAST(least(length(p_name), 5000 - before) AS BIGINT)) AS head
    FROM (SELECT *, COALESCE(SUM(length(p_name)) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM part) WHERE before < 5000
    """,
)
def head_bytes(spark, sf_dir):
    return stream.head_bytes(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"], 5000).select("p_partkey", "head")


@query(
    "sample_frames",
    """
    WITH f AS (SELECT user_id, event_id, COUNT(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
    SELECT user_id, event_id FROM f WHERE i % greatest(1, n // 8) = 0 AND i < greatest(1, n // 8) * 8
    """,
)
def sample_frames(spark, sf_dir):
    return stream.sample_frames(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 8)


@query(
    "ticks",
    """
    SELECT event_id, (ms * 600 + 500) // 1000 AS ticks, (((ms * 600 + 500) // 1000) * 1000 + 300) // 600 AS back_ms
    FROM (SELECT event_id, (epoch_us(ts) // 1000) % 86400000 AS ms FROM events)
    """,
)
def ticks(spark, sf_dir):
    ms = F.expr("(unix_micros(cast(ts as timestamp)) div 1000) % 86400000")
    counted = table(spark, sf_dir, "events").select("event_id", stream.to_ticks(ms, 600).alias("ticks"))
    return counted.withColumn("back_ms", stream.to_millis(F.col("ticks"), 600))


@query(
    "srt_time",
    """
    SELECT event_id, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS srt,
           CAST(ms // 3600000 AS VARCHAR) || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms // 10 % 100 AS VARCHAR), 2, '0') AS ass, ms AS parsed
    FROM (SELECT event_id, (epoch_us(ts) // 1000) % 86400000 AS ms FROM events)
    """,
)
def srt_time(spark, sf_dir):
    ms = F.expr("(unix_micros(cast(ts as timestamp)) div 1000) % 86400000")
    timed = table(spark, sf_dir, "events").select("event_id", ms.alias("ms"))
    return timed.select("event_id", text.srt_time(F.col("ms")).alias("srt"), text.ass_time(F.col("ms")).alias("ass"), text.parse_time(text.srt_time(F.col("ms"))).alias("parsed"))


@query(
    "graph_distance",
    """
    WITH RECURSIVE e AS (
      SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS src, 'n' || CAST(n_nationkey AS VARCHAR) AS dst FROM region JOIN nation ON r_regionkey = n_regionkey
      UNION ALL SELECT 'n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR) FROM supplier),
    d AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS root, 'r' || CAST(r_regionkey AS VARCHAR) AS node, 0 AS distance FROM region
      UNION SELECT root, dst, distance + 1 FROM d JOIN e ON d.node = e.src)
    SELECT root, node, MIN(distance) AS distance FROM d GROUP BY 1, 2
    """,
)
def graph_distance(spark, sf_dir):
    return graph.distances(_region_edges(spark, sf_dir), table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root")))


def _region_edges(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations = table(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    return nations.union(table(spark, sf_dir, "supplier").select(key("n", "s_nationkey").alias("src"), key("s", "s_suppkey").alias("dst")))


@query(
    "preferred_names",
    """
    SELECT 's' || CAST(s_suppkey AS VARCHAR) AS node, n_name AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
def preferred_names(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.select(key("n", "n_nationkey").alias("root"), F.col("n_name").alias("name")).union(region.select(key("r", "r_regionkey"), "r_name"))
    reach = graph.distances(_region_edges(spark, sf_dir), names.select("root"))
    return graph.nearest_names(reach.filter("distance > 0"), names).filter(F.startswith("node", F.lit("s")))


@query("cycles", "SELECT CAST(c_custkey AS BIGINT) AS node FROM customer")
def cycles(spark, sf_dir):
    """One ring of all customers, with the suppliers as tails that lead into it and out of it."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("src"))
    ends = keys.agg(F.min("src").alias("low"), F.max("src").alias("high"))
    ring = keys.join(F.broadcast(ends)).select("src", F.when(F.col("src") == F.col("high"), F.col("low")).otherwise(F.col("src") + 1).alias("dst"))
    k = F.col("s_suppkey").cast("long")
    tails = table(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, -k).otherwise(k), F.when(k % 2 == 0, k).otherwise(-k))
    return graph.on_cycles(ring.union(tails))


@query(
    "strong_components",
    """
    WITH RECURSIVE k AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer), e AS MATERIALIZED (
      SELECT k AS src, k - k % 50 + (k * 7 + 3) % 50 AS dst FROM k UNION SELECT k, k - k % 50 + (k * k + 1) % 50 FROM k WHERE k % 3 = 0 UNION SELECT k, k + 50 FROM k WHERE k % 100 = 0),
    r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src WHERE e.dst // 50 = r.a // 50),
    n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
    SELECT node, least(node, (SELECT MIN(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = node)) AS component FROM n
    """,
)
def strong_components(spark, sf_dir):
    """Blocks of fifty customers, each a graph of its own kind, with edges from one block to the next."""
    k = F.col("c_custkey").cast("long")
    keys = table(spark, sf_dir, "customer").select(k.alias("k"))
    block = F.col("k") - F.pmod("k", F.lit(50))
    first = keys.select(F.col("k").alias("src"), (block + (F.col("k") * 7 + 3) % 50).alias("dst"))
    second = keys.filter("k % 3 = 0").select("k", block + (F.col("k") * F.col("k") + 1) % 50)
    return graph.strong_components(first.union(second).union(keys.filter("k % 100 = 0").select("k", F.col("k") + 50)))


@query("customer_cycles", "SELECT CAST(c_custkey AS BIGINT) AS node FROM customer WHERE c_custkey < (SELECT COUNT(*) // 7 * 7 FROM customer)")
def customer_cycles(spark, sf_dir):
    key = F.col("c_custkey").cast("long")
    return graph.on_cycles(table(spark, sf_dir, "customer").select(key.alias("src"), (key - F.pmod(key, F.lit(7)) + F.pmod(key + 1, F.lit(7))).alias("dst")))


@query(
    "subtree_totals",
    """
    SELECT directory, COUNT(*) AS entries, CAST(SUM(n_chars) AS BIGINT) AS bytes FROM
      (SELECT '' AS directory, n_chars FROM documents UNION ALL SELECT lang, n_chars FROM documents UNION ALL SELECT lang || '/' || source, n_chars FROM documents) GROUP BY 1
    """,
)
def subtree_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), "n_chars")
    return graph.subtree_totals(docs, "path", "n_chars")


@query("signature_dedupe", "SELECT md5(text) AS signature, MIN(doc_id) AS first, COUNT(*) AS members FROM documents GROUP BY 1")
def signature_dedupe(spark, sf_dir):
    return rank.dedupe_by_signature(table(spark, sf_dir, "documents"), F.md5("text"), "doc_id")


@query(
    "top_candidates",
    """
    SELECT l_partkey AS key, COUNT(DISTINCT l_suppkey) AS sources, round(SUM(l_quantity), 2) AS score, COUNT(*) AS evidence FROM lineitem GROUP BY 1
    ORDER BY sources DESC, score DESC, evidence DESC, key LIMIT 10
    """,
)
def top_candidates(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(
        F.countDistinct("l_suppkey").alias("sources"), F.round(F.sum("l_quantity"), 2).alias("score"), F.count("*").alias("evidence")
    )
    return rank.top(scored, [F.desc("sources"), F.desc("score"), F.desc("evidence"), F.asc("key")])


@query(
    "top_each",
    """
    SELECT c_nationkey, c_custkey, place FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS place FROM customer) WHERE place <= 10
    """,
)
def top_each(spark, sf_dir):
    return rank.top_each(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")]).drop("c_acctbal")


@query(
    "weighted_merge",
    """
    SELECT l_suppkey, round(SUM(l_discount * l_quantity) / SUM(l_quantity), 6) AS score, CAST(SUM(l_quantity) AS BIGINT) AS support FROM lineitem GROUP BY 1
    """,
)
def weighted_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_discount").alias("score"), F.col("l_quantity").alias("support"))
    return rank.merge_scores(rows, ["l_suppkey"], "score", "support").select("l_suppkey", F.round("score", 6).alias("score"), F.col("support").cast("long").alias("support"))


@query(
    "consensus",
    """
    SELECT o_orderkey & 255 AS shared_bits, COUNT(DISTINCT o_custkey) AS sources, COUNT(*) AS evidence, MAX(o_totalprice) AS best_score FROM orders GROUP BY 1
    """,
)
def consensus(spark, sf_dir):
    return rank.consensus(table(spark, sf_dir, "orders"), "o_orderkey", 255, "o_custkey", "o_totalprice")


@query(
    "histogram",
    """
    SELECT CAST((i - 1) % 32 AS INT) AS slot, CAST(ascii(substr(p_name, CAST(i AS BIGINT), 1)) AS INT) AS byte, COUNT(*) AS n
    FROM (SELECT p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part) GROUP BY 1, 2
    """,
)
def histogram(spark, sf_dir):
    return rank.byte_histogram(table(spark, sf_dir, "part"), "p_name", 32)


@query(
    "mix_saturate",
    """
    SELECT user_id, greatest(-32768, least(32767, CAST(SUM(CAST(floor(value * 100) AS BIGINT)) AS BIGINT))) AS mixed FROM events GROUP BY 1
    """,
)
def mix_saturate(spark, sf_dir):
    return stream.mix(table(spark, sf_dir, "events"), ["user_id"], F.floor(F.col("value") * 100).cast("long"))


@query(
    "mix_clips",
    """
    WITH s AS (SELECT event_type, event_id % 400 + i AS place, CAST(floor(value * 100) AS BIGINT) * (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * (i + 1) AS sample FROM events, range(0, 6) t(i))
    SELECT event_type, place, greatest(-32768, least(32767, CAST(SUM(sample) AS BIGINT))) AS mixed FROM s GROUP BY 1, 2
    """,
)
def mix_clips(spark, sf_dir):
    """Every event as a clip of six samples, laid over those of its type."""
    loud = F.floor(F.col("value") * 100).cast("long")
    samples = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: loud * F.when(i % 2 == 0, 1).otherwise(-1) * (i + 1))
    return stream.mix_clips(table(spark, sf_dir, "events"), ["event_type"], F.col("event_id") % 400, samples)


@query("loop_expand", "SELECT n_nationkey, CAST(unnest(range(0, n_regionkey + 1)) AS INT) AS pass_no FROM nation")
def loop_expand(spark, sf_dir):
    return stream.expand_loops(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("n_regionkey")).drop("n_regionkey")


@query(
    "checksum769",
    """
    SELECT n_name, xor(4294967295, CASE WHEN c = 0 THEN 1 ELSE c END) AS checksum FROM
     (SELECT n_name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(n_name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: (a * 769 + b) & 4294967295) AS c FROM nation)
    """,
)
def checksum769(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", text.checksum769(F.col("n_name")).alias("checksum"))


@query(
    "sniff",
    """
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'utf' WHEN page_id % 4 = 1 THEN 'awb' WHEN page_id % 4 = 2 THEN 'wav' END AS kind FROM pages
    """,
)
def sniff(spark, sf_dir):
    head = F.when(F.col("page_id") % 4 == 0, F.lit("@UTF")).when(F.col("page_id") % 4 == 1, F.lit("AFS2")).when(F.col("page_id") % 4 == 2, F.lit("RIFF")).otherwise(F.substring("html", 1, 4))
    return table(spark, sf_dir, "pages").select("page_id", text.sniff(F.hex(head.cast("binary"))).alias("kind"))


@query("search_filter", "SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'tion') AND lang IN ('en', 'fr')")
def search_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.filter(F.col("lang").isin("en", "fr") & F.contains(text.lower_ascii(F.col("text")), F.lit("tion"))).select("doc_id")


@query("leading_number", "SELECT page_id, TRY_CAST(NULLIF(regexp_extract(CAST(page_id % 7 AS VARCHAR) || ' ' || url, '^\\s*(\\d{1,18})', 1), '') AS BIGINT) AS number FROM pages")
def leading_number(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.leading_number(F.concat((F.col("page_id") % 7).cast("string"), F.lit(" "), F.col("url"))).alias("number"))


@query("selector_options", "SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id % 10)), ',') AS options FROM events GROUP BY 1")
def selector_options(spark, sf_dir):
    options = graph.selector_options(table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("v")), "event_type", "v")
    return options.select("event_type", F.array_join(F.transform("options", lambda x: x.cast("string")), ",").alias("options"))


@query(
    "cross_checks",
    """
    WITH names AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS port, c_name AS name FROM customer),
         items AS (SELECT o_custkey AS k, CAST(o_orderkey % 25 AS INT) AS port FROM orders)
    SELECT k, port, name FROM items JOIN names USING (k, port) UNION SELECT items.k, items.port, name FROM items JOIN names ON items.k = names.k AND names.port IS NULL
    """,
)
def cross_checks(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("port"), F.col("c_name").alias("name"))
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 25).cast("int").alias("port"))
    return graph.wildcard_names(items, names, ["k"], "port", "name").select("k", "port", "name")


@query(
    "segment_ranges",
    """
    SELECT l_orderkey, l_linenumber, CAST(e - q AS BIGINT) AS range_start, CAST(e AS BIGINT) AS range_end FROM
     (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, SUM(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS e FROM lineitem)
    """,
)
def segment_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return layout.segment_ranges(rows, "q", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "range_start", "range_end")


@query(
    "timeline",
    """
    SELECT event_id, epoch_us(ts) - MIN(epoch_us(ts)) OVER (PARTITION BY user_id) AS rel_time, epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_gap FROM events
    """,
)
def timeline(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    return stream.normalised_timeline(frames, ["user_id"], ["us", "event_id"], "us").select("event_id", "rel_time", "frame_gap")


@query(
    "safe_names",
    """
    SELECT page_id, CASE WHEN rtrim(regexp_replace(url, '[\\x00-\\x1f<>:"/\\\\|?*]', '_', 'g'), ' .') = '' THEN 'unnamed' ELSE rtrim(regexp_replace(url, '[\\x00-\\x1f<>:"/\\\\|?*]', '_', 'g'), ' .') END AS name,
           regexp_extract(url, '([^/]*)$', 1) AS base FROM pages
    """,
)
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"), text.base_name(F.col("url")).alias("base"))


ARCHIVE_SQL = """
    SELECT lang || '/' || source AS file, {path} AS path, CAST(octet_length(encode(text)) AS BIGINT) AS file_size, md5(text) AS digest FROM documents
"""


def _archived(spark, sf_dir):
    file = F.concat_ws("/", "lang", "source")
    return table(spark, sf_dir, "documents").select(file.alias("file"), "doc_id", F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.encode("text", "utf-8").alias("payload"))


def _stored(docs, kind, order, name=None):
    folder = sinks.save_parts(sinks.archive_parts(docs, "file", kind, order, "payload", name))
    return files.stored_entries(folder, docs.select("file", sinks.stored_as(F.col("file")).alias("stored")).distinct(), kind)


def _listed(found):
    return found.select("file", "path", "file_size", F.md5("payload").alias("digest"))


@query("package_files", ARCHIVE_SQL.format(path="source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0')"))
def package_files(spark, sf_dir):
    return _listed(_stored(_archived(spark, sf_dir), "cpk", "path"))


@query("slot_files", ARCHIVE_SQL.format(path="lpad(CAST(doc_id AS VARCHAR), 9, '0')"))
def slot_files(spark, sf_dir):
    docs = _archived(spark, sf_dir).withColumn("path", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return _listed(_stored(docs, "afs", "doc_id", "path"))


@query("bank_files", ARCHIVE_SQL.format(path="CAST(doc_id AS VARCHAR)"))
def bank_files(spark, sf_dir):
    found = _stored(_archived(spark, sf_dir), "awb", "doc_id")
    return _listed(found.withColumn("path", F.col("entry_id").cast("string")))


@query("pair_files", ARCHIVE_SQL.format(path="CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS VARCHAR)"))
def pair_files(spark, sf_dir):
    found = _stored(_archived(spark, sf_dir), "acx", "doc_id")
    return _listed(found.withColumn("path", F.col("pos").cast("string")))


@query(
    "typed_tables",
    "SELECT CAST(c_nationkey AS VARCHAR) AS file, c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
)
def typed_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("file", F.col("c_nationkey").cast("string"))
    built = sinks.typed_table(rows, "file", "c_custkey", {"c_custkey": 0x7, "c_name": 0xA, "c_acctbal": 0x9, "c_mktsegment": 0xA})
    return files.table_rows(built).drop("row_no")


@query(
    "table_storage",
    """
    SELECT CAST(n_regionkey AS VARCHAR) AS file, c AS column_name, CASE WHEN c = 'n_regionkey' THEN 48 WHEN c = 'nothing' THEN 16 ELSE 80 END AS flags, COUNT(*) AS n_rows
    FROM nation, (VALUES ('n_nationkey'), ('n_regionkey'), ('n_name'), ('nothing')) t(c) GROUP BY ALL
    """,
)
def table_storage(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("file", F.col("n_regionkey").cast("string")).withColumn("nothing", F.lit(None).cast("int"))
    built = sinks.typed_table(rows, "file", "n_nationkey", {"n_nationkey": 0x5, "n_regionkey": 0x5, "n_name": 0xA, "nothing": 0x5})
    return files.table_columns(built).select("file", "column_name", "flags", "n_rows")


@query("compressed_payloads", "SELECT page_id, CAST(length(html) AS INT) AS chars, md5(html) AS digest FROM pages")
def compressed_payloads(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "utf-8").alias("raw"))
    back = sinks.decompressed(sinks.compressed(pages, "raw", "packed"), "packed", "back")
    return back.select("page_id", F.length(F.decode("back", "utf-8")).alias("chars"), F.md5("back").alias("digest"))


@query("masked_payloads", "SELECT page_id, md5(html) AS digest FROM pages")
def masked_payloads(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "utf-8").alias("raw"))
    return sinks.masked(sinks.masked(pages, "raw", "hidden"), "hidden", "back").select("page_id", F.md5("back").alias("digest"))


@query(
    "subtitle_files",
    """
    SELECT CAST(user_id AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS cue_no, event_id % 5 AS language_id, event_id * 7 % 100000 AS start, event_type AS text FROM events
    """,
)
def subtitle_files(spark, sf_dir):
    cues = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("file"), "event_id", (F.col("event_id") % 5).alias("language_id"), F.lit(1000).alias("time_unit"), (F.col("event_id") * 7 % 100000).alias("start"), F.lit(500).alias("duration"), F.col("event_type").alias("text")
    )
    return files.subtitles(sinks.subtitle_file(cues, "file", "event_id")).select("file", "cue_no", "language_id", "start", "text")


@query(
    "stream_files",
    """
    SELECT CAST(user_id AS VARCHAR) AS file, '@SFA' AS magic, CAST(event_id % 3 AS INT) AS channel, COUNT(*) AS chunks, CAST(SUM(octet_length(encode(props))) AS BIGINT) AS payload_bytes FROM events GROUP BY ALL
    """,
)
def stream_files(spark, sf_dir):
    chunks = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("file"), "event_id", F.lit("@SFA").alias("magic"), (F.col("event_id") % 3).cast("int").alias("channel"), (F.col("event_id") % 1000).alias("frame_time"), F.encode("props", "utf-8").alias("payload")
    )
    built = checkpointed(sinks.stream_file(chunks, "file", ["frame_time", "event_id"]))
    known = files.stream_directory(built).filter("row > 0").select("file", F.col("stream_id").alias("magic"), "channel")
    found = files.stream_chunks(built, payload=False).filter("payload_type = 'stream'")
    return stream.stream_totals(found.join(known, ["file", "magic", "channel"], "left_semi"), ["file", "magic", "channel"], F.col("payload_size"))


@query(
    "cue_edges",
    """
    SELECT 'cue:' || CAST(o_orderkey AS VARCHAR) AS src,
           CASE o_orderkey % 10 WHEN 1 THEN 'waveform' WHEN 2 THEN 'synth' WHEN 3 THEN 'sequence' WHEN 5 THEN 'outside_link' WHEN 6 THEN 'synth' WHEN 7 THEN 'sequence' WHEN 8 THEN 'block_sequence' WHEN 9 THEN 'block_sequence'
             ELSE 'unknown-' || CAST(o_orderkey % 10 AS VARCHAR) END || ':' || CAST(o_custkey AS VARCHAR) AS dst,
           CASE WHEN o_orderkey % 10 = 5 THEN 'outside_link' ELSE 'reference' END AS kind, 0 AS ordinal
    FROM orders WHERE o_orderkey % 10 <> 0 AND o_custkey <> 65535
    """,
)
def cue_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return cues.reference_edges(rows, cues.node("cue", F.col("o_orderkey")), F.col("o_orderkey") % 10, F.col("o_custkey"), "reference")


@query(
    "track_edges",
    """
    SELECT 'sequence:' || CAST(n_nationkey AS VARCHAR) AS src, 'track:' || CAST(n_nationkey * 3 + i AS VARCHAR) AS dst, 'track' AS kind, CAST(i AS INT) AS ordinal
    FROM nation, range(0, 10) t(i) WHERE i < n_regionkey
    """,
)
def track_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return cues.range_edges(rows, cues.node("sequence", F.col("n_nationkey")), F.col("n_nationkey") * 3, F.col("n_regionkey"), "track", "track")


@query(
    "choice_paths",
    """
    WITH o AS (SELECT DISTINCT user_id AS cue, event_type AS selector, event_id % 3 AS v FROM events WHERE event_type IN ('click', 'view', 'purchase')),
         n AS (SELECT cue, selector, COUNT(*) AS c FROM o GROUP BY 1, 2)
    SELECT cue, CAST(product(c) AS BIGINT) AS paths FROM n GROUP BY 1
    """,
)
def choice_paths(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view", "purchase"))
    options = events.select(F.col("user_id").alias("cue"), F.col("event_type").alias("selector"), (F.col("event_id") % 3).alias("v")).distinct()
    return cues.choice_paths(options, "cue", "selector", "v").groupBy("cue").agg(F.count("*").alias("paths"))


@query(
    "plan_names",
    """
    SELECT o_orderkey, lpad(CAST(n AS VARCHAR), 4, '0') || '_' || o_orderstatus || CASE WHEN c > 1 THEN '_variant-' || CAST(n AS VARCHAR) ELSE '' END || '.wav' AS file_name
    FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, COUNT(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
    """,
)
def plan_names(spark, sf_dir):
    plans = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return cues.plan_names(plans, "o_custkey", "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "file_name")


@query(
    "command_schedule",
    """
    SELECT event_id, CAST(COALESCE(SUM(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_time FROM events
    """,
)
def command_schedule(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7).alias("wait"))
    return cues.scheduled(rows, ["user_id"], "event_id", F.col("wait")).select("event_id", F.col("at").alias("at_time"))


@query(
    "conflict_paths",
    """
    WITH e AS (SELECT p_partkey, 'd/' || p_brand || '.bin' AS path, p_size AS ident, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
         m AS (SELECT *, row_number() OVER (PARTITION BY path, ident, n > 1 ORDER BY p_partkey) AS m FROM e)
    SELECT p_partkey, CASE WHEN n = 1 THEN path WHEN m = 1 THEN replace(path, '.bin', '_' || CAST(ident AS VARCHAR) || '.bin')
           ELSE replace(path, '.bin', '_' || CAST(ident AS VARCHAR) || '_' || CAST(p_partkey AS VARCHAR) || '.bin') END AS safe_path FROM m
    """,
)
def conflict_paths(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("d/"), "p_brand", F.lit(".bin")))
    return naming.unique_paths(parts, "path", "p_size", "p_partkey").select("p_partkey", "safe_path")


@query("last_header", "SELECT c_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def last_header(spark, sf_dir):
    streams = table(spark, sf_dir, "customer").select("c_custkey")
    headers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return joins.last_header(streams, headers, ["c_custkey"], "o_orderkey", "o_orderstatus")


@query("first_match", "SELECT c_custkey, MIN(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def first_match(spark, sf_dir):
    entries_ = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.first_match(table(spark, sf_dir, "customer").select("c_custkey"), entries_, "c_custkey", "o_orderkey")


@query(
    "bank_choice",
    """
    WITH e AS (SELECT 'memory' AS bank, s_suppkey AS id, s_name AS entry FROM supplier UNION ALL SELECT 'stream', c_custkey, c_name FROM customer)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, entry FROM lineitem LEFT JOIN e ON bank = CASE WHEN l_linenumber > 3 THEN 'stream' ELSE 'memory' END AND id = CASE WHEN l_linenumber > 3 THEN l_partkey ELSE l_suppkey END
    """,
)
def bank_choice(spark, sf_dir):
    memory = table(spark, sf_dir, "supplier").select(F.lit("memory").alias("bank"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("entry"))
    stream_ = table(spark, sf_dir, "customer").select(F.lit("stream").alias("bank"), F.col("c_custkey").alias("id"), F.col("c_name").alias("entry"))
    waves = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.by_bank(waves, memory.union(stream_), F.col("l_linenumber") > 3, "l_suppkey", "l_partkey", "bank", "id").drop("bank", "id")


@query(
    "companions",
    """
    SELECT 'f' || CAST(p_partkey AS VARCHAR) || '.acb' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'f' || CAST(p_partkey AS VARCHAR) || '.awb' END AS companion FROM part
    """,
)
def companions(spark, sf_dir):
    stem = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    parts = table(spark, sf_dir, "part")
    listed = parts.select(F.concat(stem, F.lit(".acb")).alias("path")).union(parts.filter("p_partkey % 3 = 0").select(F.concat(stem, F.lit(".awb"))))
    return joins.companions(listed, "path", ".acb", ".awb")


@query(
    "resolved_names",
    """
    SELECT o_orderkey, n_name, k <> 3 AND n_name IS NULL AS dangling FROM (SELECT o_orderkey, o_orderkey % 30 AS k FROM orders) LEFT JOIN nation ON n_nationkey = k
    """,
)
def resolved_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 30).alias("k"))
    return joins.resolve_index(rows, "k", table(spark, sf_dir, "nation"), "n_nationkey", "n_name", 3).select("o_orderkey", "n_name", "dangling")


@query(
    "append_absent",
    """
    SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, MIN(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1
    """,
)
def append_absent(spark, sf_dir):
    listed = joins.append_absent(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", "kinds")
    return listed.select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("disagreeing", "SELECT o_custkey, MIN(o_orderstatus) AS least_o_orderstatus, MAX(o_orderstatus) AS most_o_orderstatus FROM orders GROUP BY 1 HAVING MIN(o_orderstatus) <> MAX(o_orderstatus)")
def disagreeing(spark, sf_dir):
    return joins.disagreeing(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), ["o_custkey"], ["o_orderstatus"])


@query("inferred_lengths", "SELECT user_id, MAX(event_id + length(props)) AS inferred FROM events GROUP BY 1")
def inferred_lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.length("props").cast("long").alias("n"))
    return joins.inferred_lengths(rows, ["user_id"], "event_id", "n")


@query("clock_90k", "SELECT event_id, CAST(round(event_id * 0.125 * 90000) AS BIGINT) AS scr FROM events")
def clock_90k(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", stream.clock_90k(F.col("event_id") * F.lit(0.125)).alias("scr"))


@query(
    "lookup_paths",
    """
    SELECT page_id, translate(trim(regexp_replace(replace(url, chr(92), '/'), '/+', '/', 'g'), '/'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS key FROM pages
    """,
)
def lookup_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.lookup_path(F.col("url")).alias("key"))


@query(
    "table_edits",
    """
    SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'changed' ELSE n_name END AS n_name, CAST(NULL AS VARCHAR) AS n_regionkey, CAST(NULL AS INTEGER) AS added FROM nation
    """,
)
def table_edits(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return compact.add_column(compact.retype_column(compact.set_cell(rows, "n_nationkey", 4, "n_name", "changed"), "n_regionkey", "string"), "added", "int")


@query(
    "entries_added",
    """
    SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS pos, r_name AS name FROM region
    UNION ALL SELECT (SELECT COUNT(*) FROM region) + row_number() OVER (ORDER BY n_nationkey) - 1, n_name FROM nation
    """,
)
def entries_added(spark, sf_dir):
    old = entries.numbered(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name")), ["r_regionkey"]).drop("r_regionkey")
    new = entries.numbered(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name")), ["n_nationkey"]).drop("n_nationkey")
    return entries.add_entries(old, new)


@query("renamed_paths", "SELECT page_id, 'out/' || regexp_extract(url, '([^/]*)$', 1) AS moved FROM pages")
def renamed_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", entries.rename_path(F.col("url"), directory="out").alias("moved"))


@query("export_names", "SELECT page_id, CAST(page_id AS VARCHAR) || '-page.html' AS name FROM pages")
def export_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.template("?i-?s.?e", F.col("page_id"), F.lit("html"), F.lit("page")).alias("name"))


@query("best_tied", "SELECT c_nationkey, c_custkey FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r FROM customer) WHERE r = 1")
def best_tied(spark, sf_dir):
    return rank.with_ties(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment"), ["c_nationkey"], [F.col("c_mktsegment")]).select("c_nationkey", "c_custkey")


@query(
    "best_supported",
    """
    SELECT c_nationkey, n, s, v FROM (SELECT c_nationkey, COUNT(*) AS n, round(MAX(c_acctbal), 2) AS s, length(c_mktsegment) AS v FROM customer GROUP BY c_nationkey, length(c_mktsegment))
    QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, s DESC, v) = 1
    """,
)
def best_supported(spark, sf_dir):
    groups = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.length("c_mktsegment").cast("long").alias("v")).agg(F.count("*").alias("n"), F.round(F.max("c_acctbal"), 2).alias("s"))
    return rank.best_by(groups, ["c_nationkey"], "n", "s", "v")


@query("sector_extents", "SELECT doc_id, CAST(COALESCE(SUM((n_chars + 2047) // 2048) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS extent FROM documents")
def sector_extents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", layout.divide_up(F.col("n_chars"), 2048).alias("sectors"))
    return layout.running_offset(docs, "sectors", ["doc_id"], "extent").select("doc_id", "extent")


@query(
    "codec_names",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 30 WHEN 0 THEN 'adx' WHEN 3 THEN 'adx' WHEN 2 THEN 'hca' WHEN 6 THEN 'hca-mx' WHEN 19 THEN 'aac' WHEN 24 THEN 'switch-opus' WHEN 1 THEN 'lpcm'
      WHEN 4 THEN 'wii-adpcm' WHEN 5 THEN 'ds-adpcm' WHEN 7 THEN 'vag' WHEN 8 THEN 'atrac3' WHEN 9 THEN '3ds-adpcm' WHEN 10 THEN 'hevag' WHEN 14 THEN 'hevag' WHEN 11 THEN 'atrac9' WHEN 18 THEN 'atrac9' WHEN 12 THEN 'xma2' WHEN 13 THEN 'wiiu-adpcm' END AS codec
    FROM lineitem
    """,
)
def codec_names(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", names.codec(F.col("l_partkey") % 30).alias("codec"))


@query("best_failure", "SELECT page_id % 3 AS file, 'bad checksum at ' || CAST(MIN(page_id) AS VARCHAR) AS failure FROM pages WHERE page_id % 2 = 1 GROUP BY 1")
def best_failure(spark, sf_dir):
    tried = table(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("file"), F.col("page_id").alias("attempt"), F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("bad checksum at "), F.col("page_id").cast("string"))).otherwise("the magic is not that of a table").alias("failure"))
    return names.best_failure(tried, "file", "attempt", "failure")
