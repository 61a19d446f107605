"""Registered queries of action chains, beams, key depths, split reads and payload ranges, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.codecs import archives
from lodestone.operators import chains, joins, stream
from lodestone.plans.catalog import query
from lodestone.session import spread, table
from lodestone.sources import files, ranges, sinks

#: Bytes of the small splits of chunk files that one task reads.
TASK_BYTES = 4 << 20

_CUES = """
    cue AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_custkey AS BIGINT) % 100 AS p FROM customer),
    act AS (SELECT k AS node, 0 AS place, CAST(NULL AS BIGINT) AS w, CAST(NULL AS BIGINT) AS s, k + 1 AS target FROM cue WHERE p < 69
      UNION ALL SELECT k, 0, NULL, NULL, CASE WHEN p = 77 THEN k - 2 ELSE k + 1 END FROM cue WHERE p BETWEEN 75 AND 77
      UNION ALL SELECT k, 0, NULL, NULL, k + i FROM cue, range(1, 3) t(i) WHERE p = 80 UNION ALL SELECT k, 0, NULL, NULL, -k FROM cue WHERE p = 85
      UNION ALL SELECT k, 0, 1, NULL, k + 1 FROM cue WHERE p BETWEEN 90 AND 93 UNION ALL SELECT k, 1, 2, 1, k + 2 FROM cue WHERE p BETWEEN 90 AND 93),
    plan AS (SELECT k AS node, k * 10 AS plan, CAST(NULL AS BIGINT) AS w FROM cue WHERE p IN (69, 78, 81, 82, 86, 94, 95) UNION ALL SELECT k, k * 10 + 1, 1 FROM cue WHERE p % 10 = 5)
"""


@query(
    "resolved_cues",
    f"""
    WITH RECURSIVE {_CUES},
    step AS (SELECT node, place, any_value(w) AS w, any_value(s) AS s, MIN(target) AS t, COUNT(DISTINCT target) AS n, bool_or(target IN (SELECT k FROM cue)) AS known FROM act GROUP BY 1, 2),
    walk AS (SELECT k AS cue, k AS node, CAST([] AS BIGINT[]) AS chain, k % 2 + 1 AS sel, CAST(NULL AS VARCHAR) AS status FROM cue
      UNION ALL SELECT cue, CASE WHEN st IS NULL THEN t ELSE node END, CASE WHEN st = 'several targets' THEN chain ELSE list_append(chain, t) END, CASE WHEN st IS NULL THEN coalesce(s, sel) ELSE sel END, st
      FROM (SELECT walk.cue, walk.node, walk.chain, walk.sel, step.t, step.s,
                   CASE WHEN n > 1 THEN 'several targets' WHEN NOT known THEN 'unknown target' WHEN t = cue OR list_contains(chain, t) THEN 'cyclic' WHEN len(chain) + 1 >= 64 THEN 'too deep' END AS st
            FROM walk JOIN step ON walk.node = step.node WHERE walk.status IS NULL AND (w IS NULL OR w = sel))),
    found AS (SELECT cue, 'plays' AS status, walk.node, chain, plan FROM walk JOIN plan ON walk.node = plan.node WHERE status IS NULL AND (w IS NULL OR w = sel)
      UNION ALL SELECT cue, status, node, chain, NULL FROM walk WHERE status IS NOT NULL)
    SELECT cue, status, node, array_to_string(chain, ' ') AS chain, plan FROM found
    UNION ALL SELECT k, 'silent', k, '', NULL FROM cue WHERE k NOT IN (SELECT cue FROM found)
    """,
)
def resolved_cues(spark, sf_dir):
    """All customers as cues: chains longer than the limit, a ring, a fork, a missing target, and selectors that steer."""
    c = F.col("c_custkey").cast("long")
    keys = table(spark, sf_dir, "customer").select(c.alias("k"), (c % 100).alias("p"))
    struct, none = "array<struct<name:string,value:int>>", F.create_map().cast("map<string,int>")
    any_ = F.array().cast(struct)
    only = lambda v: F.array(F.struct(F.lit("s").alias("name"), F.lit(v).alias("value")))
    act = lambda where, place, wanted, sets, to: keys.filter(where).select(F.col("k").alias("node"), F.lit(place).alias("place"), wanted.alias("wanted"), sets.alias("sets"), to.alias("target"))
    k = F.col("k")
    actions = act("p < 69", 0, any_, none, k + 1).union(act("p BETWEEN 75 AND 77", 0, any_, none, F.when(F.col("p") == 77, k - 2).otherwise(k + 1)))
    actions = actions.union(act("p = 80", 0, any_, none, k + 1)).union(act("p = 80", 0, any_, none, k + 2)).union(act("p = 85", 0, any_, none, -k))
    actions = actions.union(act("p BETWEEN 90 AND 93", 0, only(1), none, k + 1)).union(act("p BETWEEN 90 AND 93", 1, only(2), F.create_map(F.lit("s"), F.lit(1)), k + 2))
    plans = keys.filter("p IN (69, 78, 81, 82, 86, 94, 95)").select(k.alias("node"), (k * 10).alias("plan"), any_.alias("wanted"))
    plans = plans.union(keys.filter("p % 10 = 5").select(k, k * 10 + 1, only(1)))
    cues = keys.select(k.alias("cue"), F.create_map(F.lit("s"), (k % 2 + 1).cast("int")).alias("selected"))
    return chains.resolved_cues(cues, plans, actions).select("cue", "status", "node", F.array_join(F.transform("chain", lambda x: x.cast("string")), " ").alias("chain"), "plan")


_ROUND = """
    b{n} AS MATERIALIZED (SELECT * FROM (SELECT * FROM (SELECT grp, move.dest AS state, score + w AS score, list_append(path, move.dest) AS path FROM b{m} JOIN move USING (state))
             QUALIFY row_number() OVER (PARTITION BY grp, state ORDER BY score DESC, path) = 1) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, state, path) <= 3)"""


@query(
    "beam_rounds",
    f"""
    WITH size AS (SELECT COUNT(*) AS n FROM part),
    move AS (SELECT CAST(p_partkey AS BIGINT) AS state, (p_partkey * 3 + i * 7) % n + 1 AS dest, p_partkey * i % 11 AS w FROM part, size, range(1, 4) t(i)),
    b0 AS (SELECT * FROM (SELECT CAST(l_suppkey AS BIGINT) AS grp, CAST(l_partkey AS BIGINT) AS state, CAST(MAX(l_quantity) AS BIGINT) AS score, [CAST(l_partkey AS BIGINT)] AS path FROM lineitem GROUP BY ALL)
           QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, state, path) <= 3), {", ".join(_ROUND.format(n=n, m=n - 1) for n in range(1, 6))}
    SELECT grp, state, CAST(score AS BIGINT) AS score, array_to_string(path, ' ') AS path, CAST(row_number() OVER (PARTITION BY grp ORDER BY score DESC, state, b5.path) AS INT) AS place FROM b5
    """,
)
def beam_rounds(spark, sf_dir):
    """From the parts of each supplier, five rounds of moves between parts, three kept."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("state"), "l_quantity")
    lines = spread(lines, "grp", "state").groupBy("grp", "state").agg(F.max("l_quantity").cast("long").alias("score"))
    parts = table(spark, sf_dir, "part").select("p_partkey")
    size = parts.agg(F.count("*").alias("n"))
    moves = parts.join(F.broadcast(size)).withColumn("i", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    moves = moves.select(F.col("p_partkey").alias("state"), ((F.col("p_partkey") * 3 + F.col("i") * 7) % F.col("n") + 1).alias("to"), (F.col("p_partkey") * F.col("i") % 11).alias("w"))
    order = lambda: [F.desc("score"), F.asc("state"), F.asc("path")]
    found = chains.beam(lines, moves, ["grp"], "state", "score", order, 3, 5, lambda: F.col("w"))
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), " "))


@query(
    "key_depths",
    """
    WITH c AS (SELECT l_returnflag AS grp, CAST(l_orderkey AS BIGINT) * 7919 % 4096 AS key, (l_linenumber - 1) * 2 AS unknown, CAST(l_quantity AS BIGINT) AS score FROM lineitem),
    o AS MATERIALIZED (SELECT grp, 12 - unknown AS n, key & ((1 << (12 - unknown)) - 1) AS low, COUNT(*) AS support, SUM(score) AS weighed FROM c GROUP BY ALL),
    leaf AS (SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.grp = a.grp AND b.n > a.n AND b.low & ((1 << a.n) - 1) = a.low))
    SELECT leaf.grp, CAST(leaf.low AS BIGINT) AS key, CAST(12 - leaf.n AS INT) AS unknown, COUNT(*) AS members, CAST(SUM(o.support) AS BIGINT) AS support, CAST(SUM(o.weighed) AS DOUBLE) / CAST(SUM(o.support) AS DOUBLE) AS score
    FROM leaf JOIN o ON o.grp = leaf.grp AND o.n <= leaf.n AND leaf.low & ((1 << o.n) - 1) = o.low GROUP BY leaf.grp, leaf.low, leaf.n
    """,
)
def key_depths(spark, sf_dir):
    """Candidates of which some know twelve bits and some none."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_orderkey") * 7919 % 4096).alias("key"), ((F.col("l_linenumber") - 1) * 2).alias("unknown"), F.lit(1).cast("long").alias("support"), F.col("l_quantity").cast("long").alias("score"))
    return chains.deepest_known(rows, ["grp"], "key", "unknown", 12, "support", "score")


def _media(spark, sf_dir) -> str:
    """A folder of chunk files of all events, written by the sink: one file a hundred users."""
    ranges.register(spark)
    kind = F.when(F.col("event_type") == "click", "@SFV").when(F.col("event_type") == "view", "@SFA").otherwise("@SBT")
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") / 100).cast("long"), F.lit(".bin")).alias("file"), kind.alias("magic"), (F.col("user_id") % 3).cast("int").alias("channel"), F.col("event_id").alias("frame_time"), F.encode("props", "utf-8").alias("payload")
    )
    return sinks.save_parts(sinks.stream_parts(events, "file", ["frame_time"]), as_named=True)


@query(
    "chunks_filtered",
    "SELECT 'u' || CAST(user_id // 100 AS VARCHAR) || '.bin' AS file, event_id AS frame_time, CAST(user_id % 3 AS INT) AS channel, CAST(strlen(props) AS BIGINT) AS payload_size, props FROM events WHERE event_type = 'view' AND user_id % 3 = 1",
)
def chunks_filtered(spark, sf_dir):
    """Chunk files of all events, read in splits of 64 KiB with filters that the reader applies to headers."""
    found = spark.read.format("lodestone_chunks").option("splitBytes", 1 << 16).option("taskBytes", TASK_BYTES).load(_media(spark, sf_dir)).filter("magic = '@SFA' AND channel = 1")
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "frame_time", "channel", "payload_size", F.decode("payload", "utf-8").alias("props"))


@query("payload_ranges", "SELECT event_id AS frame_time, props FROM events WHERE event_id % 97 = 0")
def payload_ranges(spark, sf_dir):
    """Headers of all chunks first, then the payloads of about one in a hundred by their ranges."""
    heads = spark.read.format("lodestone_chunks").option("splitBytes", 1 << 16).option("taskBytes", TASK_BYTES).option("payload", "false").load(_media(spark, sf_dir))
    wanted = heads.filter("magic <> 'CRID' AND frame_time % 97 = 0").select("file", (F.col("chunk_offset") + 32).alias("file_offset"), F.col("payload_size").alias("file_size"), "frame_time")
    return ranges.payloads(wanted).select("frame_time", F.decode("payload", "utf-8").alias("props"))


@query(
    "packets",
    """
    WITH s AS (SELECT lang, hex(encode(string_agg(coalesce(text, ''), '' ORDER BY doc_id))) AS h FROM documents GROUP BY 1),
         p AS (SELECT lang, k AS packet_no, substring(h, 1 + 8192 * k, 8192) AS c FROM s, range(0, (SELECT MAX(strlen(h)) // 8192 + 1 FROM s)) t(k) WHERE 8192 * k < strlen(h))
    SELECT lang, packet_no, CAST(strlen(c) // 2 AS INT) AS size, md5(unhex(c)) AS digest FROM p
    """,
)
def packets(spark, sf_dir):
    """The texts of each language as one stream, in packets of 4096 bytes."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.encode("text", "utf-8").alias("raw"))
    return stream.packets(docs, "lang", ["doc_id"], "raw", 4096).select("lang", "packet_no", F.octet_length("content").alias("size"), F.md5("content").alias("digest"))


@query(
    "routed_names",
    """
    WITH a AS (SELECT l_partkey, MIN(s_name) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50 GROUP BY 1),
         b AS (SELECT l_partkey, MIN(n_name) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity >= 48 GROUP BY 1),
         c AS (SELECT l_partkey, MIN(n_name) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_linenumber = 7 GROUP BY 1)
    SELECT p_partkey, CAST(CASE WHEN a.n IS NOT NULL THEN 1 WHEN b.n IS NOT NULL THEN 2 WHEN c.n IS NOT NULL THEN 3 END AS INT) AS route, coalesce(a.n, b.n, c.n) AS name
    FROM part LEFT JOIN a ON a.l_partkey = p_partkey LEFT JOIN b ON b.l_partkey = p_partkey LEFT JOIN c ON c.l_partkey = p_partkey
    """,
)
def routed_names(spark, sf_dir):
    """A part's name by its supplier, else by that one's nation, else by the nation of a customer who ordered it."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda c: F.col(c).cast("long")
    hop = lambda df, route, n, src, dst: df.select(F.lit(route).alias("route"), F.lit(n).alias("hop"), key(src).alias("src"), key(dst).alias("dst"))
    lines = t("lineitem")
    hops = hop(lines.filter("l_quantity >= 50"), 1, 1, "l_partkey", "l_suppkey").union(hop(lines.filter("l_quantity >= 48"), 2, 1, "l_partkey", "l_suppkey")).union(hop(t("supplier"), 2, 2, "s_suppkey", "s_nationkey"))
    hops = hops.union(hop(lines.filter("l_linenumber = 7"), 3, 1, "l_partkey", "l_orderkey")).union(hop(t("orders"), 3, 2, "o_orderkey", "o_custkey")).union(hop(t("customer"), 3, 3, "c_custkey", "c_nationkey"))
    named = lambda df, route, n, node, name: df.select(F.lit(route).alias("route"), F.lit(n).alias("hop"), key(node).alias("node"), F.col(name).alias("name"))
    names = named(t("supplier"), 1, 1, "s_suppkey", "s_name").union(named(t("nation"), 2, 2, "n_nationkey", "n_name")).union(named(t("nation"), 3, 3, "n_nationkey", "n_name"))
    return joins.routed(t("part").select("p_partkey"), "p_partkey", hops, names)


@query(
    "reader_attempts",
    """
    SELECT 'c' || CAST(o_custkey AS VARCHAR) AS file, CASE WHEN o_custkey % 4 = 2 THEN 'package' ELSE 'bank' END AS reader, CASE WHEN o_custkey % 4 = 0 THEN COUNT(*) END AS n_rows, o_custkey % 4 <> 0 AS failed
    FROM orders GROUP BY o_custkey
    """,
)
def reader_attempts(spark, sf_dir):
    """A bank of orders for each customer: whole, cut in its header, with another magic, or cut in its entries."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), "o_orderkey", F.encode("o_orderpriority", "utf-8").alias("payload"))
    made = sinks.bank(orders, "file", "o_orderkey", "payload")
    k, size = F.substring("file", 2, 20).cast("long") % 4, F.octet_length("content")
    cut = lambda n: F.substring(F.col("content"), F.lit(1), n)
    broken = F.when(k == 1, cut(F.lit(20))).when(k == 2, F.concat(F.lit(b"XXXX"), F.substring(F.col("content"), F.lit(5), size))).when(k == 3, cut(size - 5)).otherwise(F.col("content"))
    tried = files.attempted(made.select("file", broken.alias("content")), {"package": archives.PARSERS["cpk"], "bank": archives.PARSERS["awb"], "slots": archives.PARSERS["afs"]})
    return files.settled(tried).select("file", "reader", "n_rows", F.col("error").isNotNull().alias("failed"))


@query(
    "nested_entries",
    """
    WITH d AS (SELECT 'f' || CAST(doc_id % 20 AS VARCHAR) AS file, lang, strlen(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY doc_id % 20, lang ORDER BY doc_id) - 1 AS pos FROM documents)
    SELECT file, lang || '.awb/' || CAST(pos AS VARCHAR) AS path, CAST(2 AS INT) AS depth, CAST(size AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS kind FROM d
    UNION ALL SELECT DISTINCT file, lang || '.awb', 1, NULL, 'awb' FROM d
    """,
)
def nested_entries(spark, sf_dir):
    """Banks of texts inside packages."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("|", F.concat(F.lit("f"), F.col("doc_id") % 20), "lang").alias("key"), "doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("payload"))
    folder = sinks.save_parts(sinks.archive_parts(docs, "key", "awb", "doc_id", "payload"))
    named = docs.select("key", sinks.stored_as(F.col("key")).alias("file")).distinct()
    part = F.split("key", r"\|")
    banks = named.join(ranges.manifest(spark, folder), "file").select(part[0].alias("file"), F.concat(part[1], F.lit(".awb")).alias("path"), F.concat(F.lit(folder + "/"), "file").alias("place"), "bytes")
    packages = sinks.save_parts(sinks.package_parts(banks, "file", "path", "place", "bytes"))
    found = files.stored_nested(packages, banks.select("file", sinks.stored_as(F.col("file")).alias("stored")).distinct())
    return found.select("file", "path", "depth", F.when(F.col("depth") == 2, F.col("size")).alias("size"), "kind")
