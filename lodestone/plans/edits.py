"""Registered queries of the small edits, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import edits
from lodestone.plans.catalog import query
from lodestone.session import table


@query("reserved_slots", "SELECT CAST(i AS BIGINT) AS p_partkey, p_name FROM range((SELECT MAX(p_partkey) + 1 FROM part)) t(i) LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0 OR p_partkey = (SELECT MAX(p_partkey) FROM part)) ON p_partkey = i")
def reserved_slots(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    last = parts.agg(F.max("p_partkey").alias("last"))
    kept = parts.join(F.broadcast(last)).filter("p_partkey % 3 = 0 OR p_partkey = last").drop("last")
    return edits.reserved_slots(kept, "p_partkey")


@query("data_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS data_pos FROM part")
def data_order(spark, sf_dir):
    return edits.data_order(table(spark, sf_dir, "part").select("p_partkey", "p_size"), True, "p_size", "p_partkey").select("p_partkey", "data_pos")


@query(
    "directory_children",
    """
    WITH f AS (SELECT DISTINCT lang || '/' || source AS d, CAST(doc_id % 50 AS VARCHAR) || '.txt' AS n FROM documents),
         c AS (SELECT d AS directory, n AS name, FALSE AS is_directory FROM f UNION SELECT split_part(d, '/', 1), split_part(d, '/', 2), TRUE FROM f UNION SELECT '', split_part(d, '/', 1), TRUE FROM f)
    SELECT *, CAST(row_number() OVER (PARTITION BY directory ORDER BY NOT is_directory, upper(name), name) - 1 AS INT) AS place FROM c
    """,
)
def directory_children(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return edits.children(docs.select(F.concat_ws("/", "lang", "source", F.concat((F.col("doc_id") % 50).cast("string"), F.lit(".txt"))).alias("path")), "path")


@query(
    "script_entries",
    """
    WITH e AS (SELECT user_id, event_id, event_type, event_id % 7 = 0 AS is_dir, event_id % 7 = 3 AS is_id FROM events),
         r AS (SELECT *, COUNT(*) FILTER (is_id) OVER w AS run, last_value(CASE WHEN is_dir THEN event_type END IGNORE NULLS) OVER w AS folder, COALESCE(last_value(CASE WHEN is_id THEN event_id END IGNORE NULLS) OVER w, 0) AS base FROM e
               WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
         n AS (SELECT *, base + COALESCE(COUNT(*) FILTER (NOT is_dir AND NOT is_id) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS file_id FROM r)
    SELECT user_id, event_id AS line_no, CASE WHEN folder IS NULL THEN '' ELSE folder || '/' END || 'f' || CAST(event_id AS VARCHAR) || '.bin' AS path, CAST(file_id AS BIGINT) AS file_id FROM n WHERE NOT is_dir AND NOT is_id
    """,
)
def script_entries(spark, sf_dir):
    number = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(' :DIR=("'), "event_type", F.lit('")'))).when(F.col("event_id") % 7 == 3, F.concat(F.lit(":( "), number, F.lit(")"))).otherwise(F.concat(F.lit("\tf"), number, F.lit(".bin ")))
    return edits.script_entries(table(spark, sf_dir, "events").withColumn("line", line), "user_id", "event_id", "line")


@query("repeated_streams", "SELECT o_custkey, o_orderstatus, COUNT(*) AS times FROM orders GROUP BY ALL HAVING COUNT(*) > 1")
def repeated_streams(spark, sf_dir):
    return edits.repeated_streams(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query("key_groups", "SELECT c_nationkey, length(c_mktsegment) AS subkey, COUNT(*) AS sources FROM customer GROUP BY 1, 2")
def key_groups(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select("c_nationkey", F.length("c_mktsegment").cast("long").alias("subkey"))
    return edits.key_groups(sources, "c_nationkey", "subkey", False)


_CANDIDATES = "SELECT l_orderkey % 500 AS key, l_suppkey % 5 AS grp, CAST(COUNT(*) AS BIGINT) AS source_count, CAST(MAX(l_linenumber) AS BIGINT) AS score, CAST(SUM(l_linenumber) AS BIGINT) AS evidence_count, CAST(MIN(l_partkey % 20) AS BIGINT) AS unknown_high_bits FROM lineitem GROUP BY 1, 2"


def _candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    keyed = rows.groupBy((F.col("l_orderkey") % 500).alias("key"), (F.col("l_suppkey") % 5).alias("grp"))
    return keyed.agg(F.count("*").alias("source_count"), F.max("l_linenumber").cast("long").alias("score"), F.sum("l_linenumber").alias("evidence_count"), F.min(F.col("l_partkey") % 20).alias("unknown_high_bits"))


@query("ranked_candidates", f"SELECT * FROM ({_CANDIDATES}) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY source_count DESC, score DESC, evidence_count DESC, unknown_high_bits, key) <= 10")
def ranked_candidates(spark, sf_dir):
    return edits.ranked_candidates(_candidates(spark, sf_dir), 10, ["grp"])


@query("merged_candidates", f"SELECT key, CAST(SUM(source_count) AS BIGINT) AS source_count, MAX(score) AS score, CAST(SUM(evidence_count) AS BIGINT) AS evidence_count, MIN(unknown_high_bits) AS unknown_high_bits FROM ({_CANDIDATES}) GROUP BY 1")
def merged_candidates(spark, sf_dir):
    return edits.merged_candidates(_candidates(spark, sf_dir), "grp")


@query("mask_decisions", "SELECT event_id, event_id % 4 IN (0, 1) OR (event_id % 4 = 2 AND user_id % 2 = 0) AS masked FROM events")
def mask_decisions(spark, sf_dir):
    magic = F.element_at(F.array(*map(F.lit, ("@SFV", "@ALP", "@SFA", "@SBT"))), (F.col("event_id") % 4 + 1).cast("int"))
    codec = F.when(F.col("user_id") % 2 == 0, "adx").otherwise("hca")
    return table(spark, sf_dir, "events").select("event_id", edits.needs_mask(magic, codec).alias("masked"))


@query(
    "frame_rates",
    """
    WITH t AS (SELECT user_id, COUNT(*) AS n, MAX(event_id) - MIN(event_id) AS e FROM events GROUP BY 1)
    SELECT user_id, n AS frames, CAST(round(CASE WHEN n = 1 THEN 30000.0 WHEN e = 0 THEN 0 ELSE (n - 1) * 30 * 1000.0::DOUBLE / e END) AS BIGINT) AS rate_milli,
           CAST(round(CASE WHEN n = 1 THEN 1000.0::DOUBLE / 30 ELSE (e + e::DOUBLE / (n - 1)) * 1000.0 / 30 END) AS BIGINT) AS duration_ms FROM t
    """,
)
def frame_rates(spark, sf_dir):
    return edits.frame_rates(table(spark, sf_dir, "events"), ["user_id"], "event_id", 30, 1)


@query("tree_search", "SELECT c_custkey, lower(r_name || ' ' || n_name || ' ' || c_name) AS search FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def tree_search(spark, sf_dir):
    ident = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    regions = table(spark, sf_dir, "region").select(ident("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("text"))
    nations = table(spark, sf_dir, "nation").select(ident("n", "n_nationkey"), ident("r", "n_regionkey"), "n_name")
    customers = table(spark, sf_dir, "customer").select(ident("c", "c_custkey"), ident("n", "c_nationkey"), "c_name")
    found = edits.search_text(regions.union(nations).union(customers), "node", "parent", "text").filter(F.startswith("node", F.lit("c")))
    return found.select(F.substr("node", F.lit(2)).cast("long").alias("c_custkey"), "search")


@query("json_listing", """SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'ref': CASE WHEN n_regionkey > 2 THEN n_regionkey END}) AS VARCHAR) AS json FROM nation""")
def json_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("ref", F.when(F.col("n_regionkey") > 2, F.col("n_regionkey")))
    return edits.as_json(rows, ["n_nationkey", "n_name", "ref"])


@query("recording_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN date_trunc('second', o_orderdate) END AS stamp FROM orders")
def recording_dates(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 5 == 0, "31/02/2020 00:00:00:00:00").otherwise(F.date_format("o_orderdate", "d/M/yyyy H:m:s:00:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", edits.recording_date(said).alias("stamp"))
