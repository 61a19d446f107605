"""Small edits and orders of entry tables, lists that scripts give, key candidates, and listings as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import base_name, normal_path, trim_ascii, upper_ascii
from lodestone.operators.layout import running_offset


def reserved_slots(df: DataFrame, ident: str) -> DataFrame:
    """A row for each id from 0 to the greatest; ids without an entry are empty slots (all other columns null)."""
    last = df.agg(F.max(ident)).first()[0]
    return df.sparkSession.range(0, 0 if last is None else last + 1).withColumnRenamed("id", ident).join(df, ident, "left")


def data_order(df: DataFrame, has_ids: bool, ident: str, path_order: str, out: str = "data_pos") -> DataFrame:
    """Place of each payload: by id where the package has an index by id, else in path order."""
    order = [ident, path_order] if has_ids else [path_order]
    return running_offset(df.withColumn("_one", F.lit(1)), "_one", order, out).drop("_one")


def children(paths: DataFrame, path: str) -> DataFrame:
    """(directory, name, is_directory, place): what each directory holds, directories first, then files, by upper-case
    name; a directory's list is as long as its entries."""
    p = normal_path(F.col(path))
    parts = F.split(p, "/")
    levels = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("directory"), F.get(parts, i - 1).alias("name"), (i < F.size(parts)).alias("is_directory")),
    )
    found = paths.select(F.explode(levels).alias("c")).select("c.*").distinct()
    by = Window.partitionBy("directory").orderBy(~F.col("is_directory"), upper_ascii(F.col("name")), "name")
    return found.withColumn("place", F.row_number().over(by) - 1)


def script_entries(lines: DataFrame, script: str, number: str, line: str) -> DataFrame:
    """(script, line_no, path, file_id) of file-list scripts: ``:DIR=("folder")`` sets the folder, ``:(n)`` the id of the
    next file, which then rises by one a file; empty lines do not count. Scripts are short: one window each."""
    t = trim_ascii(F.col(line))
    some = lines.select(F.col(script), F.col(number).cast("long").alias("line_no"), t.alias("t")).filter("t <> ''")
    upper = upper_ascii(F.col("t"))
    folder = F.when(F.startswith(upper, F.lit(":DIR=")), F.regexp_extract("t", r'^:[A-Za-z]{3}=\s*\(\s*"?([^"]*?)"?\s*\)$', 1))
    base = F.when(F.regexp_like("t", F.lit(r"^:\(\s*\d+\s*\)$")), F.regexp_extract("t", r"(\d+)", 1).cast("long"))
    up_to = Window.partitionBy(script).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = some.withColumn("folder", folder).withColumn("base", base).withColumn("is_file", (~F.startswith("t", F.lit(":"))).cast("int"))
    run = marked.withColumn("folder", F.last("folder", True).over(up_to)).withColumn("run", F.count("base").over(up_to)).withColumn("base", F.coalesce(F.last("base", True).over(up_to), F.lit(0)))
    inside = Window.partitionBy(script, "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = run.withColumn("file_id", F.col("base") + F.coalesce(F.sum("is_file").over(inside), F.lit(0)))
    whole = F.when(F.coalesce(F.col("folder"), F.lit("")) == "", F.col("t")).otherwise(F.concat_ws("/", "folder", "t"))
    return numbered.filter("is_file = 1").select(script, "line_no", normal_path(whole).alias("path"), "file_id")


def repeated_streams(streams: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stream ids that a directory lists more than once, with their number; a file that has any is refused."""
    return streams.groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1")


def key_groups(sources: DataFrame, group: str, subkey: str, shared: bool) -> DataFrame:
    """(group, subkey, sources): what is searched for one key together; with one shared base key groups do not count."""
    return sources.groupBy((F.lit(0) if shared else F.col(group)).alias(group), subkey).agg(F.count("*").alias("sources"))


def ranked_candidates(candidates: DataFrame, most: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """The best key candidates (a top-k report): more sources, higher score, more evidence, fewer unknown bits, lesser key."""
    order = [F.desc("source_count"), F.desc("score"), F.desc("evidence_count"), F.asc("unknown_high_bits"), F.asc("key")]
    if not group:
        return candidates.orderBy(*order).limit(most)
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def merged_candidates(candidates: DataFrame, group: str) -> DataFrame:
    """(key, source_count, score, evidence_count, unknown_high_bits) over all groups: a key that several groups found
    counts all their sources and evidence, keeps the best score and the most that any of them knows."""
    return candidates.groupBy("key").agg(
        F.sum("source_count").alias("source_count"), F.max("score").alias("score"), F.sum("evidence_count").alias("evidence_count"), F.min("unknown_high_bits").alias("unknown_high_bits")
    )


def needs_mask(magic: Column, codec: Column) -> Column:
    """Whether a chunk of a keyed stream is masked: video and alpha always, audio only where it is block audio."""
    return magic.isin("@SFV", "@ALP") | ((magic == "@SFA") & F.coalesce(codec == "adx", F.lit(False)))


def frame_rates(frames: DataFrame, key: Sequence[str], time: str, rate: int, scale: int) -> DataFrame:
    """(key, frames, rate_milli, duration_ms): from the first and last time stamps in units of scale / rate seconds; the
    last frame lasts as long as the mean one."""
    seen = frames.groupBy(*key).agg(F.count("*").alias("frames"), (F.max(time) - F.min(time)).alias("_e"))
    one = F.col("frames") == 1
    milli = F.when(one, F.lit(1000.0 * rate / scale)).when(F.col("_e") == 0, 0.0).otherwise((F.col("frames") - 1) * rate * 1000.0 / (F.col("_e") * scale))
    lasts = F.when(one, F.lit(1000.0 * scale / rate)).otherwise((F.col("_e") + F.col("_e") / (F.col("frames") - 1)) * scale * 1000.0 / rate)
    return seen.select(*key, "frames", F.round(milli).cast("long").alias("rate_milli"), F.round(lasts).cast("long").alias("duration_ms"))


def search_text(nodes: DataFrame, node: str, parent: str, text: str) -> DataFrame:
    """(node, search): a node's text with that of its parent and grandparent, lower-case, for filters over a tree."""
    up = lambda n: nodes.select(F.col(node).alias(f"_n{n}"), F.col(parent).alias(f"_p{n}"), F.col(text).alias(f"_t{n}"))
    one, two = up(1), up(2)
    joined = nodes.join(one, nodes[parent] == one["_n1"], "left").join(two, one["_p1"] == two["_n2"], "left")
    return joined.select(nodes[node], F.lower(F.concat_ws(" ", "_t2", "_t1", nodes[text])).alias("search"))


def as_json(df: DataFrame, columns: Sequence[str], out: str = "json") -> DataFrame:
    """A listing line for each row: its columns as a JSON object, nulls kept."""
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(out))


def recording_date(c: Column) -> Column:
    """Timestamp of ``day/month/year hour:minute:second``, whatever follows; null if it is no date."""
    at = lambda i: F.regexp_extract(c, r"^\s*(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2}):(\d{1,2})", i).try_cast("int")
    return F.try_make_timestamp(at(3), at(2), at(1), at(4), at(5), at(6))


def associated_name(path: Column, ext: str) -> Column:
    """The name beside a path with another extension."""
    return F.concat(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), F.lit("." + ext))
