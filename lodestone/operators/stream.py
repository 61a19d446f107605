"""Time-stamped chunk streams: interleaving, demultiplexing, heads, sampling, clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.entries import numbered
from lodestone.operators.layout import running_offset
from lodestone.session import checkpointed

#: Bytes of addresses that share a stream's start in one row.
STRETCH_BYTES = 16 << 20


def mux_order(chunks: DataFrame, order: Sequence[str], out: str = "mux_pos") -> DataFrame:
    """Position of each chunk in the interleaved stream. ``order`` ends in the chunk's sequence number: a stable
    sort has to name what it keeps stable."""
    return numbered(chunks, order, out)


def merge_two(first: DataFrame, second: DataFrame, time: str, seq: str, out: str = "mux_pos") -> DataFrame:
    """Merges two ordered tracks by time; the first track wins ties."""
    both = first.withColumn("is_second", F.lit(0)).unionByName(second.withColumn("is_second", F.lit(1)))
    return numbered(both, [time, "is_second", seq], out)


def stream_totals(chunks: DataFrame, key: Sequence[str], size: Column) -> DataFrame:
    """Chunks and payload bytes of each stream; partial sums make hot streams cheap."""
    return chunks.groupBy(*key).agg(F.count("*").alias("chunks"), F.sum(size).alias("payload_bytes"))


def demux(chunks: DataFrame, directory: DataFrame, key: Sequence[str], order: str, payload: str, part: int = 4096) -> DataFrame:
    """Payload parts of each stream in chunk order: (key, part, bytes).

    Chunks without a directory row are dropped. A stream can be as long as the table, so each run of ``part``
    chunks is one row; the parts in order are the stream.
    """
    known = chunks.join(directory.select(*key).distinct(), list(key))
    cut = known.withColumn("part", F.floor(F.col(order) / part))
    gathered = cut.groupBy(*key, "part").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(payload).alias("p")))).alias("_all"))
    # arrays are joined as text only, so bytes go through hex
    raw = dict(chunks.dtypes)[payload] == "binary"
    joined = F.array_join(F.transform("_all", lambda x: F.hex(x["p"]) if raw else x["p"]), "")
    return gathered.select(*key, "part", (F.unhex(joined) if raw else joined).alias("bytes"))


def head_bytes(df: DataFrame, text: str, order: Sequence[str], most: int, out: str = "head") -> DataFrame:
    """The first ``most`` bytes of the concatenated rows: rows before the limit, the last of them cut.

    Only as many first rows are taken as the limit needs: each look takes eight times the rows of the one before, of
    which every task keeps the first ones only. What is left is at most ``most`` bytes and the empty rows among them.
    """
    rows, n = df.select(*order, F.coalesce(F.length(text), F.lit(0)).alias("_n")).orderBy(*order), 1024
    while True:
        size, seen = rows.limit(n).agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
        if size >= most or seen < n:
            break
        n *= 8
    placed = running_offset(df.withColumn("_n", F.length(text)).orderBy(*order).limit(n), "_n", order, "_at").filter(F.col("_at") < most)
    return placed.withColumn(out, F.substring(F.col(text), 1, F.least(F.col("_n"), F.lit(most) - F.col("_at")).cast("int"))).drop("_n", "_at")


def sample_frames(df: DataFrame, group: Sequence[str], order: Sequence[str], wanted: int) -> DataFrame:
    """Every n-th frame of each group, so that about ``wanted`` spread over it; a sampling operator."""
    w = Window.partitionBy(*group)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(*order)) - 1
    tagged = df.withColumn("_n", n).withColumn("_i", i)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / wanted))
    return tagged.filter((F.pmod(F.col("_i"), step) == 0) & (F.col("_i") < step * wanted)).drop("_n", "_i")


def to_ticks(ms: Column, unit: int) -> Column:
    """Milliseconds to ticks of 1/unit s, rounded half up in integers."""
    up = ms * unit + 500
    return ((up - F.pmod(up, F.lit(1000))) / 1000).cast("long")


def to_millis(ticks: Column, unit: int) -> Column:
    up = ticks * 1000 + unit // 2
    return ((up - F.pmod(up, F.lit(unit))) / unit).cast("long")


def clock_90k(seconds: Column) -> Column:
    """System clock reference: seconds times 90,000, rounded half away from zero."""
    return F.round(seconds * 90000).cast("long")


def normalised_timeline(df: DataFrame, group: Sequence[str], order: Sequence[str], time: str) -> DataFrame:
    """Times from the group's first, and the gap to the frame before."""
    w = Window.partitionBy(*group)
    return df.withColumn("rel_time", F.col(time) - F.min(time).over(w)).withColumn("frame_gap", F.col(time) - F.lag(time).over(w.orderBy(*order)))


def mix(clips: DataFrame, group: Sequence[str], sample: Column) -> DataFrame:
    """Sums samples that fall on one place and saturates them to 16 bits."""
    return clips.groupBy(*group).agg(F.greatest(F.lit(-32768), F.least(F.lit(32767), F.sum(sample))).alias("mixed"))


def mix_clips(clips: DataFrame, group: Sequence[str], start: Column, samples: Column) -> DataFrame:
    """(group, place, mixed): clips laid over each other on a sample axis, each from its start; what falls on one place is
    summed and saturated to 16 bits. Sums are folded before they are shuffled, so very many clips may share a place."""
    laid = clips.select(*group, start.alias("_start"), F.posexplode(samples).alias("_i", "_sample"))
    return mix(laid.withColumn("place", F.col("_start") + F.col("_i")), [*group, "place"], F.col("_sample"))


def expand_loops(df: DataFrame, loops: Column, out: str = "pass_no") -> DataFrame:
    """One row for each pass of a looped block: the first play and ``loops`` repeats."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.greatest(loops, F.lit(0)))))


def packets(rows: DataFrame, stream: str, order: Sequence[str], payload: str, size: int) -> DataFrame:
    """(stream, packet_no, content): the payloads of each stream one after the other, cut every ``size`` bytes; only a stream's last
    packet may be shorter.

    Offsets are distributed prefix sums, and a row gives a piece to each packet that it touches, so a stream may be as long
    as the table: a packet is all that one group holds. A null payload has no bytes; the order is total in each stream.
    """
    sized = rows.select(stream, *order, payload).withColumn("_n", F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")).filter("_n > 0")
    placed = running_offset(sized, "_n", [stream, *order], "_at")
    # a stream's start reaches its rows by stretches of addresses, so that a stream of most rows is no one group
    placed = placed.withColumn("_stretch", (F.col("_at") / STRETCH_BYTES).cast("long"))
    low = checkpointed(placed.groupBy(stream, "_stretch").agg(F.min("_at").alias("_low")))
    first = low.groupBy(stream).agg(F.min("_low").alias("_first"))
    starts = checkpointed(low.join(first, stream).select(stream, "_stretch", "_first"))
    placed = placed.join(starts, [stream, "_stretch"]).withColumn("_at", F.col("_at") - F.col("_first"))
    of = lambda at: (at / F.lit(size)).cast("long")
    cut = placed.withColumn("packet_no", F.explode(F.sequence(of(F.col("_at")), of(F.col("_at") + F.col("_n") - 1))))
    begin = F.greatest(F.col("packet_no") * size - F.col("_at"), F.lit(0))
    end = F.least((F.col("packet_no") + 1) * size - F.col("_at"), F.col("_n"))
    piece = F.substring(F.col(payload).cast("binary"), (begin + 1).cast("int"), (end - begin).cast("int"))
    pieces = cut.select(stream, "packet_no", F.struct((F.col("_at") + begin).alias("at"), piece.alias("piece")).alias("p"))
    whole = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(b""), lambda made, p: F.concat(made, p["piece"]))
    return pieces.groupBy(stream, "packet_no").agg(whole.alias("content"))
