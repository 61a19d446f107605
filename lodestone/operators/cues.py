"""Cue sheets as relations: references become typed edges, choices become paths, plans become names."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import ship

#: What a reference type points to (fixed values).
TARGETS = {1: "waveform", 2: "synth", 3: "sequence", 5: "outside_link", 6: "synth", 7: "sequence", 8: "block_sequence", 9: "block_sequence"}
NONE = 0xFFFF
#: Most choice paths of one cue.
PATHS = 65_536


def node(kind: Column | str, index: Column) -> Column:
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, index.cast("string"))


def reference_edges(rows: DataFrame, source: Column, ref_type: Column, ref_index: Column, kind: str) -> DataFrame:
    """(src, dst, kind, ordinal) of rows with one reference each; type 0 and index 0xFFFF are none, and unknown
    types point to a node ``unknown:type`` that ``graph.unresolved`` reports."""
    target = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in TARGETS.items()))
    to = F.coalesce(F.try_element_at(target, ref_type.cast("int")), F.concat(F.lit("unknown-"), ref_type.cast("string")))
    found = rows.filter((ref_type != 0) & (ref_index != NONE))
    return found.select(source.alias("src"), node(to, ref_index).alias("dst"), F.when(ref_type == 5, "outside_link").otherwise(kind).alias("kind"), F.lit(0).alias("ordinal"))


def list_edges(rows: DataFrame, source: Column, targets: Column, target_kind: str, kind: str) -> DataFrame:
    """Edges to each index of a list, numbered by its place; 0xFFFF is none."""
    spread = rows.select(source.alias("src"), F.posexplode(targets).alias("ordinal", "t")).filter(F.col("t") != NONE)
    return spread.select("src", node(target_kind, F.col("t")).alias("dst"), F.lit(kind).alias("kind"), "ordinal")


def range_edges(rows: DataFrame, source: Column, start: Column, count: Column, target_kind: str, kind: str) -> DataFrame:
    """Edges to ``count`` rows from ``start``; an empty range or a start of 0xFFFF has none."""
    some = F.when((count > 0) & (start != NONE), F.sequence(start, start + count - 1))
    return list_edges(rows, source, some, target_kind, kind)


def choice_paths(options: DataFrame, cue: str, selector: str, value: str) -> DataFrame:
    """(cue, path_no, choices map): every combination of one value per selector, selectors and values in order.

    A cue with more than PATHS combinations is an error. A cue's options are few; cues go in parallel.
    """
    ship(options.sparkSession)
    kinds = dict(options.dtypes)

    def paths(key: tuple, t: pa.Table) -> pa.Table:
        by: dict = {}
        for s, v in sorted(set(zip(t.column(selector).to_pylist(), t.column(value).to_pylist()))):
            by.setdefault(s, []).append(v)
        total = 1
        for v in by.values():
            total *= len(v)
        if total > PATHS:
            raise ValueError(f"a cue has {total} choice paths, more than {PATHS}")
        made = [list(zip(by, p)) for p in itertools.product(*by.values())]
        return pa.table({cue: pa.array([key[0].as_py()] * len(made), t.schema.field(cue).type), "path_no": pa.array(range(len(made)), pa.int32()), "choices": pa.array(made, pa.map_(t.schema.field(selector).type, t.schema.field(value).type))})

    return options.select(cue, selector, value).groupBy(cue).applyInArrow(paths, f"{cue} {kinds[cue]}, path_no int, choices map<{kinds[selector]},{kinds[value]}>")


def plan_names(plans: DataFrame, cue: str, name: str, order: Sequence[str], ext: str = ".wav") -> DataFrame:
    """File names of plans: a number from 1 in each cue, the name, and variant-N where a cue has several."""
    w = Window.partitionBy(cue)
    n, total = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return plans.withColumn("plan_no", n).withColumn("file_name", F.concat(F.lpad(n.cast("string"), 4, "0"), F.lit("_"), F.col(name), F.when(total > 1, F.concat(F.lit("_variant-"), n.cast("string"))).otherwise(""), F.lit(ext)))


def scheduled(commands: DataFrame, stream: Sequence[str], order: str, wait: Column) -> DataFrame:
    """Adds ``at``: the waits before each command of its stream."""
    w = Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return commands.withColumn("at", F.coalesce(F.sum(F.coalesce(wait, F.lit(0))).over(w), F.lit(0)))
