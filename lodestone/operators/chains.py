"""Walks that carry their path: action chains of cues, and states that are expanded and cut back step by step.

A round joins the open walks with what leads on from them and writes the result; walks that end leave the loop. Nothing is
collected but whether a round has rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.graph import passes_constraints
from lodestone.session import checkpointed, discard, together

#: Actions in a row (fixed value).
DEPTH = 64


def resolved_cues(cues: DataFrame, plans: DataFrame, actions: DataFrame, most: int = DEPTH) -> DataFrame:
    """(cue, status, node, chain, plan, selected): what each cue comes to, action chains followed.

    ``cues`` has (cue, selected map of selector values), ``plans`` (node, plan, wanted) and ``actions`` (node, place, wanted, sets,
    target): a cue plays those of its plans whose ``wanted`` (array of name, value) the selected values allow; each place
    of actions that is allowed sets selectors and starts its target, whose plans count for the cue that began. ``chain`` holds the
    cues that were started on the way. A row's status is

    * ``plays``: ``plan`` of ``node``;
    * ``cyclic``: the action of ``node`` starts a cue that is on the way already; it closes ``chain``;
    * ``too deep``: it would be one more than ``most`` cues on the way;
    * ``several targets``: a place starts more than one cue, which is not followed;
    * ``unknown target``: no row of ``cues`` has it;
    * ``silent``: the cue that began comes to nothing else.
    """
    kind = dict(plans.dtypes)["plan"]
    fields = ["cue", "status", "node", "chain", "plan", "selected"]
    begun = cues.select("cue", F.col("cue").alias("node"), F.array().cast(f"array<{dict(cues.dtypes)['cue']}>").alias("chain"), "selected", F.lit(None).cast("string").alias("status"))
    known = cues.select(F.col("cue").alias("target"), F.lit(True).alias("_known")).distinct()
    steps = actions.groupBy("node", "place").agg(F.first("wanted").alias("wanted"), F.first("sets").alias("sets"), F.min("target").alias("target"), F.countDistinct("target").alias("targets"))
    steps = checkpointed(steps.join(known, "target", "left"))
    chain = F.array_append("chain", F.col("target"))
    on_way = (F.col("target") == F.col("cue")) | F.array_contains("chain", F.col("target"))
    status = F.when(F.col("targets") > 1, "several targets").when(F.col("_known").isNull(), "unknown target").when(on_way, "cyclic").when(F.size(chain) >= most, "too deep")
    later = F.map_concat(F.map_filter("selected", lambda k, _: ~F.map_contains_key(F.col("sets"), k)), "sets")
    walks = [checkpointed(begun)]
    while not (front := walks[-1].filter("status IS NULL")).isEmpty():
        led = front.drop("status").join(steps, "node").filter(passes_constraints(F.col("selected"), F.col("wanted"))).withColumn("status", status)
        split = F.col("status") == "several targets"
        onward = F.when(F.col("status").isNull(), F.col("target")).otherwise(F.col("node"))
        walks.append(checkpointed(led.select("cue", onward.alias("node"), F.when(split, F.col("chain")).otherwise(chain).alias("chain"), F.when(F.col("status").isNull(), later).otherwise(F.col("selected")).alias("selected"), "status")))
    found = together(*walks)
    plays = found.filter("status IS NULL").drop("status").join(plans, "node").filter(passes_constraints(F.col("selected"), F.col("wanted")))
    ended = found.filter("status IS NOT NULL").withColumn("plan", F.lit(None).cast(kind))
    out = checkpointed(plays.withColumn("status", F.lit("plays")).select(*fields).unionByName(ended.select(*fields)))
    discard(steps, *walks[1:])
    silent = walks[0].join(out.select("cue").distinct(), "cue", "left_anti").withColumn("status", F.lit("silent")).withColumn("plan", F.lit(None).cast(kind))
    return out.unionByName(silent.select(*fields))


def beam(starts: DataFrame, moves: DataFrame, group: Sequence[str], state: str, score: str, order: Callable[[], list[Column]], keep: int, rounds: int, gain: Callable[[], Column]) -> DataFrame:
    """(group, state, score, path, place) after ``rounds`` rounds: the best ``keep`` states of each group are expanded by
    ``moves`` (state, to, and what ``gain`` reads), states that several ways lead to are kept once, by their best way, and
    the best ``keep`` of each group stay.

    ``order`` ranks rows with (state, score, path); a state without moves ends. ``starts`` has the group, state and score.
    Each round is written out, so a group may begin with any number of states.
    """
    group = list(group)
    best = Window.partitionBy(*group).orderBy(*order())
    way = Window.partitionBy(*group, state).orderBy(*order())

    def cut(df: DataFrame) -> DataFrame:
        once = df.withColumn("_w", F.row_number().over(way)).filter("_w = 1").drop("_w")
        return checkpointed(once.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep))

    held = cut(starts.select(*group, state, score, F.array(state).alias("path")))
    for _ in range(rounds):
        onward = held.drop("place").join(moves, state).withColumn(score, F.col(score) + gain()).withColumn("path", F.array_append("path", F.col("to")))
        after = cut(onward.select(*group, F.col("to").alias(state), score, "path"))
        discard(held)
        held = after
    return held


def deepest_known(candidates: DataFrame, group: Sequence[str], key: str, unknown: str, bits: int, support: str, score: str) -> DataFrame:
    """Candidates of one group whose keys agree as far as both are known: (group, key, unknown bits, members, summed support, mean score by support).

    A candidate knows all but its ``unknown`` highest of ``bits`` bits. Its known low bits are a node of a trie of suffixes, one
    row a length that occurs; it belongs to the candidates that know more and end in the same bits. What nobody
    knows more of stands for itself and takes along every candidate above it in the trie, so a candidate may count for
    several. Equal candidates are one row first; no two candidates are compared.
    """
    group = list(group)
    known = F.lit(bits) - F.col(unknown)
    low = lambda n: F.col(key).bitwiseAND(F.expr(f"shiftleft(CAST(1 AS BIGINT), {n}) - 1"))
    one = candidates.withColumn("_n", known.cast("int")).withColumn("_low", low("_n"))
    one = one.groupBy(*group, "_n", "_low").agg(F.sum(support).alias(support), F.sum(F.col(score) * F.col(support)).alias("_weighed"))
    one = checkpointed(one)
    lengths = one.groupBy(*group).agg(F.array_sort(F.collect_set("_n")).alias("_lengths"))  # at most ``bits`` of them
    spread = one.join(lengths, group).withColumn("_at", F.explode(F.filter("_lengths", lambda n: n <= F.col("_n"))))
    cut = F.col("_low").bitwiseAND(F.expr("shiftleft(CAST(1 AS BIGINT), _at) - 1"))
    trie = spread.select(*group, F.col("_at"), cut.alias("_cut"), F.col("_n").alias("_deep"), F.col("_low").alias("_key"))
    inner = trie.filter("_deep > _at").select(*group, F.col("_at").alias("_n"), F.col("_cut").alias("_low")).distinct()
    leaves = one.join(inner, [*group, "_n", "_low"], "left_anti").select(*group, F.col("_n").alias("_deep"), F.col("_low").alias("_key"))
    ways = trie.join(leaves, [*group, "_deep", "_key"], "left_semi")
    parts = one.select(*group, F.col("_n").alias("_at"), F.col("_low").alias("_cut"), support, "_weighed")
    met = ways.join(parts, [*group, "_at", "_cut"])
    return met.groupBy(*group, F.col("_key").alias(key), (F.lit(bits) - F.col("_deep")).alias(unknown)).agg(F.count("*").alias("members"), F.sum(support).alias(support), (F.sum("_weighed") / F.sum(support)).alias(score))
