"""Typed edge tables: distances, cycles, and names that reach a node.

Distances grow one step at a time, by a join of the frontier with the edges. Each step is checkpointed and
only nodes not reached before go on, so cycles end by themselves and no path is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from lodestone.session import BROADCAST_BYTES, checkpointed, discard

#: Steps that doubling follows in a large table before nodes are taken out of walks that are longer.
LONG = 16


def distances(edges: DataFrame, roots: DataFrame, most: int | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """(root, node, distance): least number of edges from each root. ``edges`` is (src, dst[, kind]), ``roots`` is
    (root); edges of the kinds in ``skip`` do not count as steps. More than ``most`` steps are an error."""
    steps = edges.filter(~F.col("kind").isin(list(skip))) if skip else edges
    steps = checkpointed(steps.select("src", "dst").distinct())
    seen = frontier = checkpointed(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance")).distinct())
    for depth in count(1):
        further = frontier.join(steps, frontier["node"] == steps["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(further.join(seen, ["root", "node"], "left_anti").withColumn("distance", F.lit(depth)))
        if frontier.isEmpty():
            break
        if most is not None and depth > most:
            raise RuntimeError(f"nodes lie further than {most} steps away")
        seen = checkpointed(seen.union(frontier)) if depth % 8 == 0 else seen.union(frontier)
    return seen


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node: reported, not dropped."""
    return edges.join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti")


def _counted(df: DataFrame, *conditions: Column) -> tuple[DataFrame, int, list[int]]:
    """``df`` checkpointed, its rows, and for how many of them each condition holds: counted while they are written."""
    seen = Observation()
    kept = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(f"_{i}") for i, c in enumerate(conditions)]))
    found = seen.get
    return kept, found["rows"], [found[f"_{i}"] for i in range(len(conditions))]


def _few(df: DataFrame, rows: int) -> bool:
    """Whether so many counted rows of numbers may be broadcast."""
    return rows * 8 * (1 + len(df.columns)) <= BROADCAST_BYTES and all(isinstance(f.dataType, NumericType) for f in df.schema.fields)


def _side(df: DataFrame, rows: int) -> DataFrame:
    """The side of a join that is looked up, of at most so many rows: Spark would shuffle both sides before it finds one small."""
    return F.broadcast(df) if _few(df, rows) else df


def _keys(df: DataFrame, rows: int) -> DataFrame:
    """The same for a semi or an anti join, where each key counts once."""
    return F.broadcast(df) if _few(df, rows) else df.distinct()


def _jumped(steps: DataFrame, most: int | None = None) -> tuple[DataFrame, int, int, bool]:
    """(node, to, low) of a forest of single steps (node, to): where walks end, and the least node on the way behind the first;
    its rows, how many of them run into rings, and whether all is done, which may take over ``most`` steps.

    A step doubles with each round. A walk ends at a node without a step of its own, or, once it has run into a ring, at
    some node of it. A node that is the least on its own way lies on a ring that has been passed as a whole. When
    the later half of each walk that goes on has such a node as its least, all of them are on their rings.
    """
    now, rows, _ = _counted(steps.select("node", "to", F.col("to").alias("low")))
    length, moved, passed = 1, rows, 0
    while length < rows and moved:
        if most is not None and length >= most:
            return now, rows, moved, False
        on = _side(now.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low")), rows)
        after = now.join(on, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), F.least("low", "_low").alias("low"), F.col("_low").alias("_later"))
        before, (after, _, (moved, rings)) = (moved, passed), _counted(after, F.col("_later").isNotNull(), F.col("low") == F.col("node"))
        discard(now)
        now, length, passed = after.drop("_later"), 2 * length, rings
        now._lodestone_at = after._lodestone_at
        if rings and (moved, rings) == before:
            least = after.filter("low = node").select(F.col("node").alias("_later"))
            if after.filter("_later IS NOT NULL").select("_later").distinct().join(_side(least, rings), "_later", "left_anti").isEmpty():
                break
    return now, rows, moved, True


def _followed(steps: DataFrame, rows: int) -> tuple[DataFrame, int, DataFrame | None, int]:
    """(node, to): where the walks of single steps (node, to) end, without those that run into rings; (node, component) of the
    rings, a component being named by a node of its own; and the rows of both.

    Doubling sends all rows in each round. Where they are too many to be broadcast and walks are long, nodes are taken out first:
    by a coin for each node and round, one of tails goes if its step leads to one of heads, and steps that led to it lead on. That
    is a quarter of the nodes, of which the next round has no more to send. Once walks are followed, what was taken out
    ends where the node ends that it led to, and lies on a ring if a node on that ring led to it.
    """
    few, levels = BROADCAST_BYTES // 32, []
    ends, n, moved, done = _jumped(steps, LONG if rows > few else None)
    if not done:
        discard(ends)
        now, n, before = steps, rows, 2 * rows
        while n > few and 8 * n <= 7 * before:  # rings of one node stay
            heads = lambda c, i=len(levels): F.xxhash64(F.lit(i), F.col(c)) % 2 == 0
            goes = ~heads("node") & heads("to")
            gone = now.filter(goes).select(F.col("node").alias("to"), F.col("to").alias("_to"))
            led = now.filter(~heads("to")).join(gone, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), F.when(F.col("_to").isNotNull(), F.col("to")).alias("by"))
            rest = now.filter(heads("node") & heads("to")).select("node", "to", F.lit(None).cast(now.schema["node"].dataType).alias("by"))
            before, (after, n, _) = n, _counted(led.union(rest))
            levels.append((now.filter(goes), heads("node"), after))
            now = after.select("node", "to")
        ends, n, moved, _ = _jumped(now)
    ring, n_ring = None, 0
    if moved:
        ring, n_ring, _ = _counted(ends.join(_keys(ends.select(F.col("to").alias("node")), n), "node", "left_semi").select("node", F.col("low").alias("component")))
        on = _side(ring.select(F.col("node").alias("to"), F.lit(1).alias("_on")), n_ring)
        ends, n, _ = _counted(ends.join(on, "to", "left").select("node", F.when(F.col("_on").isNull(), F.col("to")).alias("to")))
    ends = ends.select("node", "to")
    for gone, heads, after in reversed(levels):
        known = ends.filter(heads).select(F.col("node").alias("to"), F.col("to").alias("_end"), F.lit(True).alias("_known"))
        more, n_more, _ = _counted(gone.join(known, "to", "left").select("node", F.when(F.col("_known"), F.col("_end")).otherwise(F.col("to")).alias("to")))
        ends, n = ends.union(more), n + n_more
        if n_ring:
            passed, n_more, _ = _counted(after.filter("by IS NOT NULL").join(_side(ring, n_ring), "node").select(F.col("by").alias("node"), "component"))
            ring, n_ring = ring.union(passed), n_ring + n_more
    if moved:
        ends, n, _ = _counted(ends.filter("to IS NOT NULL"))
    discard(*[after for *_, after in levels])
    return ends, n, ring, n_ring


def _below(marked: DataFrame, steps: DataFrame) -> DataFrame:
    """(node): the marked nodes and all that walks of single steps (node, to) from them pass, by doubling."""
    (found, n, _), (jump, left, _) = _counted(marked.select("node").distinct()), _counted(steps.select("node", "to"))
    while left and n:
        more = found.join(_side(jump, left), "node").select(F.col("to").alias("node"))
        after, n, _ = _counted(found.union(more).distinct())
        twice, left, _ = _counted(jump.join(_side(jump.select(F.col("node").alias("to"), F.col("to").alias("_to")), left), "to").select("node", F.col("_to").alias("to")))
        discard(found, jump)
        found, jump = after, twice
    return found


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the least label that reaches each node along the edges (src, dst); only what changed goes on."""
    labels = front = checkpointed(labels)
    while True:
        less = edges.join(front, edges["src"] == front["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("_less"))
        after = checkpointed(labels.join(less, "node", "left").select("node", F.least("label", "_less").alias("label"), (F.col("_less") < F.col("label")).alias("_new")))
        front = after.filter("_new").select("node", "label")
        labels = after.select("node", "label")
        if front.isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst): the least node that it reaches and that reaches it.

    Three steps shrink the graph until nothing is left, each linear in its edges. Nodes with one way out are contracted to
    where their walks end, by doubling, so a ring or a chain of n nodes takes log n rounds; rings of such nodes are
    components. Nodes without a way in or out are cut off. What is left is coloured: the least node that reaches each
    node is its colour, and the nodes of a colour that reach the node of that name are its component. At last contracted
    nodes take the component of their end if something of it leads to them. Rounds grow with the longest shortest walk of
    what cannot be contracted; rows never do. Null ends are no nodes.
    """
    every, rows, (n,) = _counted(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), F.col("src") != F.col("dst"))
    left, settled, contracted = every.filter("src <> dst"), [], []
    while n:
        into, out = left.select(F.col("dst").alias("src")), left.select(F.col("src").alias("dst"))
        inner, n_inner, _ = _counted(left.join(_keys(into, n), "src", "left_semi").join(_keys(out, n), "dst", "left_semi").select("src", "dst"))
        cut, left, n = n_inner < n, inner, n_inner
        if not n:
            break
        ways = left.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to"))
        steps, n_steps, _ = _counted(ways.filter("n = 1").select("node", "to"))
        if n_steps:
            (ends, n_ends, ring, n_ring), before = _followed(steps, n_steps), (left, n)
            kept = left.join(_side(steps.select(F.col("node").alias("src")), n_steps), "src", "left_anti")
            if n_ring:
                settled.append((ring, n_ring))
                gone = steps.join(_side(ends.select("node"), n_ends), "node", "left_anti").select("node")  # on rings or on the way to one
                kept = kept.join(_side(gone.select(F.col("node").alias("dst")), n_steps - n_ends), "dst", "left_anti")
            contracted.append((*before, steps, n_steps, ends, n_ends))
            to = ends.select(F.col("node").alias("dst"), F.col("to").alias("_to"))
            left, n, _ = _counted(kept.join(_side(to, n_ends), "dst", "left").select("src", F.coalesce("_to", "dst").alias("dst")).filter("src <> dst").distinct())
            continue
        if cut:
            continue
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour = _spread(left, nodes.select("node", F.col("node").alias("label")))
        at = lambda end: colour.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        inside = checkpointed(left.join(at("src"), "src").join(at("dst"), "dst").filter("_src = _dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # backwards from the node of each colour: those that it reaches this way bear its label
        named = colour.select("node", F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("label"))
        back = _spread(inside, named).filter("label = 0").select("node").join(colour, "node").select("node", F.col("label").alias("component"))
        found, n_found, _ = _counted(back)
        settled.append((found, n_found))
        off = lambda end: _side(found.select(F.col("node").alias(end)), n_found)
        left, n, _ = _counted(left.join(off("src"), "src", "left_anti").join(off("dst"), "dst", "left_anti").select("src", "dst"))
    nodes = every.select(F.col("src").alias("node")).union(every.select("dst")).distinct()
    known, n_known = nodes.select("node", F.col("node").alias("component")).limit(0), 0
    for more, n_more in settled:
        known, n_known = (more if not n_known else known.union(more)), n_known + n_more
    for before, n_before, steps, n_steps, ends, n_ends in reversed(contracted):
        if not n_ends:
            continue
        known, n_known, _ = _counted(known)
        label = lambda node, out: _side(known.select(F.col("node").alias(node), F.col("component").alias(out)), n_known)
        own = lambda end: F.coalesce(F.col(f"_{end}"), F.col(end))
        into = before.join(_side(ends.select(F.col("node").alias("dst"), "to"), n_ends), "dst").join(_side(steps.select(F.col("node").alias("src")), n_steps), "src", "left_anti")
        hit = into.join(label("src", "_src"), "src", "left").join(label("to", "_to"), "to", "left").filter(own("src") == own("to")).select(F.col("dst").alias("node"))
        inside = steps.join(_side(ends.select("node"), n_ends), "node", "left_semi")
        reached = _below(hit, inside).join(_side(ends, n_ends), "node").join(label("to", "_to"), "to", "left").select("node", own("to").alias("component"))
        # an end that no other component member was known of is one now
        new = reached.select(F.col("component").alias("node"), "component").distinct().join(_side(known.select("node"), n_known), "node", "left_anti")
        known = known.union(reached).union(new)
    all_, _, (n_components,) = _counted(nodes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), F.col("component") == F.col("node"))
    least = all_.groupBy("component").agg(F.min("node").alias("_least"))
    return all_.join(_side(least, n_components), "component").select("node", F.col("_least").alias("component"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node): nodes that reach themselves. A component is named by its least node, so all others in it bear another name than their own."""
    shared = strong_components(edges).filter("node <> component").select(F.explode(F.array("node", "component")).alias("node"))
    return shared.union(edges.filter("src = dst").select(F.col("src").alias("node"))).distinct()


def nearest_names(reach: DataFrame, names: DataFrame) -> DataFrame:
    """(node, names): the names of the nearest roots of each node, ties kept, joined by "; " in name order; empty
    names are left out."""
    ranked = reach.withColumn("_r", F.rank().over(Window.partitionBy("node").orderBy("distance"))).filter("_r = 1")
    named = ranked.join(names, "root").filter(F.coalesce(F.col("name"), F.lit("")) != "")
    return named.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))


def passes_constraints(selected: Column, wanted: Column) -> Column:
    """Whether each wanted (name, value) is either met by the selected map or unknown to it."""
    return F.forall(wanted, lambda w: F.coalesce(F.get(F.map_values(F.map_filter(selected, lambda k, _: k == w["name"])), F.lit(0)) == w["value"], F.lit(True)))


def selector_options(df: DataFrame, name: str, value: str) -> DataFrame:
    """(name, options): the different values of each selector, in order."""
    return df.groupBy(name).agg(F.array_sort(F.collect_set(value)).alias("options"))


def subtree_totals(df: DataFrame, path: str, size: str) -> DataFrame:
    """(directory, entries, bytes) of every directory, all levels below counted; "" is the root."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return df.select(F.explode(above).alias("directory"), F.col(size)).groupBy("directory").agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"))


def wildcard_names(items: DataFrame, names: DataFrame, key: Sequence[str], port: str, name: str) -> DataFrame:
    """Names by key and port, and names by key alone where the name has no port: two equi-joins, then distinct."""
    exact = items.join(names.filter(F.col(port).isNotNull()), [*key, port])
    loose = items.join(names.filter(F.col(port).isNull()).drop(port), list(key))
    return exact.unionByName(loose).distinct()
