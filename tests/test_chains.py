"""Action chains, beams and keys known to different depths, against row-by-row versions."""

import random

from pyspark.sql import functions as F

from lodestone.operators import chains

WANTED = "array<struct<name:string,value:int>>"


def brute_cues(cues, plans, actions, most):
    selected = dict(cues)
    allows = lambda sel, wanted: all(sel.get(n, v) == v for n, v in wanted)
    out = []

    def walk(cue, node, chain, sel):
        out.extend((cue, "plays", node, chain, p) for n, p, w in plans if n == node and allows(sel, w))
        for place in sorted({a[1] for a in actions if a[0] == node}):
            mine = [a for a in actions if a[0] == node and a[1] == place]
            if not allows(sel, mine[0][2]):
                continue
            targets = {a[4] for a in mine}
            t = min(targets)
            if len(targets) > 1:
                out.append((cue, "several targets", node, chain, None))
            elif t not in selected:
                out.append((cue, "unknown target", node, (*chain, t), None))
            elif t == cue or t in chain:
                out.append((cue, "cyclic", node, (*chain, t), None))
            elif len(chain) + 1 >= most:
                out.append((cue, "too deep", node, (*chain, t), None))
            else:
                walk(cue, t, (*chain, t), sel | mine[0][3])

    for cue, sel in cues:
        before = len(out)
        walk(cue, cue, (), sel)
        if len(out) == before:
            out.append((cue, "silent", cue, (), None))
    return sorted(out, key=str)


def test_action_chains(spark):
    rng = random.Random(3)
    n, most = 40, 6
    cues = [(i, {"a": i % 3} if i % 4 else {}) for i in range(n)]
    plans = [(i, f"p{i}.{k}", [("a", k)] if i % 5 else []) for i in range(0, n, 2) for k in range(2)]
    actions = []
    for i in range(n):
        for place in range(rng.randrange(3)):
            act = (i, place, [("a", rng.randrange(3))] if rng.random() < 0.4 else [], {"a": rng.randrange(3)} if rng.random() < 0.3 else {}, rng.randrange(n + 2))
            actions.append(act)
            if rng.random() < 0.1:
                actions.append((*act[:4], (act[4] + 1) % n))
    actions += [(i, 9, [], {}, i + 1) for i in range(10, 20)]
    got = chains.resolved_cues(
        spark.createDataFrame(cues, "cue long, selected map<string,int>"), spark.createDataFrame(plans, f"node long, plan string, wanted {WANTED}"),
        spark.createDataFrame(actions, f"node long, place int, wanted {WANTED}, sets map<string,int>, target long"), most,
    )
    rows = sorted(((r.cue, r.status, r.node, tuple(r.chain), r.plan) for r in got.collect()), key=str)
    assert rows == brute_cues(cues, plans, actions, most)
    assert {r[1] for r in rows} == {"plays", "cyclic", "too deep", "several targets", "unknown target", "silent"}


def test_beam(spark):
    rng = random.Random(4)
    starts = [(g, rng.randrange(30), rng.randrange(9)) for g in range(5) for _ in range(8)]
    moves = [(s, rng.randrange(30), rng.randrange(9)) for s in range(28) for _ in range(3)]
    order = lambda: [F.desc("score"), F.asc("state"), F.asc("path")]
    got = chains.beam(spark.createDataFrame(starts, "grp int, state int, score int"), spark.createDataFrame(moves, "state int, to int, w int"), ["grp"], "state", "score", order, 3, 4, lambda: F.col("w"))
    expected = []
    for g in range(5):
        def cut(rows):
            best = {}
            for r in sorted(rows, key=lambda r: (-r[1], r[0], r[2])):
                best.setdefault(r[0], r)
            return list(best.values())[:3]

        held = cut([(s, w, (s,)) for h, s, w in starts if h == g])
        for _ in range(4):
            held = cut([(t, w + x, (*p, t)) for s, w, p in held for a, t, x in moves if a == s])
        expected += [(g, s, w, p, i + 1) for i, (s, w, p) in enumerate(held)]
    assert sorted((r.grp, r.state, r.score, tuple(r.path), r.place) for r in got.collect()) == sorted(expected)


def test_keys_known_to_different_depths(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(12) for _ in range(6)]
    rows = [(g, rng.choice(base) ^ (rng.getrandbits(12) << rng.choice([5, 9, 12]) & 0xFFF), rng.choice([0, 0, 2, 4, 7, 12]), rng.randrange(1, 5), rng.randrange(50)) for g in range(3) for _ in range(40)]
    got = chains.deepest_known(spark.createDataFrame(rows, "grp int, key long, unknown int, sources long, score long"), ["grp"], "key", "unknown", 12, "sources", "score")
    expected = set()
    for g in range(3):
        one = {}
        for h, k, u, n, s in rows:
            if h == g:
                a = one.setdefault((12 - u, k & ((1 << 12 - u) - 1)), [0, 0])
                a[0] += n
                a[1] += n * s
        above = lambda x, y: x[0] <= y[0] and y[1] & ((1 << x[0]) - 1) == x[1]
        for leaf in one:
            if not any(above(leaf, o) and o != leaf for o in one):
                all_ = [v for o, v in one.items() if above(o, leaf)]
                expected.add((g, leaf[1], 12 - leaf[0], len(all_), sum(v[0] for v in all_), sum(v[1] for v in all_) / sum(v[0] for v in all_)))
    assert {(r.grp, r.key, r.unknown, r.members, r.sources, r.score) for r in got.collect()} == expected
