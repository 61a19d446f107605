"""A large group of like texts, most of which are under the similarity of a link."""

import random

import numpy as np

from lodestone.llm import near_copies


def test_a_group_under_the_threshold_makes_few_pairs(spark, frame, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(240):
        words = list(base)
        for _ in range(1 if i % 4 == 0 else 5):  # some copies are linked, most differ from all others in some 40 shingles
            words[rng.randrange(140)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    sets = [set(near_copies._shingles(t).tolist()) for _, t in rows]
    alike = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    root = list(range(len(rows)))
    for _ in rows:
        after = [min(root[j] for j in range(len(rows)) if alike(sets[i], sets[j])) for i in range(len(rows))]
        if after == root:
            break
        root = after
    asked, verified = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda docs, nodes, pairs: asked.append(pairs.count()) or verified(docs, nodes, pairs))
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(frame(rows)).collect()}
    assert got == dict(enumerate(root))
    under = sum(root[i] != root[j] for i in range(len(rows)) for j in range(i))
    assert asked[-1] < 0.02 * under


def test_parity_maps_bound_what_sets_differ_in():
    rng = np.random.default_rng(1)
    for n in (0, 1, 40, 3000):
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate([a[n // 5 :], rng.integers(0, 2**64, n // 7, dtype=np.uint64)])
        apart = sum(int(x).bit_count() for x in (near_copies.parity(np.unique(a)) ^ near_copies.parity(np.unique(b))).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_one_segment_is_looked_up_at_a_time(spark, frame, monkeypatch):
    """A join sends the ball of one segment of each node: several at once took more disk than the budget where partitions are many."""
    sent, side = [], near_copies._side

    def counted(nodes, g, segments, name, ball):
        out = side(nodes, g, segments, name, ball)
        if ball:
            sent.append((out.count(), nodes.count() * (g.bits + 1)))
        return out

    monkeypatch.setattr(near_copies, "_side", counted)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + ["new"] + base[k:])) for i, k in enumerate((0, 30, 60))] + [(9, " ".join(f"x{rng.randrange(10**6)}" for _ in range(40)))]
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(frame(rows)).collect()}
    sets = [set(near_copies._shingles(t).tolist()) for _, t in rows]
    assert all(10 * len(sets[0] & s) >= 8 * len(sets[0] | s) for s in sets[:3])
    assert got == {0: 0, 1: 0, 2: 0, 9: 9}
    assert sent and all(rows <= most for rows, most in sent)
