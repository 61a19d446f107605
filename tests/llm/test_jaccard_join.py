"""The n-gram Jaccard join against a brute-force version, hot columns and corner cases included."""

import random
import re
from itertools import combinations

import pytest

from lodestone.llm import jaccard_join

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, percent=80):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def near(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[at] = f"x{rng.randrange(10**6)}"
        elif kind < 0.75:
            del out[at]
        else:
            out.insert(at, f"y{rng.randrange(10**6)}")
    return out


def corpus(seed, texts=60, copies=6):
    rng = random.Random(seed)
    line = [f"c{k}" for k in range(30)]
    rows = []
    for _ in range(texts):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 9, 40, 120]))]
        if rng.random() < 0.5:
            base = line + base[: rng.randrange(1, 12)]  # mostly a line that many hold
        rows.append(" ".join(base))
        rows += [" ".join(near(rng, base, rng.choice([0.01, 0.03, 0.05, 0.1]))) for _ in range(rng.randrange(copies))]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(frame):
    rows = corpus(1)
    assert result(jaccard_join.near_duplicates(frame(rows))) == brute(rows)


@pytest.mark.parametrize("column,most,flush", [(3, 0, 2000), (64, 20, 2000)])
def test_long_columns_and_few_known_frequencies(frame, monkeypatch, column, most, flush):
    """Columns that a block does not multiply out, and frequencies that are not sent, change nothing."""
    from lodestone.llm import jaccard_join as j

    monkeypatch.setattr(j, "HOT_MOST", most)
    rows = corpus(7)
    monkeypatch.setattr(j, "FLUSH", flush)
    monkeypatch.setattr(j, "COLUMN", column)
    assert result(j.near_duplicates(frame(rows))) == brute(rows)


def test_a_large_group_of_near_copies_makes_few_pairs(spark, frame, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join(near(rng, base, 0.01))) for i in range(400)]
    compared = []
    real = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda d, n, p, *a: (compared.append(p.count()), real(d, n, p, *a))[1])
    assert {c for _, _, c in result(jaccard_join.near_duplicates(frame(rows)))} == {0}
    assert sum(compared) < 400 * 20  # of 79,800 pairs


def test_corner_cases(spark, frame):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d e"), (7, "A  b\tc d e"), (None, "a b c d e"), (None, "q r s t u"),
        (8, long), (9, long + " end"), (10, "  é É"), (11, "one"), (11, "one"), (-5, "two"), (12, "a b c d e f"),
    ]
    assert result(jaccard_join.near_duplicates(frame(rows))) == brute(rows)
    assert result(jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))) == []
    nothing = [(1, ""), (2, None)]
    assert result(jaccard_join.near_duplicates(frame(nothing))) == brute(nothing)


def test_other_lengths_and_thresholds(frame):
    rows = corpus(3, 25)
    assert result(jaccard_join.near_duplicates(frame(rows), percent=50)) == brute(rows, 50)


def test_bounds():
    for a in range(1, 60):
        for b in range(a, 60):
            need = jaccard_join.least_overlap(a, b, 80)
            assert all((100 * o >= 80 * (a + b - o)) == (o >= need) for o in range(a + 1))
        assert jaccard_join.leading(a, 80) == a - -(-80 * a // 100) + 1
