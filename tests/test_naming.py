"""Names and paths that no two entries share, against a row-by-row version."""

import random
import re

from lodestone.operators import naming
from pyspark.sql import functions as F


def split(path):
    return re.match(r"^(.*?[^/])(\.[^./]*)?$", path).groups("")


def brute(rows, tries=(), paths=False):
    """rows of (pos, name); tries are functions of (pos, name)."""
    taken = {n for _, n in rows if n is not None}
    out, seen, left = {}, set(), []
    for pos, n in sorted(rows):
        if n is None or n not in seen:
            out[pos] = n
            seen.add(n)
        else:
            left.append((pos, n))
    for t in tries:
        again, here = [], set(taken)
        for pos, n in left:
            made = t(pos, n)
            if made in here:
                again.append((pos, n))
            else:
                here.add(made)
                out[pos] = made
        taken, left = here, again
    used = {}
    for pos, n in left:
        base = tries[-1](pos, n) if tries else n
        head, tail = split(base) if paths else (base, "")
        k = used.get((head, tail), 0) + 1
        while f"{head}_{k}{tail}" in taken:
            k += 1
        used[head, tail] = k
        out[pos] = f"{head}_{k}{tail}"
    return out


def test_taken_numbers_are_skipped(spark):
    rows = list(enumerate(["a", "a", "a_1", "a", "a_1", "a_3", "b", None, "", "a_01", None, "a", "a_1_1", ""]))
    got = dict(naming.unique_names(spark.createDataFrame(rows, "pos long, name string"), "name", ["pos"]).select("pos", "unique_name").collect())
    assert got == brute(rows)
    assert len({v for v in got.values() if v is not None}) == 12


def test_random_families(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "a_1", "a_2_1"]) + rng.choice(["", "", f"_{rng.randrange(1, 9)}", f"_{rng.randrange(1, 40)}"])) for i in range(300)]
    got = dict(naming.unique_names(spark.createDataFrame(rows, "pos long, name string").repartition(5), "name", ["pos"]).select("pos", "unique_name").collect())
    assert got == brute(rows) and len(set(got.values())) == 300


def test_paths_by_id_position_and_number(spark):
    rows = [(0, "x.txt", 1), (1, "x.txt", 5), (2, "x_5.txt", 7), (3, "x.txt", 5), (4, "x_5.txt", 3), (5, "x_5_3.txt", 0), (6, "x_5_4.txt", 0), (7, "d/.x", 2), (8, "d/.x", 2), (9, "x.txt", None), (10, "x_5_1.txt", 1), (11, "x_5_3.txt", 9)]
    suffix = lambda p, s: split(p)[0] + s + split(p)[1]
    ids = {p: "" if i is None else str(i) for p, _, i in rows}
    tries = [lambda p, n: suffix(n, f"_{ids[p]}"), lambda p, n: suffix(n, f"_{ids[p]}_{p}")]
    df = spark.createDataFrame(rows, "pos long, path string, id long")
    got = dict(naming.unique_paths(df, "path", "id", "pos").select("pos", "safe_path").collect())
    assert got == brute([(p, n) for p, n, _ in rows], tries, True)
    assert len(set(got.values())) == len(rows)


def test_empty(spark):
    assert naming.unique_names(spark.createDataFrame([], "pos long, name string"), "name", ["pos"]).count() == 0


def test_steps_are_computed_once(spark):
    """What a step has settled is written out: the result does not compute the rows again for each step that reads them."""
    df = spark.range(60).select("id", F.concat(F.lit("d/"), (F.col("id") % 3).cast("string"), F.lit(".bin")).alias("path"), (F.col("id") % 4).alias("ident"))
    found = naming.unique_paths(df, "path", "ident", "id")
    assert found._jdf.queryExecution().analyzed().toString().count("Range (") == 1
    assert found.select("safe_path").distinct().count() == 60
