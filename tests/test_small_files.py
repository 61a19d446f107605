"""Many small files: built from one stream of rows, and their rows parsed into shared batches."""

import random

from lodestone.codecs import archives
from lodestone.sources import files, sinks


def test_files_are_cut_from_one_stream(spark, monkeypatch):
    """No call for each group; null names and null places stay, the latter at the end, and rows that come twice come twice."""
    monkeypatch.setattr(sinks, "ROWS_IN", 3)
    joined = lambda rows: repr([(r["place"], r["raw"]) for r in rows]).encode()
    rng = random.Random(3)
    rows = [(f"f{rng.randrange(300)}", rng.randrange(50), rng.randbytes(rng.randrange(9))) for _ in range(2000)]
    rows = list({r[:2]: r for r in rows}.values()) + [("f1", None, b"last"), (None, 2, b"b"), (None, 1, None), ("twice", 5, b"x"), ("twice", 5, b"x"), ("", 1, b"")]
    made = sinks.built(spark.createDataFrame(rows, "file string, place int, raw binary").repartition(7), "file", ["place", "raw"], ["place"], joined)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "MapInArrow" in plan
    want = {}
    for name, place, raw in sorted(rows, key=lambda r: (r[1] is None, r[1])):
        want.setdefault(name, []).append((place, raw))
    got = made.collect()
    assert len(got) == len(want) and {r.file: bytes(r.content) for r in got} == {n: repr(v).encode() for n, v in want.items()}
    assert sinks.built(spark.createDataFrame([], "file string, place int, raw binary"), "file", ["raw"], ["place"], joined).count() == 0


def test_large_files_leave_alone(spark):
    rows = [(f"f{k}", i, bytes([k]) * (200_000 if k % 2 else 2)) for k in range(6) for i in range(3)]
    made = sinks.bank(spark.createDataFrame(rows, "file string, id long, raw binary"), "file", "id", "raw")
    assert {r.file: bytes(r.content) for r in made.collect()} == {f"f{k}": archives.build_bank([(i, raw) for n, i, raw in rows if n == f"f{k}"], 32, 4, 8) for k in range(6)}


def test_rows_of_many_files_keep_their_names(spark, monkeypatch):
    """Empty and null files, files with more rows than a batch, and files that fail, between small ones."""
    monkeypatch.setattr(files, "ROWS_OUT", 10)
    monkeypatch.setattr(files, "BYTES_OUT", 100)

    def parse(raw):
        if raw.startswith(b"bad"):
            raise ValueError("no such file")
        return [{"n": i} for i in range(len(raw))]

    made = [(f"f{k}", b"x" * (k % 7)) for k in range(60)] + [("long", b"y" * 95), ("longer", b"y" * 125), ("bad", b"bad"), (None, b"zz"), ("none", None), ("f1", b"abc")]
    got = files.parsed(spark.createDataFrame(made, "file string, content binary").coalesce(1), parse, "n int", errors="row").collect()
    want = [(n, i, None) for n, raw in made if raw and raw != b"bad" for i in range(len(raw))] + [("bad", None, "no such file")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    shared = []
    real = files.pa.RecordBatch.from_arrays
    monkeypatch.setattr(files.pa, "RecordBatch", type("Counted", (), {"from_arrays": staticmethod(lambda *a, **k: (shared.append(1), real(*a, **k))[1])}))
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, over, schema: (over, self.toArrow().to_batches()))
    over, batches = files.parsed(spark.createDataFrame([(f"f{k}", b"x") for k in range(60)], "file string, content binary"), parse, "n int")
    assert sum(b.num_rows for b in over(batches)) == 60 and len(shared) == 6
