"""The pipeline on the smallest tables, stage by stage, against plain Python over the same rules."""

import re
from hashlib import sha256

import corpus_pipeline
from lodestone.llm import queries, toxicity
from lodestone.session import table

DATA = "/root/testdata/sf0.001"


def shingles(text, n):
    """Runs of n lower-cased words, as a set; a shorter text is one run."""
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def letters(text):
    return re.findall(r"[^\W_]+", text.lower())


def overlaps(text, item):
    """Whether some stretch of the item stands in the text, ten words or more, four in five equal, on one diagonal."""
    a, b = letters(text), letters(item)
    if " ".join(b) and len(b) < 10 and f" {' '.join(b)} " in f" {' '.join(a)} ":
        return True
    for shift in range(-len(b), len(a)):
        equal = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
        if sum(equal) >= 8:
            sums = [0]
            for e in equal:
                sums.append(sums[-1] + (1 if e else -4))
            if any(sums[j] >= sums[i] for i in range(len(b)) for j in range(i + 10, len(b) + 1)):
                return True
    return False


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels, bench = (table(spark, DATA, t) for t in ("documents", "labels", "benchmark"))
    # the learned stage has no other truth than its scores
    score = {(r.doc_id): r.score for r in toxicity.op1_toxicity(spark, DATA).collect()}
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if score[r.doc_id] < 0.5]
    last = {}
    for i, t in rows:
        last[t] = max(last.get(t, i), i)
    rows = [(i, t) for i, t in rows if last[t] == i]
    sets = [shingles(t, 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            either = len(sets[a] | sets[b])
            if not either or len(sets[a] & sets[b]) / either >= 0.8:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    assert len(least) < len(rows)
    items = [r.text or "" for r in bench.collect()]
    want = {i: t for a, (i, t) in enumerate(rows) if least[find(a)] == i and not any(overlaps(t, item) for item in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got.keys() == want.keys()
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in want.items():
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == sha256(t.encode()).hexdigest()


def test_rows_go_one_by_one(frame, spark):
    rows = [(1, "x"), (1, "unique"), (2, "x"), (3, "y"), (3, "y"), (None, "z"), (None, "w")]
    got = corpus_pipeline.drop_copies(spark, frame(rows), None)
    left = sorted((r.doc_id or 0, r.text) for r in got.collect())
    assert left == [(0, "w"), (0, "z"), (1, "unique"), (2, "x"), (3, "y")]
    near = corpus_pipeline.drop_near_copies(spark, frame(rows), None)
    assert sorted((r.doc_id or 0, r.text) for r in near.collect()) == [(0, "w"), (0, "z"), (1, "unique"), (1, "x"), (3, "y")]


def test_stages_keep_the_columns(spark):
    docs = table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, DATA)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(got.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want.select(*cols).fetchall()))
