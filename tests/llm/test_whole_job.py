"""Cases in which less than the whole job was done."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, decontaminate, exact_dedup, simhash, suffix_dedup


def vocabulary(rng, n=3000):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def similar(a, b):
    a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_at_four_fifths(spark, frame):
    rng = random.Random(21)
    vocab = vocabulary(rng)
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(200)]
        for k in range(5):
            copy = list(base)
            for at in rng.sample(range(0, 200, 7), k + 1):
                copy[at] = "other%d" % k
            rows.append((g * 10 + k, " ".join(copy)))
    rows += [(900, None), (901, " \n"), (902, "one"), (903, "One "), (904, "two")]
    root = {i: i for i, _ in rows}
    for i, t in rows:
        for j, u in rows:
            if i < j and similar(t or "", u or "") >= 0.8 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    want = sorted(i for i, r in root.items() if i == r)
    assert want != sorted(root)
    got = corpus_pipeline.drop_near_copies(spark, frame(rows), None)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_white_space_mixes_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.tokenizer(open(path, encoding="utf-8").read())
    rng = random.Random(22)
    texts = ["a     b", "a\n ", "a \n", " \t b", "a 　b", "  ", "a \x1c b\x85 c"]
    texts += ["".join(rng.choice([" ", " ", " ", "\t", "\n", "\r", " ", "a", "bc", "'s", "1", "!"]) for _ in range(30)) for _ in range(2000)]
    for text, ids in zip(texts, ours.encode(texts)):
        assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def test_longest_benchmark_run(spark, frame):
    rng = random.Random(23)
    patterns = ["1111111110111" + "01111" * 3, "1111111011101111", "111111111", "1011111111" + "0" * 9 + "1111111110"]
    patterns += ["".join(rng.choices("10", (7, 2), k=40)) for _ in range(30)]
    item = ["w%d" % i for i in range(80)]
    rows, want = [], {}
    for i, p in enumerate(patterns):
        text = [item[k] if c == "1" else "x%d" % k for k, c in enumerate(p)]
        rows.append((i, " ".join(["y"] * 7 + text + ["z"] * 80)))
        runs = [(b - a, -a) for a in range(len(p)) for b in range(a + 10, len(p) + 1) if p[a] == p[b - 1] == "1" and p[a:b].count("1") >= 0.8 * (b - a)]
        if runs:
            n, a = max(runs)
            want[i] = (n, p[-a : -a + n].count("1"), 7 - a)
    got = decontaminate.overlaps(frame(rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_equal, r.doc_word) for r in got} == want and {0, 1, 3} <= set(want) and 2 not in want


def test_null_ids_are_no_first_place(frame):
    text = " ".join("word%d" % i for i in range(60))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(frame([(5, text), (9, text), (None, text)])).collect()}
    assert got == {5: 0, 9: len(text), None: 0}


def test_null_ids_meet_the_snapshot(frame):
    rows = [(5, "same"), (None, "same"), (None, "same"), (7, "else"), (None, "alone")]
    got = exact_dedup.exact_duplicates(frame(rows), F.col("doc_id") == 5).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 5, 3, False), (0, 5, 3, False), (5, 5, 3, True), (7, 7, 1, True)]


def clashing(df):
    """The same rows with columns whose names the operators use themselves."""
    return df.select("*", *[F.lit("x").alias(c) for c in ("h", "seed", "at", "item", "side", "n", "k", "t", "Key", "seq_", "formatted", "_one", "digest")])


def test_other_tables_may_have_more_columns(spark, frame):
    from lodestone.llm import chat, quality, toxicity

    rows = [(i, ("awful " if i % 3 == 0 else "") + " ".join("word%d" % (i * k % 37) for k in range(1, 30))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        plain, more = (module.score(frame(rows), module.train(frame(rows), df)).collect() for df in (labels, clashing(labels)))
        assert sorted(map(tuple, plain)) == sorted(map(tuple, more)) and len(plain) == 60
    bench = spark.createDataFrame([(1, rows[5][1]), (1, rows[5][1]), (None, rows[7][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(frame(rows), clashing(bench)).collect()}
    assert {(5, 1), (7, None)} <= got
    log = [(1, 0, None, None, "user", "a"), (1, 0, None, None, "user", "a"), (None, 0, None, None, "user", "b"), (None, 1, None, None, None, None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    told = {r.conv_id: chat.parse(r.formatted) for r in chat.format_chats(clashing(events)).collect()}
    assert told == {1: [("user", "a"), ("user", "a")], None: [("user", "b"), ("", "")]}


def test_null_ids_and_texts_in_every_operator(spark, frame):
    from lodestone.llm import near_copies, passages, quality, sharding, toxicity

    rows = [(None, None), (None, ""), (1, None), (1, None), (2, "one two three"), (2, "one two three"), (3, "word " * 30000)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(frame(rows), toxicity.train(frame(rows), labels)).count() == 7
    assert quality.score(frame(rows), quality.train(frame(rows), labels)).count() == 7
    assert simhash.near_duplicates(frame(rows)).count() == 7
    assert near_copies.near_duplicates(frame(rows)).count() == 7
    assert sharding.shard_rows(frame(rows)).count() == 7
    assert suffix_dedup.remove_repeats(frame(rows)).count() == 7
    assert exact_dedup.exact_duplicates(frame(rows), F.col("doc_id") == 1).count() == 7
    assert bpe.round_trip(frame(rows)).count() == 7
    assert passages.near_passages(frame(rows)).count() == 0
