import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terraframe.llm import token_counts as T
from terraframe.llm.tokenizers import ByteBpe

BITS = ["'ll", "'", "  ", " b", "\n", "\n\n", " ", "x", "12", "é", "!!", "", "", " don't", "   \n  ", "日本", " "]


@pytest.fixture(scope="module")
def hf():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_tokenizer_file(hf):
    rng = random.Random(1)
    bpe = ByteBpe(special=False)  # as this operator counts
    for t in ["", "a" * 5000, " " * 5000, "\n" * 999 + "x", "<|endoftext|> x", *["".join(rng.choice(BITS) for _ in range(60)) for _ in range(300)]]:
        assert bpe.ids(t) == hf.encode(t, add_special_tokens=False).ids


def test_pieces_of_long_texts():
    from terraframe.llm.tokenizers import chunks

    rng, bpe = random.Random(4), ByteBpe()
    for _ in range(400):
        t = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 200)))
        parts = chunks(t, 10)
        assert "".join(parts) == t and [i for p in parts for i in bpe.ids(p)] == bpe.ids(t)
    assert bpe.array("").tolist() == [] and bpe.array("a b").dtype == "<u4"
    assert len(chunks("ab " * 1_000_000)) > 1


def applied(text, edits):
    for s, e, new in reversed(T.merged(edits, len(text))):
        text = text[:s] + new + text[e:]
    return text


def test_edits_equal_a_full_count():
    c, rng = T.Counter(leaf=4), random.Random(2)
    for _ in range(2500):
        t = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 80)))
        edits = [(a := rng.randint(0, len(t)), min(len(t), a + rng.randint(0, 12)), "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 3, 60])))) for _ in range(rng.randint(0, 9))]
        want = applied(t, edits)
        after, tree, _ = c.edit(t, c.build(t), edits)
        assert after == want and tree.totals == (len(want), c.count(want), len(c.pattern.findall(want)))
        whole = T.Tree.of(tree.to_bytes())
        assert (whole.sums == tree.sums).all()  # the sums are those of a tree built anew


def test_only_touched_leaves_are_encoded_again(words, monkeypatch):
    c = T.Counter()
    t = words(5000, 1)
    tree = c.build(t)
    n, encoded = tree.totals[2], []
    count = c.count
    monkeypatch.setattr(c, "count", lambda x: encoded.append(x) or count(x))
    after, tree, again = c.edit(t, tree, [(len(t) // 2, len(t) // 2 + 3, "zz"), (10, 10, "new "), (len(t), len(t), " end")])
    assert again <= 12 * T.LEAF < n and sum(map(len, encoded)) < len(t) / 10
    assert tree.totals[1] == count(after)
    found, first = tree.find(T.np.array([0, len(after) - 1, len(after) + 5]))
    assert found.tolist() == [0, tree.n - 1, tree.n - 1] and first[0] == 0 and first[1] == first[2]


def test_many_edits_of_a_long_text(words):
    import time

    c, rng = T.Counter(), random.Random(3)
    t = " ".join(words(20_000, k) for k in range(100))[:10_000_000]
    edits = [(a, a + rng.randint(0, 5), rng.choice(["", "x", " two words"])) for a in (rng.randrange(len(t)) for _ in range(100_000))]
    tree = c.build(t)
    began = time.perf_counter()
    after, tree, again = c.edit(t, tree, edits)
    assert time.perf_counter() - began < 40
    assert tree.totals == (len(after), sum(len(c.bpe.ids(x)) for x in T.chunks(after)), tree.totals[2]) and again <= tree.totals[2]


def test_edits_outside_and_overlapping():
    assert T.merged([(-5, 2, "a"), (1, 4, "b"), (90, 99, "c")], 6) == [(0, 4, "ab"), (6, 6, "c")]


def test_the_query_against_full_counts(spark, make, words, hf, tmp_path):
    rows = [(1, "mail me: a.b@c-d.org now\nline\nline\nline 1.2.3.4 end"), (2, None), (3, ""), (None, words(300, 1)), (None, "ip 1.2.3.4"), (4, words(9000, 2)), (4, words(9000, 2)), (4, "call +49 30 1234567!"), (5, "call +49 30 1234567!")]
    make(rows, extra=["n_tokens", "tree"]).write.parquet(str(tmp_path / "documents.parquet"))
    out = T.op5_token_counts(spark, str(tmp_path)).collect()
    count = lambda x: len(hf.encode(x, add_special_tokens=False).ids)
    want = []
    for i, t in rows:
        after = applied(t or "", T.cleaning_edits(t or ""))
        want.append((i or -1, count(t or ""), len(T.merged(T.cleaning_edits(t or ""), len(t or ""))), count(after), len(after)))
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_edits, r.n_tokens_after, r.n_chars_after) for r in out) == sorted(want)
    assert all(r.n_reencoded == 0 for r in out if not r.n_edits)
    assert T.build(make([])).count() == 0


def test_a_second_round_of_edits_uses_the_kept_trees(spark, make, words):
    """Trees are written, edited versions get trees of their own, and the next edits encode touched leaves only."""
    texts = {i: words(3000, i) for i in range(4)}
    docs = make(list(texts.items()))
    trees = T.write_table(T.build(docs), "test-trees")
    version = {r.id: r.th for r in trees.collect()}
    edits = spark.createDataFrame([(0, version[0], 50, 60, "NEW"), (0, version[0], 50, 60, "NEW"), (1, version[1], 9000, 9000, " more"), (2, 12345, 0, 5, "no such version"), (9, 1, 0, 5, "no such row")], "id long, th long, start long, end long, new string")
    first = T.write_table(T.recount(trees, docs, edits), "test-first")
    kept = T.write_table(T.trees_after(first), "test-trees-2")
    got = {r.id: r for r in first.collect()}
    assert {i: r.n_edits for i, r in got.items()} == {0: 1, 1: 1, 2: 0, 3: 0}
    now = {0: applied(texts[0], [(50, 60, "NEW")]), 1: applied(texts[1], [(9000, 9000, " more")]), 2: texts[2], 3: texts[3]}
    assert {i: r.text_after or texts[i] for i, r in got.items()} == now
    again = spark.createDataFrame([(0, got[0].th_after, 55, 56, "y"), (3, version[3], 0, 3, "")], "id long, th long, start long, end long, new string")
    second = {r.id: r for r in T.recount(kept, make(list(now.items())), again).collect()}
    c = T.Counter()
    assert second[0].n_tokens_after == c.count(applied(now[0], [(55, 56, "y")])) and second[3].n_tokens_after == c.count(texts[3][3:])
    assert second[1].n_tokens_after == c.count(now[1]) and second[1].n_reencoded == 0
    assert all(0 < second[i].n_reencoded <= 4 * T.LEAF for i in (0, 3))


def test_many_shuffle_partitions_make_few_files(spark, make, words, tmp_path, monkeypatch):
    rows = [(i, words(20 + i, i) + " 1.2.3.4" * (i % 2)) for i in range(80)]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    tables, write = [], T.write_table
    monkeypatch.setattr(T, "write_table", lambda *a, **b: tables.append(write(*a, **b)) or tables[-1])
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        out = T.op5_token_counts(spark, str(tmp_path))
        out.write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    most = spark.sparkContext.defaultParallelism
    found = spark.read.parquet(str(tmp_path / "out"))
    assert len(tables) == 2 and all(len(x.inputFiles()) <= most for x in [*tables, found])
    c = T.Counter()
    want = [(i, c.count(t), c.count(applied(t, T.cleaning_edits(t)))) for i, t in rows]
    assert sorted((r.doc_id, r.n_tokens, r.n_tokens_after) for r in found.collect()) == want
