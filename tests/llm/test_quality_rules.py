import re
from collections import Counter

import numpy as np
import pytest

from terraframe.llm import quality_rules as Q


def slow(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", "".join(w))), dup, len(hit)]


TEXTS = ["", " \n\t ", "a", "a b a b a b", "x\x85y z", "l1\nl1\n l1\n\n\nl1", "%%% a*b|c", "日本 é\u2003ü", "w " * 5000, None, "a\r\na\r\na", "same line\nsame line\nother"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert Q.counts((text or "").encode())[:5] == slow(text)


def test_many_distinct_words():
    ids = np.r_[np.arange(1 << 20), 0, 1, 2]
    assert Q.repeated_words(ids) == 6


def test_learned_list(spark, make, words):
    rows, labels = [], []
    for i in range(300):
        t = words(80 + i % 40, i)
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "%%%" for w in t.split()) if bad else t))
        if i % 2:
            labels.append((i, int(not bad)))
    labels += [(None, 0), (7, None), (1, 1), (1, 1)]
    rows += [(1000, None), (1001, "few words"), (1002, "again and again " * 60), (None, words(90, 1)), (5, rows[5][1])]
    stats = Q.statistics(make(rows, extra=["n_words", "kept", "quality"]))
    rules = Q.fit(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules and all(len(r) <= 3 for r in rules)
    got = Q.judged(stats, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base
        if r.doc_id is not None and r.doc_id < 300:
            assert r.kept == (r.doc_id % 5 != 0)
        assert not (base and r.kept)


def test_repeated_ids_and_labels_in_any_order(spark, make, words):
    """Ids that repeat many times, labels that repeat: the same list from any order of the rows."""
    rows = [(i % 40, " ".join(w + ("%%" if i % 3 == 0 else "") for w in words(70, i).split())) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] * 2, "doc_id long, quality int")
    lists = [Q.fit(Q.statistics(make(r)), labels.repartition(k), max_labels=60, precision=0.5) for k, r in ((1, rows), (3, rows[::-1]), (5, rows[200:] + rows[:200]))]
    assert lists[0] == lists[1] == lists[2]


def test_the_query_against_plain_counts(spark, make, words, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, words(60 + i, i)) for i in range(30)] + [(None, words(70, 99)), (100, words(60, 0))]
    make(rows, extra=["n_words", "kept"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, i % 2) for i in range(30)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Q.op10_quality_rules(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] if r[0] is not None else -1, *r[1:])
    want = [(i, *slow(t)) for i, t in rows]
    assert sorted(map(key, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))) == sorted(map(key, want))
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_expression_agrees_with_arrays(spark, make, words):
    stats = Q.statistics(make([(i, words(60 + i, i) + " $" * (i % 7)) for i in range(50)]))
    rules = [(Q.Condition("symbols_per_word", True, 0.04),), (Q.Condition("word_length", False, 4.0), Q.Condition("short_share", True, 0.01))]
    got = stats.select("*", *[Q.feature(f).alias(f"f_{f}") for f in Q.FEATURES], Q.as_column(rules).alias("ok")).toPandas()
    x = {f: got[f"f_{f}"].to_numpy() for f in Q.FEATURES}
    want = ~(Q.covered(rules[0], x, 50) | Q.covered(rules[1], x, 50))
    assert (got.ok.to_numpy() == want).all()


def test_no_labels_and_empty(spark, make, words):
    stats = Q.statistics(make([(1, words(80, 1))]))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(stats, none) == [] and Q.judged(stats, []).first().kept
    assert Q.judged(Q.statistics(make([])), []).count() == 0
