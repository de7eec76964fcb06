import hashlib
import random

import numpy as np
import pytest

from terraframe.llm import suffix_dedup as D


def slow(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for j in range(len(b) - length + 1):
            seen[b[j : j + length]] = seen.get(b[j : j + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int)]))
        out.append((len(b), [tuple(x) for x in edge.reshape(-1, 2)], bytes(c for c, g in zip(b, gone) if not g)))
    return out


def check(df, rows, length=200, **options):
    got = D.dedup(df, length=length, **options).collect()
    want = sorted((i if i is not None else -1, *x) for (i, _), x in zip(rows, slow([t for _, t in rows], length)))
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got)
    assert have == want


def test_whole_texts_against_brute_force(make, words):
    a, b, c = words(200, 1), words(300, 2), words(60, 3)
    rows = [(1, a), (2, b), (3, c + a[:400] + b[100:500] + c), (4, a), (5, None), (6, ""), (7, "x" * 199), (8, "x" * 450), (9, "né" * 120 + a[50:260]), (10, c + c + c), (11, c[::-1])]
    rows += [(12, "ab" * 300), (13, "y" * 200), (14, a[:199] + "!"), (None, b[37:300]), (None, "z" + c * 2), (15, words(2000, 9)), (15, words(2000, 9))]
    check(make(rows, extra=["kept", "spans", "h", "c", "p", "id"]), rows)


def test_random_texts_and_hot_anchors(make):
    rng = random.Random(5)
    pieces = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    check(make(rows), rows, length=64)
    check(make(rows), rows, length=64, batch=3)


def test_a_passage_in_different_texts_is_dealt_out_twice(make, words, monkeypatch):
    """More segments of an anchor, and then of a range of windows, than a batch takes; windows that differ by a byte at either end."""
    p = words(60, 77)[:300]
    rows = [(i, words(20, 500 + i) + p + words(20, 900 + i)) for i in range(40)]
    rows += [(100 + i, chr(65 + i) + p[40:260] + chr(97 + i)) for i in range(12)] + [(200, p[:199]), (201, p[100:]), (202, "q" * 260), (203, "q" * 230)]
    dealt = []
    real = D.dealt
    monkeypatch.setattr(D, "dealt", lambda large, length, width: dealt.append(width) or real(large, length, width))
    check(make(rows), rows, batch=5)
    assert dealt == [13, 1]


@pytest.mark.parametrize("key", [None, 7])
def test_rows_that_repeat_cost_a_count(make, words, key):
    """5,000 equal rows: the marks of a text stand once, and each row loses all of it."""
    t = words(300, 3)
    docs = make([(key, t)] * 5000 + [(1, words(100, 8)), (2, t[500:900])])
    spans = D.removed_spans(D.keyed(docs, "text"))
    assert spans.count() == 2 and max(len(r.marks) for r in spans.collect()) < len(t) / 40
    got = D.op9_columns(docs).groupBy("n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
    whole = [r for r in got if r.n_removed == len(t)]
    assert len(whole) == 1 and (whole[0]["count"], whole[0].n_spans, whole[0].kept_sha256) == (5000, 1, hashlib.sha256(b"").hexdigest())
    assert sorted((r.n_bytes, r.n_removed) for r in got if r is not whole[0]) == [(400, 400), (len(words(100, 8)), 0)]


def test_the_query_against_brute_force(spark, make, words, tmp_path):
    rows = [(1, words(200, 1)), (2, "é" + words(200, 1)[100:700] + "ü"), (3, None), (4, words(50, 4)), (None, words(50, 4))]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.op9_suffix_dedup(spark, str(tmp_path)).collect()))
    want = sorted((i or -1, n, sum(int(b - a) for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for (i, _), (n, s, k) in zip(rows, slow([t for _, t in rows], 200)))
    assert got == want


def test_blocks_of_long_texts(make, words, monkeypatch):
    t = words(3000, 4)
    monkeypatch.setattr(D, "BLOCK", 700)
    rows = [(1, t), (2, t[1000:4000]), (3, words(500, 6))]
    check(make(rows), rows)


def test_windows_of_small_groups():
    texts = [b"abcdefgh", b"zabcdefg", b"abcdefgh", b"qqqqqqqq"]
    found = D.shared_windows(texts, np.array([2, 3, 2, 2]), np.array([0, 0, 1, 1]), 5)
    assert found[0].nonzero()[0].tolist() == [1, 2, 3] and found[1].nonzero()[0].tolist() == [1, 2, 3]
    assert not found[2].any() and not found[3].any()


def test_text_form_and_empty(make, words):
    """Characters that a cut has split are left out of the text form."""
    a = words(80, 1)
    df = make([(1, "é" + a + "ü" * 300), (2, "ê" + a + "ö" * 300), (3, "short")])
    out = {r.doc_id: r for r in D.drop_repeated_passages(df).collect()}
    data = [t.encode() for t in ("é" + a + "ü" * 300, "ê" + a + "ö" * 300)]
    kept = [k.decode("utf-8", "ignore") for _, _, k in slow([t.decode() for t in data], 200)]
    assert [out[1].text, out[2].text, out[3].text] == [*kept, "short"]
    assert all(out[i].n_chars == len(out[i].text) and out[i].lang == "en" for i in (1, 2, 3))
    assert D.dedup(make([])).count() == 0
