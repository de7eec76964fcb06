import itertools

import numpy as np
import pytest
import xxhash

from terraframe.llm import simhash as S


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b c", "A b C d", "Ünï CÖDE x\x85y z w", "a b c d e f g " * 30, None])
def test_fingerprint(text):
    assert S.fingerprint((text or "").encode()) == slow_fingerprint(text)


def check(df, rows):
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    ids = [r[0] for r in rows]
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = slow_components(fps)
    want = sorted((i, f"{f:016x}", min(ids[j] for j in range(len(ids)) if comp[j] == c)) for i, f, c in zip(ids, fps, comp))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_components(make, words):
    rows = [(i, words(60 + i, i)) for i in range(40)]
    rows += [(100 + i, rows[i][1].replace(" ", "  ").upper()) for i in range(5)]
    for i in range(30):
        w = rows[i % 3][1].split()
        w[i] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, ""), (301, None), (302, " \n"), (303, "one"), (304, "one"), (304, "one"), (305, words(30_000, 7))]
    check(make(rows, extra=["fingerprint", "fp", "id"]), rows)


def test_the_query_against_brute_force(spark, make, words, tmp_path):
    rows = [(i, words(50 + i, i % 25)) for i in range(40)] + [(50, None), (51, ""), (None, words(50, 0)), (52, "a b")]
    make(rows, extra=["component_id", "fp"]).write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op1_simhash(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = slow_components(fps)
    want = sorted((str(i), f"{f:016x}", min(rows[j][0] for j in range(len(rows)) if comp[j] == c and rows[j][0] is not None)) for (i, _), f, c in zip(rows, fps, comp))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == want


def test_hot_bucket_is_split_without_loss(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = sorted({int(b) ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(S.signed(f),) for f in fps], "fp long")
    edges = S.links(df, 4, chunk=16).collect()
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 64
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [fps.index(find(f)) for f in fps] == slow_components(fps)


def test_pigeonhole_thresholds_cover_every_pair():
    rng = np.random.default_rng(1)
    n, together = 1000, np.full((64, 64), 250)
    np.fill_diagonal(together, 500)
    for m in (2, 3, 4, 5):
        parts = S.grouped_bits(n, together, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        costs = [[float(rng.random()) * 10**t for t in range(-1, 4 - m + 2)] for _ in parts]
        _, ts = S.allocate(costs, 4 - m + 1)
        assert sum(ts) == 4 - m + 1 and min(ts) >= -1
        for _ in range(300):
            diff = rng.choice(64, rng.integers(0, 5), replace=False)
            assert any(len(set(diff.tolist()) & set(p)) <= t for p, t in zip(parts, ts))


def test_correlated_bits_share_a_partition():
    together = np.full((64, 64), 250)
    np.fill_diagonal(together, 500)
    for i in range(0, 64, 2):
        together[i, (i + 33) % 64] = together[(i + 33) % 64, i] = 490
    parts = S.grouped_bits(1000, together, 4)
    assert sum((i + 33) % 64 in p for i in range(0, 64, 2) for p in parts if i in p) >= 28


def test_null_ids_and_representatives(make, words):
    t = words(80, 1)
    df = make([(None, t), (None, t), (5, t), (3, t), (None, "alone here"), (9, words(90, 2))])
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()}
    assert got == {(None, 3), (5, 3), (3, 3), (None, None), (9, 9)}
    kept = sorted((r.doc_id or -1) for r in S.drop_near_duplicates(df).collect())
    assert kept == [-1, 3, 9]


def test_similar_texts_are_dropped(make, words):
    """Pairs of five-word Jaccard 0.8 to 0.95, which differ in more than 4 bits, and a hot group of them; less similar ones stay."""

    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def edited(t, places):
        w = t.split()
        for k in places:
            w[k] = f"edit{k}"
        return " ".join(w)

    rows, similar, other = [], [], []
    for i in range(40):
        t = words(200, i)
        u = edited(t, [20 + 40 * k for k in range(1 + i % 4)])  # each takes 5 of 196 shingles
        j = len(sets(t) & sets(u)) / len(sets(t) | sets(u))
        assert j >= 0.8
        v = edited(t, range(10, 200, 20))
        assert len(sets(t) & sets(v)) / len(sets(t) | sets(v)) < 0.7
        rows += [(3 * i, t), (3 * i + 1, u), (3 * i + 2, v)]
        similar.append(3 * i + 1)
        other += [3 * i, 3 * i + 2]
    base = words(150, 7000)
    rows += [(1000 + i, edited(base, [i])) for i in range(60)]
    got = {r.doc_id for r in S.drop_near_duplicates(make(rows), shingle=5, similarity=0.8).collect()}
    assert len(got & set(similar)) <= 1 and set(other) <= got
    assert {i for i in got if i >= 1000} == {1000}
    assert S.drop_near_duplicates(make([]), shingle=5, similarity=0.8).count() == 0


def test_empty(make):
    assert S.near_duplicates(make([])).count() == 0
    assert S.drop_near_duplicates(make([])).count() == 0


def test_large_buckets_are_split_until_small(spark):
    """A thousand fingerprints that agree in many bits: no cell holds more than a chunk, and every link is found."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 63, dtype=np.uint64)) & ~((1 << 40) - 1)
    fps = sorted({base | int(rng.integers(0, 1 << 40)) for _ in range(900)} | {base | 5 ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)})
    members = spark.createDataFrame([(0, 0, S.signed(f)) for f in fps], "part int, value long, fp long")
    parts = [(list(range(50, 64)), 0)]
    cells = S.split_buckets(members, parts, 4, 64)
    sizes = cells.groupBy("part", "value", "sub", "rest", "ci", "cj").count().agg({"count": "max"}).first()[0]
    assert sizes <= 64 and cells.count() < 40 * len(fps)
    held = {}
    for r in cells.collect():
        held.setdefault((r.sub, r.rest, r.ci, r.cj), []).append(r.fp)
    met = {frozenset(p) for own in held.values() for p in itertools.combinations(own, 2)}
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            assert frozenset((S.signed(a), S.signed(b))) in met
