import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.functions.coords import tag
from terraframe.operators import aggregate as A
from terraframe.types import linestring_type, point_type, wkt_type


def points(spark, n=500, parts=3, seed=1):
    rng = random.Random(seed)
    rows = [(i, i % 7, None if i % 31 == 0 else float(rng.randint(-40, 40)), float(rng.randint(-40, 40))) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, k int, x double, y double")
    return rows, df.select("id", "k", tag(F.when(F.col("x").isNotNull(), F.struct("x", "y")), "g", point_type())).repartition(parts)


def slow_hull(ps):
    """Corners: points that are no convex combination of two or three others (by orientation tests of all pairs)."""
    ps = sorted(set(ps))
    out = []
    for p in ps:
        rest = [q for q in ps if q != p]
        angles = sorted(np.arctan2(q[1] - p[1], q[0] - p[0]) for q in rest)
        gaps = [b - a for a, b in zip(angles, [*angles[1:], angles[0] + 2 * np.pi])] if angles else [2 * np.pi]
        if max(gaps) > np.pi + 1e-9 or len(rest) == 1:
            out.append(p)
    return out


@pytest.mark.parametrize("parts, fan_in", [(1, 16), (7, 2), (200, 4)])
def test_hull_of_any_partitioning(spark, parts, fan_in):
    rows, df = points(spark, parts=parts)
    got = A.visit_merge(df, "g", A.ConvexHull, "corner int, x double, y double", fan_in=fan_in).orderBy("corner").collect()
    want = slow_hull([(x, y) for _, _, x, y in rows if x is not None])
    assert sorted((r.x, r.y) for r in got) == want
    assert [r.corner for r in got] == list(range(1, len(want) + 1)) and (got[0].x, got[0].y) == want[0]


def test_groups_with_many_states_a_task(spark, monkeypatch):
    monkeypatch.setattr(A, "HELD", 2)
    rows, df = points(spark, parts=5)
    got = A.visit_merge(df, "g", A.ConvexHull, "corner int, x double, y double", by="k", fan_in=2).collect()
    for k in range(7):
        assert sorted((r.x, r.y) for r in got if r.k == k) == slow_hull([(x, y) for _, c, x, y in rows if c == k and x is not None])


def test_states_of_batches_are_kept_and_finished_later(spark, tmp_path):
    rows, df = points(spark)
    for k in range(3):
        A.partial(df.filter(F.col("id") % 3 == k), "g", A.ConvexHull).write.mode("append").parquet(str(tmp_path / "states"))
    states = spark.read.parquet(str(tmp_path / "states"))
    got = A.finished(states, A.ConvexHull, "corner int, x double, y double").collect()
    assert sorted((r.x, r.y) for r in got) == slow_hull([(x, y) for _, _, x, y in rows if x is not None])


class Lengths(A.State):
    """How many features, nulls, and the longest by number of coordinates with its id."""

    def __init__(self):
        self.n = self.nulls = self.now = 0
        self.best = (-1, None)

    def feature_start(self, feat_id):
        self.n, self.now, self.id = self.n + 1, 0, feat_id

    def null_feature(self):
        self.nulls += 1
        return False

    def coord(self, c, coord_id):
        self.now += 1
        return self.now < 50  # enough

    def geometry_end(self, part_id, level):
        self.best = max(self.best, (self.now, -self.id))

    def save(self):
        return repr((self.n, self.nulls, self.best)).encode()

    def merge(self, saved):
        n, nulls, best = eval(saved.decode())
        self.n, self.nulls, self.best = self.n + n, self.nulls + nulls, max(self.best, best, key=lambda b: (b[0], b[1] or 0))

    def finish(self):
        return [(self.n, self.nulls, self.best[0])]


def test_other_states_and_encodings(spark):
    rows = [(i, "LINESTRING (" + ", ".join(f"{j} 0" for j in range(i % 9 + 1)) + ")" if i % 4 else None) for i in range(100)]
    text = spark.createDataFrame(rows, "id long, w string").select("id", tag(F.col("w"), "w", wkt_type())).repartition(6)
    got = A.visit_merge(text, "w", Lengths, "n int, nulls int, longest int", feat_id="id", fan_in=2).collect()
    assert [tuple(r) for r in got] == [(100, 25, 9)]
    native = spark.createDataFrame([(i, [(float(j), 0.0) for j in range(i)]) for i in range(5)], "id long, v array<struct<x:double,y:double>>").select("id", tag(F.col("v"), "l", linestring_type()))
    assert [tuple(r) for r in A.visit_merge(native, "l", Lengths, "n int, nulls int, longest int", feat_id="id").collect()] == [(5, 0, 4)]


def test_no_rows(spark):
    none = points(spark)[1].filter("id < 0")
    assert [tuple(r) for r in A.visit_merge(none, "g", Lengths, "n int, nulls int, longest int", feat_id="id").collect()] == [(0, 0, -1)]
    assert A.visit_merge(none, "g", Lengths, "n int, nulls int, longest int", by="k").collect() == []
    assert A.visit_merge(none, "g", A.ConvexHull, "corner int, x double, y double").collect() == []
