import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from terraframe.functions.coords import tag
from terraframe.streaming import sessions as S
from terraframe.types import point_type

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set(*S.PROVIDER)
    yield spark
    spark.conf.unset(S.PROVIDER[0])


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def write(spark, path, rows):
    spark.createDataFrame([(at(m), u, None if x is None else float(x), float(m)) for m, u, x in rows], "ts timestamp, user long, x double, y double").coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, late="5 minutes"):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.readStream.schema("ts timestamp, user long, x double, y double").option("maxFilesPerTrigger", 1).parquet(source)
    df = df.select("ts", "user", tag(F.when(F.col("x").isNotNull(), F.struct("x", "y")), "g", point_type()))
    found = S.session_box(df, "g", "ts", "user", gap="10 minutes", late=late)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.user, r.session_start, r.session_end, r.xmin, r.ymin, r.xmax, r.ymax, r.n) for r in spark.read.parquet(out).collect())


def slow(rows, upto, gap=10):
    """Sessions that are over at an instant."""
    out = []
    for u in {r[1] for r in rows}:
        now = []
        for m, x in sorted((m, x) for m, v, x in rows if v == u):
            if now and m - now[-1][0] >= gap:
                out.append((u, now))
                now = []
            now.append((m, x))
        out.append((u, now))
    inf = float("inf")
    done = [(u, s) for u, s in out if s[-1][0] + gap <= upto]
    return sorted((u, at(s[0][0]), at(s[-1][0]), *(f([v for v in vs if v is not None], default=d) for f, d in ((min, inf), (max, -inf)) for vs in ([x for _, x in s], [m for m, x in s if x is not None])), len(s)) for u, s in done)


def test_sessions_across_batches_and_a_restart(rocks, tmp_path):
    first = [(0, 1, 5), (3, 1, -2), (30, 1, 7), (1, 2, 1), (31, 2, 9), (2, 3, None)]
    second = [(38, 1, 8), (27, 1, 4), (36, 2, 3), (60, 2, 0)]  # 27 is late, but not too late: it joins 30
    write(rocks, str(tmp_path / "in"), first)
    got = run(rocks, tmp_path)
    assert got == slow(first, 31 - 5)
    write(rocks, str(tmp_path / "in"), second)  # the stream has ended; another one goes on from its checkpoint
    got = run(rocks, tmp_path)
    assert got == slow(first + second, 60 - 5) and (1, at(27), at(38), 4.0, 27.0, 8.0, 38.0, 3) in got
    write(rocks, str(tmp_path / "in"), [(10, 1, 100), (200, 4, 1)])  # ten is too late now
    got = run(rocks, tmp_path)
    assert got == slow(first + second + [(200, 4, 1)], 200 - 5)


def test_late_features_join_two_sessions():
    s = [(0, 5, 0.0, 0.0, 1.0, 1.0, 2), (20, 25, 5.0, 5.0, 6.0, 6.0, 1)]
    assert S.joined([*s, (13, 13, 9.0, -9.0, 9.0, -9.0, 1)], 10) == [(0, 25, 0.0, -9.0, 9.0, 6.0, 4)]
    assert S.joined(s, 10) == s and S.joined([], 10) == []


class Store:
    """What a processor asks of Spark: a list, timers, and the number of calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def did(self):
        self.calls += 1

    get = lambda self: self.did() or iter(self.rows)
    put = lambda self, rows: self.did() or setattr(self, "rows", list(rows))
    clear = lambda self: self.put([])
    registerTimer = lambda self, t: self.did() or self.timers.add(t)
    deleteTimer = lambda self, t: self.did() or self.timers.remove(t)


@pytest.mark.parametrize("n", [3, 300])
def test_calls_of_the_store_do_not_grow_with_the_sessions(n):
    store, s = Store(), S.Sessions("user", 10_000)
    s.handle = s.open = store
    rows = lambda at: iter([Row(session_us=t, **dict.fromkeys(S.ENDS, 0.0)) for t in at])
    list(s.handleInputRows((1,), rows([i * 20_000 for i in range(n)]), None))
    assert len(store.rows) == n and store.timers == {10}
    list(s.handleInputRows((1,), rows([5_000, n * 20_000]), None))  # the first session ends later now
    assert len(store.rows) == n + 1 and store.timers == {15}
    mark = (n - 1) * 20  # the last session but one is over, the one after isn't
    fired = lambda at, mark: list(s.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    out = fired(15, mark)
    store.timers.remove(15)  # by Spark
    assert [r.n for r in out] == [2, *[1] * (n - 2)] and len(store.rows) == 2 and store.timers == {mark + 10}
    assert fired(20, mark) == [] and len(store.rows) == 2  # a timer that finds nothing
    assert store.calls <= 12


def test_tables_are_refused(spark):
    df = spark.range(1).select(F.current_timestamp().alias("ts"), "id", tag(F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")), "g", point_type()))
    with pytest.raises(ValueError, match="of a stream"):
        S.session_box(df, "g", "ts", "id")
