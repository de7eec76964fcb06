"""Bounds of sessions, kept as state across batches of a stream.

A session of a key is a run of its features in event time with less than ``gap`` between
neighbours.  Each key's open sessions are a list in Spark's state store (the first and last
instant, the bounds, the number of features): a batch pushes its features into them, late ones may
join two sessions.  An event-time timer for each key stands at the end of the session that is over
first; when it fires, every session whose end the watermark has passed by ``gap`` is finished at once:
its row is emitted, its state removed, and the timer set for what is left.  So a key's calls of the state store
don't grow with its sessions.  A stream that is stopped goes on from its checkpoint with the same sessions open.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.kernels import box
from ..types import parse_field

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ENDS = ("xmin", "ymin", "xmax", "ymax")
_STATE = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), *[T.StructField(e, T.DoubleType()) for e in ENDS], T.StructField("n", T.LongType())])

FINISHED = ("session_start", "session_end", *ENDS, "n")
#: Features of a key that are put in order together.
TOGETHER = 10_000

#: first and last instant (microseconds), xmin, ymin, xmax, ymax, n
Session = tuple[int, int, float, float, float, float, int]


def joined(sessions: list[Session], gap: int) -> list[Session]:
    """Sessions in order of time, those with less than ``gap`` microseconds between them made one."""
    out: list[Session] = []
    for s in sorted(sessions):
        if out and s[0] - out[-1][1] < gap:
            a = out[-1]
            out[-1] = (a[0], max(a[1], s[1]), min(a[2], s[2]), min(a[3], s[3]), max(a[4], s[4]), max(a[5], s[5]), a[6] + s[6])
        else:
            out.append(s)
    return out


class Sessions(StatefulProcessor):
    """Open sessions of a key, and a timer for the one that is over first."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _STATE)

    def ends_at(self, s: Session) -> int:
        """Milliseconds at which a session is over; a timer's instant."""
        return -(-(s[1] + self.gap) // 1000)

    def first_end(self, sessions: list[Session]) -> int | None:
        return min(map(self.ends_at, sessions), default=None)

    def held(self) -> list[Session]:
        return [tuple(s) for s in self.open.get()]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.held()
        now = before
        while own := [(r.session_us, r.session_us, r.xmin, r.ymin, r.xmax, r.ymax, 1) for r in islice(rows, TOGETHER)]:
            now = joined([*now, *own], self.gap)
        old, new = self.first_end(before), self.first_end(now)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        self.open.put(now)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        before, now = self.held(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        over = [s for s in before if self.ends_at(s) <= now]
        left = [s for s in before if self.ends_at(s) > now]
        if over:  # a checkpoint of a timer for each session has some that find nothing more
            if left:
                self.open.put(left)
                self.handle.registerTimer(self.first_end(left))  # later than the one that has fired, which is gone
            else:
                self.open.clear()
            for s in over:
                yield Row(**{self.key: key[0]}, **dict(zip(FINISHED, s)))

    def close(self) -> None:
        pass


def session_box(stream: DataFrame, col: str, time: str, by: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """by, session_start, session_end, xmin, ymin, xmax, ymax, n of every finished session of a stream.

    Features that come more than ``late`` after the latest one are dropped; null and empty features count in n and
    bounds that none has are infinite, inverted.  Needs the RocksDB state store (``PROVIDER``) and UTC as the session's time zone.
    """
    if not stream.isStreaming:
        raise ValueError("sessions are of a stream; for a table group by session_window")
    t = parse_field(stream.schema[col], infer=True)
    instant = F.col(f"`{time}`").cast("timestamp")
    b = box(F.col(f"`{col}`"), t)
    none = {e: F.lit(float("inf") if e.endswith("min") else float("-inf")) for e in ENDS}
    rows = stream.select(F.col(f"`{by}`"), instant.alias("session_at"), F.unix_micros(instant).alias("session_us"), *[F.coalesce(b.getField(e), none[e]).alias(e) for e in ENDS])
    rows = rows.filter("session_at is not null").withWatermark("session_at", late)
    micros = int(stream.sparkSession.sql(f"SELECT (timestamp_micros(0) + interval {gap}) AS t").select(F.unix_micros("t")).first()[0])
    out = T.StructType([stream.schema[by], *[T.StructField(n, f.dataType) for n, f in zip(FINISHED, _STATE)]])
    found = rows.groupBy(by).transformWithState(Sessions(by, micros), out, "Append", "EventTime")
    return found.withColumns({n: F.timestamp_micros(n) for n in FINISHED[:2]})


__all__ = ["session_box", "PROVIDER"]
