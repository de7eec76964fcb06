"""User aggregates over geometries: state that is pushed, written down, merged and finished.

A :class:`State` visits features like any visitor.  Each task pushes its rows into one
state (or one a group), whose bytes are what leaves the task.  Bytes of a few tasks are merged
at a time, level by level, so no call sees more than ``fan_in`` states of a group and
task range; the last one is finished.  Merging must not depend on order or grouping,
which tasks and lost executors change.

:func:`partial` and :func:`finished` are the two halves: states of one batch of rows may be
kept as a table and finished later together with those of other batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..types import parse_field
from .visit import Visitor, _reader, walk

#: States merged in one call; groups whose states a task holds before it passes them on.
FAN_IN, HELD = 16, 10_000


class State(Visitor):
    """A visitor whose state can be written down and merged.

    A subclass keeps its state, gives it as bytes from ``save``, takes another's in
    with ``merge`` and returns result rows from ``finish``, once for each group.
    """

    def save(self) -> bytes:
        raise NotImplementedError

    def merge(self, saved: bytes) -> None:
        raise NotImplementedError


def partial(df: DataFrame, col: str, state: Callable[[], State], by: str | None = None, feat_id: str | None = None) -> DataFrame:
    """(by, task, state): the states of all tasks, one for each group that a task has (more if it has very many)."""
    t = parse_field(df.schema[col], infer=True)
    read = _reader(t)
    null = F.lit(None).cast("long")
    chosen = df.select((F.col(f"`{by}`") if by else null).alias("by"), (F.col(f"`{feat_id}`") if feat_id else null).alias("feat_id"), F.col(f"`{col}`").alias("g"))
    out_type = T.StructType([T.StructField("by", chosen.schema["by"].dataType), T.StructField("task", T.LongType()), T.StructField("state", T.BinaryType())])
    schema = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        task = TaskContext.get().partitionId()

        def saved() -> pa.RecordBatch:
            rows = list(held.items())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], schema.field("by").type), pa.array([task] * len(rows), pa.int64()), pa.array([s.save() for _, s in rows], pa.binary())], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                for key, i, g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), read(part.column(2))):
                    if key not in held:
                        if len(held) >= HELD:
                            yield saved()
                        held[key] = state()
                    walk(g, i, held[key])
        if held:
            yield saved()

    return chosen.mapInArrow(run, out_type)


def merged(states: DataFrame, state: Callable[[], State], tasks: int, fan_in: int = FAN_IN) -> DataFrame:
    """(by, task, state): the states of ranges of tasks merged, until each group has one."""

    def fold(found: pa.Table) -> pa.Table:
        values = found.column("state").to_pylist()
        whole = state()
        for v in values:
            whole.merge(v)
        return pa.table({"by": found.column("by")[:1], "task": found.column("task")[:1], "state": pa.array([whole.save()], pa.binary())})

    while True:
        tasks = -(-tasks // fan_in)
        states = states.withColumn("task", F.floor(F.col("task") / fan_in) if tasks > 1 else F.lit(0).cast("long"))
        states = states.groupBy("by", "task").applyInArrow(fold, states.schema)
        if tasks <= 1:
            return states


def finished(states: DataFrame, state: Callable[[], State], schema: str, by: str | None = None, tasks: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """The result rows of all states, behind their group if ``by`` names one; without any state those of an empty one.

    ``tasks``: about how many tasks the states are of, for the number of levels.
    """
    tasks = tasks or states.rdd.getNumPartitions()
    plain = T._parse_datatype_string(schema)
    out_type = T.StructType([T.StructField(by, states.schema["by"].dataType), *plain.fields]) if by else plain
    arrow = to_arrow_schema(out_type)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, saved in zip(b.column("by").to_pylist(), b.column("state").to_pylist()):
                whole = state()
                if saved is not None:
                    whole.merge(saved)
                rows += [(key, *r) if by else tuple(r) for r in whole.finish()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)], schema=arrow)

    whole = merged(states, state, tasks, fan_in)
    if not by:  # an aggregate over no rows still has a result
        nothing = states.sparkSession.createDataFrame([(None,)], T.StructType([T.StructField("by", states.schema["by"].dataType)]))
        whole = nothing.join(F.broadcast(whole.select("task", "state")), F.lit(True), "left").select("by", F.coalesce("task", F.lit(0).cast("long")).alias("task"), "state")
    return whole.mapInArrow(finish, out_type)


def visit_merge(df: DataFrame, col: str, state: Callable[[], State], schema: str, by: str | None = None, feat_id: str | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """A user aggregate over a geometry column, of all rows or of each group of a column; see :class:`State`."""
    return finished(partial(df, col, state, by, feat_id), state, schema, by, df.rdd.getNumPartitions(), fan_in)


class ConvexHull(State):
    """The strict corners of the convex hull of all coordinates, counterclockwise from the lowest of the leftmost ones.

    Points wait until there are some, so that a hull is made once for many.
    """

    WAITING = 4096

    def __init__(self) -> None:
        self.points = np.zeros((0, 2))
        self.waiting: list[tuple[float, float]] = []

    def coord(self, c: tuple[float, ...], coord_id: int) -> None:
        if c[0] == c[0] and c[1] == c[1]:
            self.waiting.append(c[:2])
            if len(self.waiting) >= self.WAITING:
                self.settle()

    def settle(self) -> None:
        if self.waiting:
            self.points = hull(np.concatenate([self.points, np.array(self.waiting)]))
            self.waiting = []

    def save(self) -> bytes:
        self.settle()
        return self.points.tobytes()

    def merge(self, saved: bytes) -> None:
        self.settle()
        self.points = hull(np.concatenate([self.points, np.frombuffer(saved).reshape(-1, 2)]))

    def finish(self) -> list[tuple]:
        self.settle()
        return [(k + 1, float(x), float(y)) for k, (x, y) in enumerate(self.points)]


def hull(points: np.ndarray) -> np.ndarray:
    """Strict corners of the convex hull, by Andrew's chains."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(ps: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ordered = [tuple(p) for p in points.tolist()]
    return np.array(chain(ordered) + chain(ordered[::-1]))


__all__ = ["State", "ConvexHull", "partial", "finished", "merged", "visit_merge"]
