"""Traversal: vertices, edges, traversal events and user visitors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coords as C
from ..functions.geometry import MEMBER, Geom, from_native, parse_wkb, parse_wkt, write_wkb
from ..functions.wkb import _plain
from ..types import GeomType, parse_field, wkb_type


def vertices(df: DataFrame, col: str, t: GeomType | None = None) -> DataFrame:
    """One row for each coordinate of each non-null feature: the other columns, vertex (from 1) and ordinates."""
    t = t or parse_field(df.schema[col], infer=True)
    rest = [F.col(f"`{c}`") for c in df.columns if c != col]
    g = F.col(f"`{col}`")
    out = df.select(*rest, F.posexplode(F.when(g.isNotNull(), C.all_coords(g, t))).alias("__v", "__c"))
    return out.select(*rest, (F.col("__v") + 1).alias("vertex"), *[C.ordinate(F.col("__c"), t, o).alias(o) for o in t.ordinates])


def edges(df: DataFrame, col: str, t: GeomType | None = None) -> DataFrame:
    """One row for each pair of consecutive vertices: x0, y0, x1, y1, ...  Points give (v, v)."""
    t = t or parse_field(df.schema[col], infer=True)
    g = F.col(f"`{col}`")
    rest = [F.col(f"`{c}`") for c in df.columns if c != col]

    def pairs(s: Column) -> Column:
        n = F.greatest(F.size(s) - 1, F.lit(0))
        return F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    if t.geometry_type in (1, 4):
        found = F.transform(C.all_coords(g, t), lambda c: F.struct(c.alias("a"), c.alias("b")))
    else:
        found = F.flatten(F.transform(C.sequences(g, t), pairs))
    out = df.select(*rest, F.explode(F.when(g.isNotNull(), found)).alias("__e"))
    ends = [C.ordinate(F.col("__e").getField(p), t, o).alias(f"{o}{k}") for k, p in enumerate("ab") for o in t.ordinates]
    return out.select(*rest, *ends)


def parts(df: DataFrame, col: str, t: GeomType | None = None) -> DataFrame:
    """One row for each coordinate sequence with its path (part, ring) and size."""
    t = t or parse_field(df.schema[col], infer=True)
    rest = [F.col(f"`{c}`") for c in df.columns if c != col]
    out = df.select(*rest, F.posexplode(C.polygons(F.col(f"`{col}`"), t)).alias("part", "__p"))
    out = out.select(*rest, "part", F.posexplode("__p").alias("ring", "__s"))
    return out.select(*rest, (F.col("part") + 1).alias("part"), (F.col("ring") + 1).alias("ring"), F.size("__s").alias("n"))


def box_bounds(g: Column, dims: str = "xyzm") -> list[Column]:
    """Lower and upper bounds of an XY box in all dimensions; missing ones are (inf, -inf)."""
    out = []
    for end, none in (("min", float("inf")), ("max", float("-inf"))):
        out += [(g.getField(o + end) if o in "xy" else F.lit(none)).alias(o + end) for o in dims]
    return out


# -- events -----------------------------------------------------------------------

EVENT_SCHEMA = "feat_id long, event string, level int, part_id int, ring_id int, coord_id int, geometry_type int, dimensions int, x double, y double, z double, m double"


def _reader(t: GeomType) -> Callable[[pa.Array], list[Geom | None]]:
    if t.is_wkt or t.is_wkb:
        read = parse_wkt if t.is_wkt else parse_wkb
        return lambda a: [None if v is None else read(v) for v in a.to_pylist()]
    return lambda a: [None if v is None else from_native(v, t.geometry_type, t.dimensions) for v in _plain(a)]


class Visitor:
    """Base of user visitors: callbacks in document order, all optional.

    A subclass keeps what state it wants and returns its rows from ``finish``,
    which is called once for each task.  A callback that returns False ends the
    feature.  All-NaN coordinates are skipped, so an empty point has no coord.
    """

    def feature_start(self, feat_id) -> bool | None: ...

    def null_feature(self) -> bool | None: ...

    def geometry_start(self, kind: int, dims: int, size: int, part_id: int, level: int) -> bool | None: ...

    def ring_start(self, size: int, ring_id: int) -> bool | None: ...

    def coord(self, c: tuple[float, ...], coord_id: int) -> bool | None: ...

    def ring_end(self, ring_id: int) -> bool | None: ...

    def geometry_end(self, part_id: int, level: int) -> bool | None: ...

    def feature_end(self, feat_id) -> bool | None: ...

    def finish(self) -> list[tuple]:
        return []


class _Stop(Exception):
    pass


def walk(g: Geom | None, feat_id, v: Visitor) -> None:
    """Send one feature's events to a visitor."""

    def say(answer) -> None:
        if answer is False:
            raise _Stop

    def points(cs) -> list:
        return [c for c in cs if c[0] == c[0] or any(x == x for x in c)]

    def one(x: Geom, part: int, level: int) -> None:
        own = points(x.points)
        size = len(own) if x.kind < 3 else len(x.parts)
        say(v.geometry_start(x.kind, x.dims, size, part, level))
        if x.kind == 3:
            for r, ring in enumerate(x.parts):
                cs = points(ring)
                say(v.ring_start(len(cs), r))
                for i, c in enumerate(cs):
                    say(v.coord(c, i))
                say(v.ring_end(r))
        for i, c in enumerate(own):
            say(v.coord(c, i))
        if x.kind > 3:
            for p, member in enumerate(x.parts):
                one(member, p, level + 1)
        say(v.geometry_end(part, level))

    try:
        say(v.feature_start(feat_id))
        if g is None:
            say(v.null_feature())
        else:
            one(g, 0, 0)
        say(v.feature_end(feat_id))
    except _Stop:
        pass


def handle(df: DataFrame, col: str, visitor: Callable[[], Visitor], schema: str, feat_id: str | None = None) -> DataFrame:
    """Run a user visitor over the column: one instance a task, its ``finish`` rows are the result.

    Reduce the rows of all tasks with an ordinary aggregate.
    """
    t = parse_field(df.schema[col], infer=True)
    read = _reader(t)
    chosen = df.select((F.col(f"`{feat_id}`") if feat_id else F.lit(None).cast("long")).alias("feat_id"), F.col(f"`{col}`").alias("g"))
    arrow = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = visitor()
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, g in zip(ids, read(b.column(1))):
                walk(g, i, v)
        rows = v.finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(out_schema)], schema=out_schema)

    return chosen.mapInArrow(run, schema)


#: By dimensions: a coordinate as x, y, z, m, with null for what isn't there.
_SPREAD = [lambda c: (None,) * 4, lambda c: (*c, None, None), lambda c: (*c, None), lambda c: (c[0], c[1], None, c[2]), tuple]


class _Events(Visitor):
    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.feature = None
        self.open: list[tuple] = []  # level, part, kind, dims of the geometries that are open
        self.ring: int | None = None

    def _add(self, event: str, coord_id=None, c=()) -> None:
        level, part, kind, dims = self.open[-1] if self.open else (0, None, None, 0)
        self.rows.append((self.feature, event, level, part, self.ring, coord_id, kind, dims, *_SPREAD[dims if c else 0](c)))

    def feature_start(self, feat_id):
        self.feature, self.open, self.ring = feat_id, [], None
        self._add("feat_start")

    def null_feature(self):
        self._add("null_feat")

    def geometry_start(self, kind, dims, size, part_id, level):
        self.open.append((level, part_id, kind, dims))
        self._add("geom_start", size)

    def ring_start(self, size, ring_id):
        self.ring = ring_id
        self._add("ring_start", size)

    def coord(self, c, coord_id):
        self._add("coord", coord_id, c)

    def ring_end(self, ring_id):
        self._add("ring_end")
        self.ring = None

    def geometry_end(self, part_id, level):
        self._add("geom_end")
        self.open.pop()

    def feature_end(self, feat_id):
        self._add("feat_end")


def native_events(g: Column, t: GeomType) -> Column:
    """The events of a native column as an array, by built-in expressions."""
    dims, nothing = int(t.dimensions), F.lit(None).cast("int")
    integer = lambda v: nothing if v is None else v.cast("int") if isinstance(v, Column) else F.lit(int(v))

    def event(name: str, level: int, part, ring, coord_id, kind, dims_: int, c: Column | None = None) -> Column:
        values = [C.ordinate(c, t, o) if c is not None and o in t.ordinates else F.lit(None).cast("double") for o in "xyzm"]
        fields = [F.lit(name).alias("event"), F.lit(level).alias("level"), integer(part).alias("part_id"), integer(ring).alias("ring_id"), integer(coord_id).alias("coord_id"), integer(kind).alias("geometry_type"), F.lit(dims_).alias("dimensions")]
        return F.struct(*fields, *[v.alias(o) for v, o in zip(values, "xyzm")])

    def there(cs: Column) -> Column:
        return F.filter(cs, lambda c: ~C.is_nan_coord(c, t))

    def coords(cs: Column, level: int, part, ring, kind: int) -> Column:
        return F.transform(cs, lambda c, i: event("coord", level, part, ring, i, kind, dims, c))

    def one(x: Column, kind: int, level: int, part) -> Column:
        if kind < 3:
            own = there(F.array(x) if kind == 1 else x)
            size, inner = F.size(own), coords(own, level, part, None, kind)
        elif kind == 3:

            def ring(r: Column, i: Column) -> Column:
                own = there(r)
                return F.concat(F.array(event("ring_start", level, part, i, F.size(own), kind, dims)), coords(own, level, part, i, kind), F.array(event("ring_end", level, part, i, None, kind, dims)))

            size, inner = F.size(x), F.flatten(F.transform(x, ring))
        else:
            size, inner = F.size(x), F.flatten(F.transform(x, lambda m, p: one(m, MEMBER[kind], level + 1, p)))
        return F.concat(F.array(event("geom_start", level, part, None, size, kind, dims)), inner, F.array(event("geom_end", level, part, None, None, kind, dims)))

    plain = lambda name: F.array(event(name, 0, None, None, None, None, 0))
    return F.concat(plain("feat_start"), F.when(g.isNull(), plain("null_feat")).otherwise(one(g, int(t.geometry_type), 0, 0)), plain("feat_end"))


def geometry_events(df: DataFrame, col: str, feat_id: str, numbered: bool = False) -> DataFrame:
    """The traversal of every feature as rows; for starts, coord_id holds the size.

    Native columns go through built-in expressions, serialized ones through a visitor.
    ``numbered``: with seq, an event's place in its feature from 0.
    """
    t = parse_field(df.schema[col], infer=True)
    chosen = df.select(F.col(f"`{feat_id}`").cast("long").alias("feat_id"), F.col(f"`{col}`").alias("g"))
    if t.is_native and t.geometry_type <= 6:
        found = chosen.select("feat_id", F.posexplode(native_events(F.col("g"), t)).alias("seq", "e")).select("feat_id", "e.*", "seq")
        return found if numbered else found.drop("seq")
    read = _reader(t)
    from pyspark.sql.pandas.types import to_arrow_schema

    names = EVENT_SCHEMA + ", seq int" * numbered
    schema = to_arrow_schema(T._parse_datatype_string(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part, v = b.slice(at, 1000), _Events()
                for i, g in zip(part.column(0).to_pylist(), read(part.column(1))):
                    walk(g, i, v)
                columns = [pa.array(c, f.type) for c, f in zip(zip(*v.rows), schema)]
                if numbered:
                    begins = np.array([r[1] == "feat_start" for r in v.rows], bool)
                    at = np.arange(len(begins))
                    columns.append(pa.array((at - np.maximum.accumulate(np.where(begins, at, 0))).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return chosen.mapInArrow(run, names)


def assemble(events: DataFrame, t: GeomType, name: str = "geometry") -> DataFrame:
    """The writer: features built from coordinate rows (feat_id, part_id, ring_id, coord_id, ordinates).

    Grouping is by feature, so a feature's rows meet in one place and nothing else does.
    """
    if not t.is_native or t.geometry_type > 6:
        raise ValueError("the writer builds native geometries")
    c = C.coord(t, **{o: F.coalesce(F.col(o), F.lit(float("nan"))) for o in t.ordinates})
    keys = [F.coalesce(k, F.lit(0)).alias(k) for k in ("part_id", "ring_id")]
    flat = events.filter("event = 'coord'" if "event" in events.columns else "true").select("feat_id", *keys, "coord_id", c.alias("c"))

    def collected(df: DataFrame, by: list[str], pos: str, val: str) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct(F.col(pos), F.col(val))))
        return df.groupBy(*by).agg(F.transform(items, lambda s: s.getField(val)).alias(val))

    if t.level == 0:
        out = flat.select("feat_id", F.col("c").alias("c"))
    elif t.level == 1:
        out = collected(flat.withColumn("o", F.struct("part_id", "ring_id", "coord_id")), ["feat_id"], "o", "c")
    else:
        out = collected(flat, ["feat_id", "part_id", "ring_id"], "coord_id", "c")
        if t.level == 2:
            out = collected(out.withColumn("o", F.struct("part_id", "ring_id")), ["feat_id"], "o", "c")
        else:
            out = collected(collected(out, ["feat_id", "part_id"], "ring_id", "c"), ["feat_id"], "part_id", "c")
    return out.select("feat_id", C.tag(F.col("c"), name, t))


class Writer:
    """Builds one feature from its events, in order; an event that has no place there is an error that names it."""

    def __init__(self) -> None:
        self.begun = self.ended = self.null = False
        self.open: list[Geom] = []
        self.ring: list[tuple] | None = None
        self.whole: Geom | None = None
        self.at = 0

    def fail(self, what: str) -> None:
        raise ValueError(f"event {self.at}: {what}")

    def push(self, event: str, kind: int | None, dims: int, c: tuple) -> None:
        if self.ended or self.begun == (event == "feat_start"):
            self.fail(f"{event} {'after the end' if self.ended else 'before the start' if not self.begun else 'twice'} of a feature")
        top = self.open[-1] if self.open else None
        if event == "feat_start":
            self.begun = True
        elif event == "null_feat":
            if self.whole or top:
                self.fail("null_feat inside a feature")
            self.null = True
        elif event == "geom_start":
            if self.null or self.whole or self.ring is not None or top and (top.kind < 4 or top.kind < 7 and kind != MEMBER[top.kind]) or kind not in range(1, 8):
                self.fail(f"geom_start of type {kind} has no place")
            self.open.append(Geom(kind, dims, [], []))
        elif event == "ring_start":
            if not top or top.kind != 3 or self.ring is not None:
                self.fail("ring_start outside of a polygon")
            self.ring = []
        elif event == "coord":
            if not top or (top.kind == 3) != (self.ring is not None) or top.kind > 3 or top.kind == 1 and top.points:
                self.fail("coord has no place")
            (top.points if self.ring is None else self.ring).append(c)
        elif event == "ring_end":
            if self.ring is None:
                self.fail("ring_end without a ring_start")
            top.parts.append(self.ring)
            self.ring = None
        elif event == "geom_end":
            if not top or self.ring is not None:
                self.fail("geom_end without a geom_start" if not top else "geom_end inside a ring")
            self.open.pop()
            if self.open:
                self.open[-1].parts.append(top)
            else:
                self.whole = top
        elif event == "feat_end":
            if self.open or not (self.whole or self.null):
                self.fail("feat_end before the end of a geometry")
            self.ended = True
        else:
            self.fail(f"unknown event '{event}'")
        self.at += 1

    def finish(self) -> Geom | None:
        if not self.ended:
            self.fail("no feat_end")
        return self.whole


def written(events: list[tuple]) -> bytes | None:
    """The binary of one feature's events (event, type, dimensions, ordinates), in order."""
    w = Writer()
    for e in events:
        w.push(*e)
    g = w.finish()
    return None if g is None else write_wkb(g)


def event_rows(e: pa.StructArray) -> list[tuple]:
    """Events as what the writer takes, by the column: a missing ordinate is not a number."""
    numbers = lambda name, none: pc.fill_null(e.field(name), none).to_numpy(zero_copy_only=False).tolist()
    names = e.field("event").dictionary_encode()
    known = [*names.dictionary.to_pylist(), None]
    event = [known[i] for i in pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False).tolist()]
    kind = [k or None for k in numbers("geometry_type", 0)]
    dims = numbers("dimensions", 0)
    coords = zip(*(numbers(o, float("nan")) for o in "xyzm"))
    pick = [lambda c: (), lambda c: c[:2], lambda c: c[:3], lambda c: (c[0], c[1], c[3]), lambda c: c]
    return [(v, k, d, pick[d](c)) for v, k, d, c in zip(event, kind, dims, coords)]


def assemble_wkb(events: DataFrame, name: str = "geometry") -> DataFrame:
    """The writer for any features: feat_id and ISO binary from numbered events of mixed, nested and null ones.

    A feature's events meet in one place, ordered by ``seq``; a missing number, an end without its start and whatever else
    is out of order is an error.
    """
    fields = ["seq", "event", "geometry_type", "dimensions", "x", "y", "z", "m"]
    grouped = events.groupBy("feat_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("e"))

    @F.arrow_udf("binary")
    def build(e: pa.Array) -> pa.Array:
        n = pc.list_value_length(e).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n)
        own = e.flatten()
        if (pc.fill_null(own.field("seq"), -1).to_numpy(zero_copy_only=False) != np.arange(len(own)) - np.repeat(ends - n, n)).any():
            raise ValueError("the numbers of a feature's events are not 0, 1, 2, ...")
        rows = event_rows(own)
        return pa.array([written(rows[at:to]) for at, to in zip((ends - n).tolist(), ends.tolist())], pa.binary())

    return grouped.select("feat_id", C.tag(build("e"), name, wkb_type()))


__all__ = ["Visitor", "assemble", "assemble_wkb", "box_bounds", "edges", "geometry_events", "handle", "parts", "vertices"]
