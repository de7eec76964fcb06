"""Table functions for SQL text: the rows of a geometry, to be called with LATERAL.

``SELECT id, e.* FROM t, LATERAL geom_events(t.g) e``.  They are polymorphic: what they
return follows from the argument's type.  Text and binary hold any geometry; a
native column's storage is shared by some types, so its name is a second
argument where it isn't a point or a box: ``geom_vertices(g, 'linestring')``.

They call Python for each row.  For a native type that is known beforehand,
``register_native_events`` makes a table function of built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .functions.geometry import MEMBER, Geom, from_native, parse_wkb, parse_wkt
from .operators.visit import EVENT_SCHEMA, _Events, walk
from .types import LEVELS, CoordType, GeometryType, GeomType

_DIMS = {"xy": 1, "xyz": 2, "xym": 3, "xyzm": 4}


def described(g: AnalyzeArgument, kind: AnalyzeArgument | None) -> tuple[str, int, int]:
    """(wkt, wkb or native, type, dimensions) of an argument; type 0 and all dimensions for text and binary."""
    t, level = g.dataType, 0
    if isinstance(t, T.StringType):
        return "wkt", 0, 4
    if isinstance(t, T.BinaryType):
        return "wkb", 0, 4
    while isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.ArrayType, T.StructType)):
        t, level = t.elementType, level + 1
    if not isinstance(t, T.StructType) or "".join(t.fieldNames()) not in _DIMS:
        raise ValueError(f"a geometry is text, binary, or nested coordinates of x and y, not {g.dataType.simpleString()}")
    name = (kind.value if kind is not None else None) or ("point" if level == 0 else None)
    if name is None or name.upper() not in GeometryType.__members__:
        raise ValueError("the second argument names the type of nested coordinates: linestring, polygon, ...")
    found = GeometryType[name.upper()]
    if LEVELS.get(found) != level:
        raise ValueError(f"{name} has {LEVELS.get(found)} levels of lists, the column has {level}")
    return "native", int(found), _DIMS["".join(t.fieldNames())]


def as_tuples(v):
    """Rows of coordinates as tuples, lists as they are."""
    return tuple(v) if isinstance(v, T.Row) else [as_tuples(x) for x in v]


def read(g, encoding: str, kind: int, dims: int) -> Geom | None:
    if g is None:
        return None
    if encoding == "wkt":
        return parse_wkt(g)
    return parse_wkb(bytes(g)) if encoding == "wkb" else from_native(as_tuples(g), kind, dims)


def result(fields: list[tuple[str, T.DataType]]) -> AnalyzeResult:
    return AnalyzeResult(T.StructType([T.StructField(n, t) for n, t in fields]))


def ordinates(dims: int) -> str:
    return next(n for n, d in _DIMS.items() if d == dims)


class _Function:
    """Reads its argument; which type it is, is found by the first value's storage and the name."""

    def geometry(self, g, kind: str | None) -> Geom | None:
        if g is None or isinstance(g, (str, bytes, bytearray)):
            return read(g, "wkt" if isinstance(g, str) else "wkb", 0, 4)
        leaf = g
        while isinstance(leaf, list):
            if not leaf:
                break
            leaf = next((x for x in leaf if not isinstance(x, list) or x), [])
        dims = _DIMS["".join(leaf.__fields__)] if isinstance(leaf, T.Row) else 1
        return read(g, "native", int(GeometryType[(kind or "point").upper()]), dims)


class Vertices(_Function):
    """vertex (from 1) and ordinates of every coordinate."""

    @staticmethod
    def analyze(g: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        return result([("vertex", T.IntegerType()), *[(o, T.DoubleType()) for o in ordinates(described(g, kind)[2])]])

    def eval(self, g, kind=None) -> Iterator[tuple]:
        found = self.geometry(g, kind)
        if found is not None:
            wide = isinstance(g, (str, bytes, bytearray))
            for k, c in enumerate(found.coords(), 1):
                yield (k, *(spread(c, found.dims) if wide else c))


class Edges(_Function):
    """x0, y0, ..., x1, y1, ... of every pair of neighbouring coordinates; points give (v, v)."""

    @staticmethod
    def analyze(g: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        names = ordinates(described(g, kind)[2])
        return result([(f"{o}{k}", T.DoubleType()) for k in (0, 1) for o in names])

    def eval(self, g, kind=None) -> Iterator[tuple]:
        found = self.geometry(g, kind)
        if found is not None:
            wide = isinstance(g, (str, bytes, bytearray))
            for c in pairs(found):
                a, b = ((spread(x, found.dims) if wide else x) for x in c)
                yield (*a, *b)


class Events(_Function):
    """The traversal: the rows of geometry_events() without the feature's id."""

    FIELDS = [(n, {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}[k]) for n, k in (x.split() for x in EVENT_SCHEMA.split(", ")) if n != "feat_id"]

    @staticmethod
    def analyze(g: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        described(g, kind)
        return result(Events.FIELDS)

    def eval(self, g, kind=None) -> Iterator[tuple]:
        events = _Events()
        walk(self.geometry(g, kind), None, events)
        for row in events.rows:
            yield row[1:]


def spread(c: tuple[float, ...], dims: int) -> tuple:
    """x, y, z, m; null for what isn't there."""
    named = dict(zip(ordinates(dims), c))
    return tuple(named.get(o) for o in "xyzm")


def pairs(g: Geom) -> Iterator[tuple]:
    if g.kind in (1, 4):
        for c in g.coords():
            yield c, c
    elif g.kind == 7:
        for x in g.parts:
            yield from pairs(x)
    else:
        for s in g.sequences():
            yield from zip(s, s[1:])


def register_tables(spark: SparkSession) -> list[str]:
    """Register the table functions with a session; returns their names."""
    names = {"geom_vertices": Vertices, "geom_edges": Edges, "geom_events": Events}
    for name, handler in names.items():
        spark.udtf.register(name, udtf(handler))
    return list(names)


def native_events_sql(t: GeomType) -> str:
    """The events of a native column ``g`` as an array, in SQL text; see native_events()."""
    dims = int(t.dimensions)
    interleaved = t.coord_type == CoordType.INTERLEAVED
    ordinate = lambda c, o: f"{c}[{t.ordinates.index(o)}]" if interleaved else f"{c}.{o}"
    names = [n for n, _ in Events.FIELDS]

    def event(name: str, level: int, part, ring, coord_id, kind, dims_: int, c: str | None = None) -> str:
        integers = ["CAST(NULL AS INT)" if v is None else str(v) for v in (level, part, ring, coord_id, kind, dims_)]
        doubles = [ordinate(c, o) if c and o in t.ordinates else "CAST(NULL AS DOUBLE)" for o in "xyzm"]
        return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, [f"'{name}'", *integers, *doubles])) + ")"

    def there(cs: str) -> str:
        return f"filter({cs}, v -> NOT ({' AND '.join(f'isnan({ordinate("v", o)})' for o in t.ordinates)}))"

    def coords(cs: str, level: int, part, ring, kind: int) -> str:
        return f"transform({cs}, (c, k) -> {event('coord', level, part, ring, 'k', kind, dims, 'c')})"

    def one(x: str, kind: int, level: int, part) -> str:
        if kind < 3:
            own = there(f"array({x})" if kind == 1 else x)
            size, inner = f"size({own})", coords(own, level, part, None, kind)
        elif kind == 3:
            own = there("r")
            ring = f"concat(array({event('ring_start', level, part, 'i', f'size({own})', kind, dims)}), {coords(own, level, part, 'i', kind)}, array({event('ring_end', level, part, 'i', None, kind, dims)}))"
            size, inner = f"size({x})", f"flatten(transform({x}, (r, i) -> {ring}))"
        else:
            size, inner = f"size({x})", f"flatten(transform({x}, (m, p) -> {one('m', MEMBER[kind], level + 1, 'p')}))"
        return f"concat(array({event('geom_start', level, part, None, size, kind, dims)}), {inner}, array({event('geom_end', level, part, None, None, kind, dims)}))"

    plain = lambda name: f"array({event(name, 0, None, None, None, None, 0)})"
    return f"concat({plain('feat_start')}, CASE WHEN g IS NULL THEN {plain('null_feat')} ELSE {one('g', int(t.geometry_type), 0, 0)} END, {plain('feat_end')})"


def register_native_events(spark: SparkSession, name: str, t: GeomType) -> str:
    """Register a table function of the events of native columns of type ``t`` under ``name``, and return it.

    ``SELECT id, e.* FROM t, LATERAL name(t.g) e`` gives the rows of ``geom_events`` by built-in expressions: its SQL
    body is put in the place of the call, and only the columns that are asked for are made.
    """
    if not t.is_native or t.geometry_type > 6:
        raise ValueError("the events of a native type by its SQL body; geom_events reads the others")
    columns = ", ".join(f"{n} {k.simpleString()}" for n, k in Events.FIELDS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(g {t.data_type.simpleString()}) RETURNS TABLE({columns}) RETURN SELECT e.* FROM (SELECT explode({native_events_sql(t)}) AS e)")
    return name


__all__ = ["register_native_events", "register_tables"]
