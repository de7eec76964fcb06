"""The kernel set: scalar and aggregate operations over a geometry column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columnar
from ..functions import coords as C
from ..functions.geometry import parse_wkb, parse_wkt
from ..functions.mixed import readable
from ..functions.wkb import has_coordinate, type_code
from ..functions.wkt import as_wkt, text_code
from ..types import CoordType, Encoding, GeometryType, GeomType, parse_field, type_from_id
from .cast import as_geometry, box_to_polygon

INF = float("inf")


def _not_planar(t: GeomType) -> None:
    if t.edge_type:
        raise ValueError("a bounding box needs planar edges")


def _ends(g: Column, t: GeomType) -> list[Column]:
    """xmin, ymin, xmax, ymax over a geometry's coordinates in one pass; NaN is ignored (Spark would sort it last)."""
    names = ("a", "b", "c", "d")
    start = F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (INF, INF, -INF, -INF))])

    def step(s: Column, c: Column) -> Column:
        x, y = C.ordinate(c, t, "x"), C.ordinate(c, t, "y")
        low = lambda n, v: F.when(v < s[n], v).otherwise(s[n])
        high = lambda n, v: F.when((v > s[n]) & ~F.isnan(v), v).otherwise(s[n])
        return F.struct(low("a", x).alias("a"), low("b", y).alias("b"), high("c", x).alias("c"), high("d", y).alias("d"))

    found = F.aggregate(C.all_coords(g, t), start, step)
    return [found.getField(n) for n in names]


_ENDS = ("xmin", "ymin", "xmax", "ymax")


def boxes_of(a: pa.Array, wkt: bool) -> pa.Array:
    """Bounds of a serialized column: the regular values of each type as one array, the rest value by value."""
    out, open_ = np.zeros((len(a), 4)), np.asarray(a.is_valid()).copy()
    for rows, kind, dims in columnar.kinds_of(a, wkt):
        t = GeomType(kind, dims, CoordType.INTERLEAVED)
        flat = (columnar.read_wkt if wkt else columnar.read_wkb)(a.take(pa.array(rows)), t)
        done = rows[flat.good]
        out[done] = columnar.bounds(flat)
        open_[done] = False
    for i in np.flatnonzero(open_).tolist():
        cs = list((parse_wkt if wkt else parse_wkb)(a[i].as_py()).coords())
        x, y = [c[0] for c in cs if c[0] == c[0]], [c[1] for c in cs if c[1] == c[1]]
        out[i] = min(x, default=INF), min(y, default=INF), max(x, default=-INF), max(y, default=-INF)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(out[:, j])) for j in range(4)], list(_ENDS), mask=pa.array(~np.asarray(a.is_valid())))


def _serialized_box(g: Column, t: GeomType) -> Column:
    wkt = t.is_wkt

    @F.arrow_udf("struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    def bounds(a: pa.Array) -> pa.Array:
        return boxes_of(a, wkt)

    return bounds(g)


def box(g: Column, t: GeomType) -> Column:
    """XY bounds of each row: null for null, an inverted infinite box for empty."""
    _not_planar(t)
    if not t.is_native:
        return _serialized_box(g, t)
    if t.geometry_type == GeometryType.BOX:
        return box(box_to_polygon(g, t), GeomType(GeometryType.POLYGON, 1, 1))
    if t.level == 0:
        x, y = C.ordinate(g, t, "x"), C.ordinate(g, t, "y")
        ends = [F.when(F.isnan(v), sign * INF).otherwise(v) for sign in (1, -1) for v in (x, y)]
    else:
        ends = _ends(g, t)
    return F.when(g.isNotNull(), F.struct(*[e.alias(n) for e, n in zip(ends, ("xmin", "ymin", "xmax", "ymax"))]))


def box_agg(g: Column, t: GeomType) -> Column:
    """XY bounds over all rows or a group: partial sums merge, so it is one small row per task; never null."""
    _not_planar(t)
    if t.is_native and t.geometry_type == GeometryType.POINT:
        x, y = C.ordinate(g, t, "x"), C.ordinate(g, t, "y")
        ends = [F.coalesce(f(F.when(~F.isnan(v), v)), F.lit(e)) for f, e in ((F.min, INF), (F.max, -INF)) for v in (x, y)]
    else:
        b = box(g, t)
        ends = [F.coalesce(f(b.getField(n)), F.lit(e)) for f, n, e in ((F.min, "xmin", INF), (F.min, "ymin", INF), (F.max, "xmax", -INF), (F.max, "ymax", -INF))]
    return F.struct(*[e.alias(n) for e, n in zip(ends, ("xmin", "ymin", "xmax", "ymax"))])


def geometry_code(g: Column, t: GeomType) -> Column:
    """ISO code of each row by its first geometry with a coordinate; null for null and empty rows."""
    if t.is_native:
        kind = GeometryType.POLYGON if t.geometry_type == GeometryType.BOX else t.geometry_type
        code = F.lit(int(kind + 1000 * (t.dimensions - 1)))
        if t.geometry_type == GeometryType.BOX:
            return F.when(g.isNotNull() & ~C.is_empty(g, t), code)
        return F.when(g.isNotNull() if t.level == 0 else F.size(C.all_coords(g, t)) > 0, code)
    if t.is_wkb:
        return F.when(has_coordinate(g), type_code(g))
    return text_code(g)


def unique_geometry_types(g: Column, t: GeomType) -> Column:
    """Sorted distinct ISO codes (an array) over all rows or a group."""
    return F.sort_array(F.collect_set(geometry_code(g, t)))


def void(g: Column) -> Column:
    return F.lit(None).cast("void")


def void_agg(g: Column) -> Column:
    return F.max(F.lit(None).cast("void"))


def is_valid(g: Column, t: GeomType) -> Column:
    """Whether a serialized value can be read; null for null.  Native values always can."""
    if t.is_native:
        return F.when(g.isNotNull(), F.lit(True))
    wkt = t.is_wkt

    @F.arrow_udf("boolean")
    def check(a: pa.Array) -> pa.Array:
        return readable(a, wkt)

    return check(g)


def visit_void_agg(g: Column, t: GeomType) -> Column:
    """Reads everything; null, or an error if any row can't be read."""
    bad = F.count(F.when(~is_valid(g, t), 1))
    return F.when(bad > 0, F.raise_error(F.concat(bad.cast("string"), F.lit(" rows can't be read"))).cast("string"))


def format_wkt(g: Column, t: GeomType, precision: int = 16, max_element_size_bytes: int = -1) -> Column:
    """WKT, cut after so many bytes; only as many coordinates are written as the cut can show."""
    if max_element_size_bytes < 0:
        return as_wkt(g, t, precision)
    cap = max_element_size_bytes // 4 + 2 if t.is_native and t.geometry_type != GeometryType.BOX else None
    return F.left(as_wkt(g, t, precision, max_coords=cap), F.lit(max_element_size_bytes))


SCALAR = ("void", "format_wkt", "as_geometry", "as_wkt", "as_wkb", "box")
AGGREGATE = ("void_agg", "visit_void_agg", "box_agg", "unique_geometry_types_agg")


def kernel(name: str, df: DataFrame, col: str, **options) -> DataFrame:
    """Run a kernel by name on a tagged column: scalar kernels replace it, aggregates give their own rows."""
    t = parse_field(df.schema[col], infer=True)
    g = F.col(f"`{col}`")
    if name in ("as_geometry", "as_wkt", "as_wkb"):
        target = options.pop("type", {"as_wkt": Encoding.WKT, "as_wkb": Encoding.WKB}.get(name))
        if target is None:
            raise ValueError("Missing required parameter 'type'")
        dst = target if isinstance(target, GeomType) else type_from_id(int(target))
        return df.withColumn(col, as_geometry(g, t, dst, col))
    if name == "void":
        return df.withColumn(col, void(g))
    if name == "format_wkt":
        return df.withColumn(col, format_wkt(g, t, **options))
    if name == "box":
        return df.withColumn(col, C.tag(box(g, t), col, GeomType(GeometryType.BOX, 1, 1).like(t)))
    if name == "void_agg":
        return df.agg(void_agg(g).alias(col))
    if name == "visit_void_agg":
        return df.agg(visit_void_agg(g, t).alias(col))
    if name == "box_agg":
        return df.agg(C.tag(box_agg(g, t), col, GeomType(GeometryType.BOX, 1, 1).like(t)))
    if name == "unique_geometry_types_agg":
        return df.agg(unique_geometry_types(g, t).alias("codes")).select(F.explode("codes").alias(col))
    raise ValueError(f"No kernel named '{name}'")
