"""Casts between geometry types, dimensions and coordinate layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions.wkb import as_wkb, from_wkb
from ..functions.wkt import as_wkt, from_wkt, wkt_to_wkb
from ..types import CoordType, Dimensions, GeometryType, GeomType


def _error(t: GeomType, what: str) -> Column:
    return F.raise_error(F.lit(f"Can't convert feature with >1 {what} to {GeometryType(t.geometry_type).name}"))


def _filled(a: Column) -> Column:
    return F.filter(a, lambda s: F.size(s) > 0)


def box_to_polygon(g: Column, t: GeomType, dst: GeomType | None = None) -> Column:
    """The XY ring of a box; an empty box gives a polygon without rings."""
    dst = dst or GeomType(GeometryType.POLYGON, Dimensions.XY, CoordType.SEPARATE)
    corner = lambda x, y: C.coord(dst, x=g.getField("x" + x), y=g.getField("y" + y))
    ring = F.array(corner("min", "min"), corner("max", "min"), corner("max", "max"), corner("min", "max"), corner("min", "min"))
    return F.when(g.isNull(), F.lit(None)).when(C.is_empty(g, t), C.empty_array(dst, 2)).otherwise(F.array(ring))


def retype(g: Column, src: GeomType, dst: GeomType) -> Column:
    """Change the native geometry type; coordinates are already those of ``dst``.

    POINT takes one coordinate (none: NaN), LINESTRING and MULTIPOINT one
    sequence, POLYGON and MULTILINESTRING any sequences, MULTIPOLYGON any parts;
    empty sequences and parts are dropped.
    """
    a, b = src.geometry_type, dst.geometry_type
    if a == b and b not in (3, 5, 6):
        return g
    if b == GeometryType.POINT:
        flat = C.all_coords(g, src)
        return F.when(F.size(flat) > 1, _error(dst, "coordinate").cast(dst.data_type)).when(F.size(flat) == 1, F.try_element_at(flat, F.lit(1))).otherwise(C.nan_coord(dst))
    if src.level < 2 and dst.level == 1:
        return F.array(g) if src.level == 0 else g
    seqs = _filled(C.sequences(g, src))
    if dst.level == 1:
        return F.when(F.size(seqs) > 1, _error(dst, "sequence").cast(dst.data_type)).when(F.size(seqs) == 1, F.try_element_at(seqs, F.lit(1))).otherwise(C.empty_array(dst, 1))
    if dst.level == 2:
        return seqs
    return _filled(F.transform(C.polygons(g, src), _filled))


def cast(g: Column, src: GeomType, dst: GeomType, mode: str = "auto") -> Column:
    """``g`` as ``dst`` (without its metadata; see :func:`as_geometry`).  An identical type costs nothing."""
    if src.id == dst.id:
        return g
    if dst.is_wkt:
        return g if src.is_wkt else as_wkt(g, src)
    if dst.is_wkb:
        return g if src.is_wkb else wkt_to_wkb(g) if src.is_wkt else as_wkb(g, src)
    if dst.geometry_type == GeometryType.BOX:
        from .kernels import box

        if dst.dimensions != Dimensions.XY:
            raise ValueError("bounds are computed in XY; other ordinates of a box can only be dropped")
        return box(g, src)
    if src.is_wkt:
        return from_wkt(g, dst, mode)
    if src.is_wkb:
        return from_wkb(g, dst)
    if src.geometry_type == GeometryType.BOX:
        poly = GeomType(GeometryType.POLYGON, Dimensions.XY, dst.coord_type)
        return cast(box_to_polygon(g, src, poly), poly, dst)
    mid = GeomType(src.geometry_type, dst.dimensions, dst.coord_type)
    return F.when(g.isNotNull(), retype(C.recoord(g, src, dst), mid, dst))


def as_geometry(g: Column, src: GeomType, dst: GeomType, name: str, mode: str = "auto") -> Column:
    """Cast and tag; the result keeps the CRS and edges of the input."""
    return C.tag(cast(g, src, dst, mode), name, dst.like(src))


def as_xy(g: Column, src: GeomType, dimensions: int = Dimensions.XY) -> Column:
    """Point ordinates as a plain struct."""
    return cast(g, src, GeomType(GeometryType.POINT, dimensions, CoordType.SEPARATE))


def make_point(src_dims: str = "xy", **values: Column) -> Column:
    """A point from ordinate columns; a null or missing ordinate is NaN."""
    t = GeomType(GeometryType.POINT, {"xy": 1, "xyz": 2, "xym": 3, "xyzm": 4}[src_dims], CoordType.SEPARATE)
    return C.coord(t, **{k: F.coalesce(v.cast("double"), F.lit(float("nan"))) for k, v in values.items()})


def make_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for v, n in ((xmin, "xmin"), (ymin, "ymin"), (xmax, "xmax"), (ymax, "ymax"))])


def from_offsets(coords: Column, *offsets: Column) -> Column:
    """Nest a flat array by offset arrays, the innermost first."""
    out = coords
    for off in offsets:
        inner = out
        n = F.size(off)
        out = F.when(n < 2, F.slice(F.array(inner), 1, 0)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.slice(inner, F.element_at(off, i) + 1, F.element_at(off, i + 1) - F.element_at(off, i))))
    return out


def with_validity(g: Column, valid: Column) -> Column:
    """Null where ``valid`` is false; a missing validity is an error."""
    missing = F.raise_error(F.lit("validity must not contain missing values")).cast("boolean")
    return F.when(F.coalesce(valid, missing), g)


def round_precision(g: Column, t: GeomType, precision: float) -> Column:
    """All ordinates to the precision of a grid (see numbers.round_ordinate)."""
    from ..functions.numbers import round_ordinate

    return C.map_coords(g, t, lambda c: C.coord(t, **{o: round_ordinate(C.ordinate(c, t, o), precision) for o in t.ordinates}))
