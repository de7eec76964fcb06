"""Nested coordinate arrays: one way to reach every level of every native type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import CoordType, GeometryType, GeomType, coord_type_of

NAN = float("nan")


def tag(col: Column, name: str, t: GeomType) -> Column:
    """Name a column and attach its type: every expression loses field metadata, so every result is tagged."""
    return col.alias(name, metadata=t.metadata)


def ordinate(c: Column, t: GeomType, name: str) -> Column:
    """An ordinate of a coordinate; NaN if the type has none of that name."""
    if name not in t.ordinates:
        return F.lit(NAN)
    return c[t.ordinates.index(name)] if t.coord_type == CoordType.INTERLEAVED else c.getField(name)


def coord(t: GeomType, **values: Column) -> Column:
    """A coordinate of the type from its ordinates."""
    vs = [values.get(o, F.lit(NAN)).cast("double") for o in t.ordinates]
    if t.coord_type == CoordType.INTERLEAVED:
        return F.array(*vs)
    return F.struct(*[v.alias(o) for v, o in zip(vs, t.ordinates)])


def nan_coord(t: GeomType) -> Column:
    return coord(t)


def is_nan_coord(c: Column, t: GeomType) -> Column:
    """All ordinates are NaN."""
    out = F.lit(True)
    for o in t.ordinates:
        out = out & F.isnan(ordinate(c, t, o))
    return out


def map_coords(g: Column, t: GeomType, f: Callable[[Column], Column], level: int | None = None) -> Column:
    """Apply ``f`` to every coordinate, whatever the nesting."""
    level = t.level if level is None else level
    return f(g) if level == 0 else F.transform(g, lambda x: map_coords(x, t, f, level - 1))


def recoord(g: Column, src: GeomType, dst: GeomType) -> Column:
    """Dimensions and layout of ``dst``: ordinates by name, missing ones NaN, extra ones gone."""
    if (src.dimensions, src.coord_type) == (dst.dimensions, dst.coord_type):
        return g
    return map_coords(g, src, lambda c: coord(dst, **{o: ordinate(c, src, o) for o in dst.ordinates}))


def all_coords(g: Column, t: GeomType) -> Column:
    """The flat array of a geometry's coordinates."""
    if t.level == 0:
        return F.array(g)
    for _ in range(t.level - 1):
        g = F.flatten(g)
    return g


def sequences(g: Column, t: GeomType) -> Column:
    """The array of a geometry's coordinate sequences."""
    if t.level == 0:
        return F.array(F.array(g))
    if t.level == 1:
        return F.array(g)
    return g if t.level == 2 else F.flatten(g)


def polygons(g: Column, t: GeomType) -> Column:
    """The array of a geometry's parts, each an array of sequences."""
    return g if t.level == 3 else F.array(sequences(g, t))


def empty_array(t: GeomType, level: int) -> Column:
    kind = coord_type_of(t.ordinates, t.coord_type).simpleString()
    for _ in range(level):
        kind = f"array<{kind}>"
    return F.array().cast(kind)


def is_empty(g: Column, t: GeomType) -> Column:
    """No coordinates, or only all-NaN ones; a box is empty if a minimum exceeds its maximum; null stays null."""
    if t.geometry_type == GeometryType.BOX:
        out = F.lit(False)
        for o in t.ordinates:
            out = out | (g.getField(o + "min") > g.getField(o + "max"))
        return F.when(g.isNotNull(), out)
    if t.level == 0:
        return F.when(g.isNotNull(), is_nan_coord(g, t))
    return F.forall(all_coords(g, t), lambda c: is_nan_coord(c, t))


def num_coords(g: Column, t: GeomType) -> Column:
    return F.when(g.isNotNull(), F.size(all_coords(g, t)))


def point_n(g: Column, t: GeomType, n: int) -> Column:
    """The n-th coordinate, from 1; from the end if negative; null outside."""
    return F.try_element_at(all_coords(g, t), F.lit(n))
