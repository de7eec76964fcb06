"""Well-known text.

Writing is built-in expressions over the nested arrays.  Reading goes through one
Arrow function: regular text of the declared type is read from the column's buffer
as a whole (see columnar.py), all else (collections, mixed types, ``nan``, EMPTY
parts, errors with byte offsets) value by value.  ``mode="regular"`` does without
Python: text is checked against its grammar and read by built-in JSON parsing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import CoordType, Dimensions, GeometryType, GeomType
from .columnar import Flat, assembled, in_pieces, read_wkt
from .coords import coord, nan_coord, ordinate, recoord
from .geometry import Geom, parse_wkb, parse_wkt, to_native, write_wkt
from .mixed import codes, wkb_of
from .numbers import clamp, format_double


def dims_tag(t: GeomType) -> str:
    return {Dimensions.XY: "", Dimensions.XYZ: " Z", Dimensions.XYM: " M", Dimensions.XYZM: " ZM"}[Dimensions(t.dimensions)]


def as_wkt(g: Column, t: GeomType, precision: int = 16, flat_multipoint: bool = True, max_coords: int | None = None) -> Column:
    """WKT of a native column; null stays null.  ``max_coords``: write no more than so many of a sequence."""
    if t.is_wkt or t.is_wkb:
        return rewrite_wkt(g, t, precision, flat_multipoint)
    if t.geometry_type == GeometryType.BOX:
        from ..operators.cast import box_to_polygon

        poly = GeomType(GeometryType.POLYGON, Dimensions.XY, CoordType.SEPARATE)
        return as_wkt(box_to_polygon(g, t), poly, precision)
    num = lambda c: F.concat_ws(" ", *[format_double(ordinate(c, t, o), precision) for o in t.ordinates])

    def listed(a: Column, f) -> Column:
        return F.when(F.size(a) == 0, "EMPTY").otherwise(F.concat(F.lit("("), F.array_join(F.transform(a, f), ", "), F.lit(")")))

    line = lambda a: listed(a if max_coords is None else F.slice(a, 1, max_coords), num)
    body = {
        1: lambda: F.concat(F.lit("("), num(g), F.lit(")")),
        2: lambda: line(g),
        4: lambda: line(g) if flat_multipoint else listed(g, lambda c: F.concat(F.lit("("), num(c), F.lit(")"))),
        3: lambda: listed(g, line),
        5: lambda: listed(g, line),
        6: lambda: listed(g, lambda p: listed(p, line)),
    }[t.geometry_type]()
    name = GeometryType(t.geometry_type).name + dims_tag(t) + " "
    return F.when(g.isNotNull(), F.concat(F.lit(name), body))


def rewrite_wkt(col: Column, t: GeomType, precision: int = 16, flat_multipoint: bool = True) -> Column:
    """Serialized geometry (text or binary) to normal WKT."""
    read = parse_wkt if t.is_wkt else parse_wkb

    @F.arrow_udf("string")
    def convert(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else write_wkt(read(x), precision, flat_multipoint) for x in a.to_pylist()], pa.string())

    return convert(col)


# -- reading ------------------------------------------------------------------------

#: JSON's numbers: what the built-in reader takes; other spellings go to the second tier.
_NUM = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?"
_WS = r"[ \t\r\n]*"


def grammar(t: GeomType) -> str:
    """A regular expression for non-empty text of the type, with the body as its group."""
    width = len(t.ordinates)
    c = _WS + rf"[ \t\r\n]+".join([_NUM] * width) + _WS
    body = c
    for _ in range(max(t.level, 0)):
        # possessive: a loop that never gives back needs no stack, whatever the number of coordinates
        body = rf"\({body}(?:,{body})*+\){_WS}"
        if _ < t.level - 1:
            body = _WS + body
    if t.level == 0:
        body = rf"\({c}\){_WS}"
    name, mark = GeometryType(t.geometry_type).name, dims_tag(t).strip()
    mark = rf"[ \t\r\n]+{mark}" if mark else ""  # as the reader: a mark is a word of its own
    return rf"^{_WS}{name}{mark}{_WS}({body})$"


def regular_body(w: Column, t: GeomType) -> Column:
    """The body of regular text of the type, else the empty string."""
    return F.regexp_extract(w, grammar(t), 1)


def from_wkt_regular(w: Column, t: GeomType) -> Column:
    """First tier: null unless the text is regular and of the declared type."""
    width = len(t.ordinates)
    body = regular_body(w, t)
    if t.geometry_type == GeometryType.POINT:
        inner = F.split(F.trim(F.translate(body, "()\t\r\n", "     ")), " +")
        values = {o: F.try_element_at(inner, F.lit(i + 1)).try_cast("double") for i, o in enumerate(t.ordinates)}
        return F.when(body != "", coord(t, **values))
    pattern = r"([^\s,()]+)" + r"\s+([^\s,()]+)" * (width - 1)
    coords = F.regexp_replace(body, pattern, "[" + ",".join(f"${i + 1}" for i in range(width)) + "]")
    schema = "array<double>"
    for _ in range(t.level):
        schema = f"array<{schema}>"
    nested = F.from_json(F.translate(coords, "()", "[]"), schema)
    flat = GeomType(t.geometry_type, t.dimensions, CoordType.INTERLEAVED)
    return F.when(body != "", recoord(nested, flat, t))


def native_rows(geoms: list[Geom | None], t: GeomType) -> pa.Array:
    """Arrow array of a native type."""
    rows = [None if g is None else to_native(g, t.geometry_type, t.dimensions) for g in geoms]
    if t.coord_type == CoordType.SEPARATE:
        names = t.ordinates

        def named(v, level: int):
            return dict(zip(names, v)) if level == 0 else [named(x, level - 1) for x in v]

        rows = [None if r is None else named(r, t.level) for r in rows]
    return pa.array(rows, arrow_type(t))


def arrow_type(t: GeomType) -> pa.DataType:
    out = pa.list_(pa.float64()) if t.coord_type == CoordType.INTERLEAVED else pa.struct([(o, pa.float64()) for o in t.ordinates])
    for _ in range(t.level):
        out = pa.list_(out)
    return out


def with_rest(fast: pa.Array, flat: Flat, a: pa.Array, read) -> pa.Array:
    """``fast`` with the rows that were left put in from ``read`` (a list of values to an array)."""
    rest = np.flatnonzero(np.asarray(a.is_valid()) & ~flat.good)
    if not len(rest):
        return fast
    at = np.arange(len(a))
    at[rest] = len(a) + np.arange(len(rest))
    slow = read(a.take(pa.array(rest)).to_pylist())
    return pa.concat_arrays([fast, slow.cast(fast.type)]).take(pa.array(at))


def native_from_wkt(a: pa.Array, t: GeomType) -> pa.Array:
    def read(part: pa.Array) -> pa.Array:
        flat = read_wkt(part, t)
        return with_rest(assembled(flat, t), flat, part, lambda xs: native_rows([parse_wkt(x) for x in xs], t))

    return in_pieces(a, read)


def from_wkt_any(w: Column, t: GeomType) -> Column:
    """Any WKT that can become the type; errors name the byte."""

    @F.arrow_udf(t.data_type.simpleString())
    def convert(a: pa.Array) -> pa.Array:
        return native_from_wkt(a, t)

    return convert(w)


def from_wkt(w: Column, t: GeomType, mode: str = "auto") -> Column:
    """Native geometry of a text column.

    ``mode``: auto (any text), regular (built-in expressions only; other text than regular is an error).
    """
    if mode != "regular":
        return from_wkt_any(w, t)
    first = from_wkt_regular(w, t)
    return F.when(w.isNull(), F.lit(None)).otherwise(F.coalesce(first, F.raise_error(F.concat(F.lit("Expected regular text of the declared type but got: "), F.left(w, F.lit(200)))).cast(t.data_type)))


def wkt_to_wkb(w: Column) -> Column:
    @F.arrow_udf("binary")
    def convert(a: pa.Array) -> pa.Array:
        return wkb_of(a, True)

    return convert(w)


def empty_of(t: GeomType) -> Column:
    return nan_coord(t)


def text_code(w: Column) -> Column:
    """ISO code of each text, null for null and for what has no coordinate; text that can't be read is an error."""

    @F.arrow_udf("int")
    def read(a: pa.Array) -> pa.Array:
        return codes(a, True)

    return read(w)


__all__ = ["as_wkt", "from_wkt", "from_wkt_any", "from_wkt_regular", "rewrite_wkt", "wkt_to_wkb", "text_code", "clamp"]
