"""Well-known binary.

Spark has no expression between bytes and doubles, so coordinates go through Arrow
functions, a whole column's buffer at a time (see columnar.py); big-endian and
extended values and other types than the declared one are read value by value.
What the header alone tells (type code, dimensions) is built-in expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import CoordType, GeometryType, GeomType
from .columnar import assembled, disassembled, in_pieces, read_wkb
from .columnar import write_wkb as write_column
from .coords import coord
from .geometry import parse_wkb
from .mixed import srids, statuses, wkb_of
from .wkt import native_rows, with_rest


def _plain(a: pa.Array) -> list:
    """Python values with coordinates as tuples."""

    def fit(v):
        if isinstance(v, dict):
            return tuple(v.values())
        if v and isinstance(v[0], float):
            return tuple(v)
        return [fit(x) for x in v]

    return [None if v is None else fit(v) for v in a.to_pylist()]


def as_wkb(g: Column, t: GeomType, big_endian: bool = False) -> Column:
    """ISO WKB, little-endian unless asked; null stays null."""
    if t.is_wkb or t.is_wkt:
        wkt = t.is_wkt

        @F.arrow_udf("binary")
        def rewrite(a: pa.Array) -> pa.Array:
            return wkb_of(a, wkt, big_endian)

        return rewrite(g)
    if t.geometry_type == GeometryType.BOX:
        from ..operators.cast import box_to_polygon

        return as_wkb(box_to_polygon(g, t), GeomType(GeometryType.POLYGON, 1, CoordType.SEPARATE), big_endian)

    @F.arrow_udf("binary")
    def convert(a: pa.Array) -> pa.Array:
        return in_pieces(a, lambda part: write_column(disassembled(part, t), t, big_endian))

    return convert(g)


def native_from_wkb(a: pa.Array, t: GeomType) -> pa.Array:
    def read(part: pa.Array) -> pa.Array:
        flat = read_wkb(part, t)
        return with_rest(assembled(flat, t), flat, part, lambda xs: native_rows([parse_wkb(x) for x in xs], t))

    return in_pieces(a, read)


def _number(b: Column, at: int, little: Column) -> Column:
    """The double at a place: sign, exponent and mantissa put together by exact arithmetic."""
    h = F.hex(F.substring(b, at + 1, 8))
    swapped = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)])
    h = F.when(little, swapped).otherwise(h)
    high, low = (F.conv(F.substring(h, k, 8), 16, 10).cast("long") for k in (1, 9))
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF).cast("long"))
    fraction = F.shiftleft(high.bitwiseAND(F.lit(0xFFFFF).cast("long")), 32) + low
    # below 2^53 a whole number is a double, and a power of two times it as well
    whole = F.when(exponent == 0, fraction).otherwise(fraction + (1 << 52)).cast("double")
    size = whole * F.pow(F.lit(2.0), F.greatest(exponent, F.lit(1)) - 1075)
    size = F.when(exponent < 0x7FF, size).when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(F.shiftright(high, 31) == 1, -size).otherwise(size)


def from_wkb_regular(b: Column, t: GeomType) -> Column:
    """Points of binary by built-in expressions alone: null unless the value is a plain ISO point of the type, in either byte order."""
    if t.geometry_type != GeometryType.POINT:
        raise ValueError("built-in expressions read points")
    little = F.substring(b, 1, 1) == F.lit(b"\x01")
    values = {o: _number(b, 5 + 8 * i, little) for i, o in enumerate(t.ordinates)}
    plain = (F.octet_length(b) == 5 + 8 * len(t.ordinates)) & (little | (F.substring(b, 1, 1) == F.lit(b"\x00"))) & (_u32(b, 1) == 1 + 1000 * (int(t.dimensions) - 1))
    return F.when(plain, coord(t, **values))


def from_wkb(b: Column, t: GeomType, mode: str = "auto") -> Column:
    """Native geometry of a binary column (any byte order, ISO or extended codes).

    ``mode``: auto (any binary), regular (built-in expressions only, of points; other binary is an error).
    """
    if mode == "regular":
        bad = F.raise_error(F.concat(F.lit("Expected a plain point but got: "), F.left(F.hex(b), F.lit(200)))).cast(t.data_type)
        return F.when(b.isNull(), F.lit(None)).otherwise(F.coalesce(from_wkb_regular(b, t), bad))

    @F.arrow_udf(t.data_type.simpleString())
    def convert(a: pa.Array) -> pa.Array:
        return native_from_wkb(a, t)

    return convert(b)


def status(b: Column) -> Column:
    """OK, or why a strict reader refuses the value."""

    @F.arrow_udf("string")
    def read(a: pa.Array) -> pa.Array:
        return statuses(a)

    return read(b)


def srid(b: Column) -> Column:
    """The SRID of extended WKB, null without one."""

    @F.arrow_udf("long")
    def read(a: pa.Array) -> pa.Array:
        return srids(a)

    return read(b)


def _u32(b: Column, at: Column | int) -> Column:
    """The unsigned number at a place, in the value's byte order."""
    h = F.hex(F.substring(b, (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(4)))
    byte = lambda i: F.substring(h, 2 * i + 1, 2)
    little = F.concat(byte(3), byte(2), byte(1), byte(0))
    return F.conv(F.when(F.hex(F.substring(b, 1, 1)) == "01", little).otherwise(h), 16, 10).cast("long")


def type_code(b: Column) -> Column:
    """ISO code (type + 1000 * (dimensions - 1)) from the header, built-in expressions only."""
    code = _u32(b, 1)
    has_z, has_m = code.bitwiseAND(0x80000000) != 0, code.bitwiseAND(0x40000000) != 0
    low = code.bitwiseAND(0x00FFFFFF)
    iso = (low / 1000).cast("int")
    z, m = has_z | iso.isin(1, 3), has_m | iso.isin(2, 3)
    return (F.pmod(low, F.lit(1000)) + F.when(z, 1000).otherwise(0) + F.when(m, 2000).otherwise(0)).cast("int")


def has_coordinate(b: Column) -> Column:
    """Whether there is any coordinate; null for null.

    Most headers tell: those of points, lines and multipoints always, others if
    their first parts are not empty.  Only what is still open is read as a whole.
    """

    @F.arrow_udf("boolean")
    def read(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else any(True for _ in parse_wkb(x).coords()) for x in a.to_pylist()], pa.bool_())

    kind = F.pmod(_u32(b, 1).bitwiseAND(0x00FFFFFF), F.lit(1000))
    at = F.when(_u32(b, 1).bitwiseAND(0x20000000) != 0, 9).otherwise(5)  # behind an SRID
    n = _u32(b, at)
    first = F.when(kind == 3, _u32(b, at + 4) > 0).when(kind == 5, _u32(b, at + 9) > 0).when(kind == 6, (_u32(b, at + 9) > 0) & (_u32(b, at + 13) > 0))
    told = F.when(kind == 1, True).when(n == 0, False).when(kind.isin(2, 4), True).when(first, True)
    return F.when(b.isNotNull(), F.coalesce(told, read(F.when(told.isNull(), b))))
