"""Geometries as Python objects: text and binary in and out.

Used inside Arrow functions where built-in expressions cannot express a format:
binary coordinates, mixed types, collections and irregular text.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed values of the formats.
NAMES = ["GEOMETRY", "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION"]
TAGS = ["", "", "Z", "M", "ZM"]  # by dimensions
WIDTH = [0, 2, 3, 3, 4]
MEMBER = {4: 1, 5: 2, 6: 3}
DEEPEST = 31

Coord = tuple[float, ...]


@dataclass(slots=True)
class Geom:
    """kind: 1 to 7; dims: 1 to 4; points: of 1 and 2; parts: rings (lists of points) of 3, members of 4 to 7."""

    kind: int
    dims: int
    points: list[Coord]
    parts: list

    def coords(self) -> Iterator[Coord]:
        if self.kind < 3:
            yield from self.points
        elif self.kind == 3:
            for r in self.parts:
                yield from r
        else:
            for g in self.parts:
                yield from g.coords()

    def sequences(self) -> Iterator[list[Coord]]:
        """Coordinate sequences; the points of a multipoint are one, and so are bare points of a collection."""
        if self.kind < 3:
            yield self.points
        elif self.kind == 3:
            yield from self.parts
        elif self.kind == 4:
            yield [c for g in self.parts for c in g.points]
        else:
            loose: list[Coord] = []
            for g in self.parts:
                if g.kind == 1:
                    loose += g.points
                else:
                    if loose:
                        yield loose
                        loose = []
                    yield from g.sequences()
            if loose:
                yield loose

    @property
    def code(self) -> int:
        return self.kind + 1000 * (self.dims - 1)


class ParseError(ValueError):
    pass


# -- text -------------------------------------------------------------------------

_SPACE = " \t\r\n"
_WORD = re.compile(r"[A-Za-z]+")
_NUMBER = re.compile(r"[^ \n\t\r,()]+")


class _Reader:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def skip(self) -> None:
        while self.i < len(self.s) and self.s[self.i] in _SPACE:
            self.i += 1

    def fail(self, what: str) -> None:
        raise ParseError(f"Expected {what} at byte {len(self.s[: self.i].encode())}")

    def peek(self) -> str:
        self.skip()
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self, ch: str) -> bool:
        if self.peek() == ch:
            self.i += 1
            return True
        return False

    def need(self, ch: str) -> None:
        if not self.take(ch):
            self.fail(f"'{ch}'")

    def word(self) -> str:
        self.skip()
        m = _WORD.match(self.s, self.i)
        return m[0] if m else ""

    def number(self) -> float:
        self.skip()
        m = _NUMBER.match(self.s, self.i)
        if not m or "_" in m[0] or m[0][0] == "+":
            self.fail("number")
        try:
            v = float(m[0])
        except ValueError:
            self.fail("number")
        self.i = m.end()
        return v

    def coord(self, width: int) -> Coord:
        return tuple(self.number() for _ in range(width))

    def empty_or_open(self) -> bool:
        """False for EMPTY, true after an opening parenthesis."""
        if self.take("("):
            return True
        if self.word() == "EMPTY":
            self.i += 5
            return False
        self.fail("'(' or 'EMPTY'")

    def items(self, read) -> list:
        if not self.empty_or_open():
            return []
        out = [read()]
        while self.take(","):
            out.append(read())
        if not self.take(")"):
            self.fail("',' or ')'")
        return out

    def point_body(self, dims: int) -> Geom:
        if not self.empty_or_open():
            return Geom(1, dims, [], [])
        c = self.coord(WIDTH[dims])
        self.need(")")
        return Geom(1, dims, [c], [])

    def multi_point(self, dims: int) -> Geom:
        if self.peek() == "(" or self.word() == "EMPTY":
            return self.point_body(dims)
        return Geom(1, dims, [self.coord(WIDTH[dims])], [])

    def geometry(self, depth: int = 0) -> Geom:
        if depth > DEEPEST:
            raise ParseError("too many nested geometries")
        tag = self.word()
        if tag not in NAMES[1:]:
            self.fail("geometry type")
        self.i += len(tag)
        kind, dims, mark = NAMES.index(tag), 1, self.word()
        if mark in TAGS[2:]:
            dims = TAGS.index(mark)
            self.i += len(mark)
        line = lambda: self.items(lambda: self.coord(WIDTH[dims]))
        rings = lambda: self.items(line)
        if kind == 1:
            return self.point_body(dims)
        if kind == 2:
            return Geom(2, dims, line(), [])
        if kind == 3:
            return Geom(3, dims, [], rings())
        if kind == 4:
            return Geom(4, dims, [], self.items(lambda: self.multi_point(dims)))
        if kind == 5:
            return Geom(5, dims, [], self.items(lambda: Geom(2, dims, line(), [])))
        if kind == 6:
            return Geom(6, dims, [], self.items(lambda: Geom(3, dims, [], rings())))
        return Geom(7, dims, [], self.items(lambda: self.geometry(depth + 1)))


def parse_wkt(text: str) -> Geom:
    r = _Reader(text)
    g = r.geometry()
    r.skip()
    if r.i < len(text):
        r.fail("end of input")
    return g


def number_text(v: float, precision: int = 16) -> str:
    """Fixed notation with at most so many decimals, half to even on the shortest digits; exponents above 1e17."""
    if math.isnan(v):
        return "nan"
    if math.isinf(v):
        return "-Infinity" if v < 0 else "Infinity"
    if abs(v) < 1e15 and v == int(v):
        return str(int(v))
    from decimal import ROUND_HALF_EVEN, Decimal

    d = Decimal(repr(v))
    precision = precision if 0 <= precision <= 16 else 16
    if abs(v) > 1e17:
        sign, digits, exp = d.as_tuple()
        point = len(digits) - 1 + exp
        m = Decimal((sign, digits, -(len(digits) - 1))).quantize(Decimal(1).scaleb(-precision), ROUND_HALF_EVEN)
        return f"{_strip(format(m, 'f'))}e+{point}"
    q = d.quantize(Decimal(1).scaleb(-precision), ROUND_HALF_EVEN) if d.as_tuple().exponent < -precision else d
    out = _strip(format(q, "f"))
    return "0" if out in ("-0", "") else out


def _strip(s: str) -> str:
    return s.rstrip("0").rstrip(".") if "." in s else s


def write_wkt(g: Geom, precision: int = 16, flat_multipoint: bool = True) -> str:
    num = lambda c: " ".join(number_text(v, precision) for v in c)
    seq = lambda cs: "(" + ", ".join(map(num, cs)) + ")" if cs else "EMPTY"
    nest = lambda xs: "(" + ", ".join(xs) + ")" if xs else "EMPTY"

    def body(x: Geom) -> str:
        if x.kind < 3:
            return seq(x.points)
        if x.kind == 3:
            return nest([seq(r) for r in x.parts])
        if x.kind == 4 and flat_multipoint:
            return nest([num(p.points[0]) if p.points else "EMPTY" for p in x.parts])
        if x.kind == 7:
            return nest([whole(p) for p in x.parts])
        return nest([body(p) for p in x.parts])

    def whole(x: Geom) -> str:
        return " ".join([NAMES[x.kind], *([TAGS[x.dims]] if TAGS[x.dims] else []), body(x)])

    return whole(g)


# -- binary -----------------------------------------------------------------------

#: What the strict reader can say.
STATUS = ("OK", "TOO_FEW_BYTES", "TOO_MANY_BYTES", "INVALID_ENDIAN", "INVALID_GEOMETRY_TYPE", "RECURSION_LIMIT")


class WkbError(ParseError):
    def __init__(self, status: str, at: int):
        super().__init__(f"{status} at byte {at}")
        self.status = status


def _wkb(data: bytes, at: int, depth: int, any_endian: bool) -> tuple[Geom, int, int | None]:
    if depth > 255:
        raise WkbError("RECURSION_LIMIT", at)
    if at + 5 > len(data):
        raise WkbError("TOO_FEW_BYTES", at)
    if data[at] > 1 and not any_endian:
        raise WkbError("INVALID_ENDIAN", at)
    end = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(end + "I", data, at + 1)
    at += 5
    srid = None
    z, m, with_srid = bool(code & 0x80000000), bool(code & 0x40000000), bool(code & 0x20000000)
    if with_srid:
        if at + 4 > len(data):
            raise WkbError("TOO_FEW_BYTES", at)
        (srid,) = struct.unpack_from(end + "I", data, at)
        at += 4
    code &= 0x00FFFFFF
    iso, kind = divmod(code, 1000)
    if not 1 <= kind <= 7 or iso > 3:
        raise WkbError("INVALID_GEOMETRY_TYPE", at)
    z, m = z or iso in (1, 3), m or iso in (2, 3)
    dims = 1 + z + 2 * m
    width = WIDTH[dims]

    def count() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise WkbError("TOO_FEW_BYTES", at)
        (n,) = struct.unpack_from(end + "I", data, at)
        at += 4
        return n

    def points(n: int) -> list[Coord]:
        nonlocal at
        if at + 8 * width * n > len(data):
            raise WkbError("TOO_FEW_BYTES", at)
        flat = struct.unpack_from(f"{end}{width * n}d", data, at)
        at += 8 * width * n
        return [flat[i : i + width] for i in range(0, len(flat), width)]

    if kind == 1:
        return Geom(1, dims, points(1), []), at, srid
    if kind == 2:
        return Geom(2, dims, points(count()), []), at, srid
    if kind == 3:
        return Geom(3, dims, [], [points(count()) for _ in range(count())]), at, srid
    parts = []
    for _ in range(count()):
        g, at, _ = _wkb(data, at, depth + 1, any_endian)
        parts.append(g)
    return Geom(kind, dims, [], parts), at, srid


def parse_wkb(data: bytes) -> Geom:
    """ISO and extended binary of either byte order; SRIDs and trailing bytes are ignored, truncation is an error."""
    return _wkb(data, 0, 0, True)[0]


def wkb_status(data: bytes) -> str:
    """The strict reader's verdict."""
    try:
        _, at, _ = _wkb(data, 0, 0, False)
    except WkbError as e:
        return e.status
    return "OK" if at == len(data) else "TOO_MANY_BYTES"


def wkb_srid(data: bytes) -> int | None:
    return _wkb(data, 0, 0, False)[2]


def write_wkb(g: Geom, big_endian: bool = False) -> bytes:
    """ISO binary; an empty point has NaN ordinates."""
    end, order = (">", b"\x00") if big_endian else ("<", b"\x01")
    pack = lambda cs, w: struct.pack(f"{end}{len(cs) * w}d", *[v for c in cs for v in c])
    head = order + struct.pack(end + "I", g.code)
    w = WIDTH[g.dims]
    if g.kind == 1:
        return head + pack(g.points or [(math.nan,) * w], w)
    n = lambda k: struct.pack(end + "I", k)
    if g.kind == 2:
        return head + n(len(g.points)) + pack(g.points, w)
    if g.kind == 3:
        return head + n(len(g.parts)) + b"".join(n(len(r)) + pack(r, w) for r in g.parts)
    return head + n(len(g.parts)) + b"".join(write_wkb(p, big_endian) for p in g.parts)


# -- native layouts -----------------------------------------------------------------


def redim(c: Coord, dims: int, to: int) -> Coord:
    """Ordinates by name: a missing one is NaN, an extra one goes."""
    if dims == to:
        return c
    have = dict(zip(("", "xy", "xyz", "xym", "xyzm")[dims], c))
    return tuple(have.get(o, math.nan) for o in ("", "xy", "xyz", "xym", "xyzm")[to])


def to_native(g: Geom, kind: int, dims: int):
    """Nested lists of coordinates of a native type (see cast.py for the rules)."""
    name = NAMES[kind]
    fit = lambda cs, d: [redim(c, d, dims) for c in cs]
    if kind == 1:
        cs = list(g.coords())
        if len(cs) > 1:
            raise ParseError("Can't convert feature with >1 coordinate to POINT")
        return redim(cs[0], g.dims, dims) if cs else (math.nan,) * WIDTH[dims]
    seqs = [fit(s, g.dims) for s in g.sequences() if s]
    if kind in (2, 4):
        if len(seqs) > 1:
            raise ParseError(f"Can't convert feature with >1 sequence to {name}")
        return seqs[0] if seqs else []
    if kind in (3, 5):
        return seqs
    parts = g.parts if g.kind in (6, 7) else [g]
    out = []
    for p in parts:
        rings = [fit(s, p.dims) for s in p.sequences() if s]
        if rings:
            out.append(rings)
    return out


def from_native(value, kind: int, dims: int) -> Geom:
    if kind == 1:
        return Geom(1, dims, [tuple(value)], [])
    if kind == 2:
        return Geom(2, dims, [tuple(c) for c in value], [])
    if kind == 3:
        return Geom(3, dims, [], [[tuple(c) for c in r] for r in value])
    return Geom(kind, dims, [], [from_native(v, MEMBER[kind], dims) for v in value])
