"""Text and binary columns of any types: what is regular is read by the column, the rest value by value."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..types import CoordType, GeomType
from . import columnar
from .columnar import Flat
from .geometry import parse_wkb, parse_wkt, wkb_srid, wkb_status, write_wkb

Part = tuple[np.ndarray, GeomType, Flat]


def regular(a: pa.Array, wkt: bool) -> tuple[list[Part], np.ndarray]:
    """(rows, type, their coordinates and counts) for each type in the column, and the rows that are left."""
    parts, left = [], np.asarray(a.is_valid()).copy()
    for rows, kind, dims in columnar.kinds_of(a, wkt):
        t = GeomType(kind, dims, CoordType.INTERLEAVED)
        flat = (columnar.read_wkt if wkt else columnar.read_wkb)(a.take(pa.array(rows)), t)
        left[rows[flat.good]] = False
        parts.append((rows, t, flat))
    return parts, np.flatnonzero(left)


def told(a: pa.Array, wkt: bool, kind: pa.DataType, fast: Callable[[GeomType, Flat], np.ndarray], slow: Callable) -> pa.Array:
    """One value a row: ``fast`` gives those of a type's regular rows (None: null), ``slow`` that of any other value."""
    out = np.full(len(a), None, object)
    parts, left = regular(a, wkt)
    for rows, t, flat in parts:
        out[rows[flat.good]] = fast(t, flat)
    for i in left.tolist():
        out[i] = slow(a[i].as_py())
    return pa.array(out, kind)


def codes(a: pa.Array, wkt: bool) -> pa.Array:
    """ISO codes; null for null and for what has no coordinate.  Values that can't be read are an error."""

    def slow(value) -> int | None:
        g = (parse_wkt if wkt else parse_wkb)(value)
        return g.code if next(g.coords(), None) is not None else None

    return told(a, wkt, pa.int32(), lambda t, flat: np.where(flat.per_row[flat.good] > 0, int(t.geometry_type) + 1000 * (int(t.dimensions) - 1), None), slow)


def headers(a: pa.Array, wkt: bool) -> pa.Array:
    """ISO codes, empty geometries included."""
    return told(a, wkt, pa.int32(), lambda t, flat: int(t.geometry_type) + 1000 * (int(t.dimensions) - 1), lambda v: (parse_wkt if wkt else parse_wkb)(v).code)


def readable(a: pa.Array, wkt: bool) -> pa.Array:
    def slow(value) -> bool:
        try:
            (parse_wkt if wkt else parse_wkb)(value)
        except ValueError:
            return False
        return True

    return told(a, wkt, pa.bool_(), lambda t, flat: np.True_, slow)


def statuses(a: pa.Array) -> pa.Array:
    """What the strict reader says of binary values."""
    return told(a, False, pa.string(), lambda t, flat: "OK", wkb_status)


def srids(a: pa.Array) -> pa.Array:
    return told(a, False, pa.int64(), lambda t, flat: None, wkb_srid)


def put_together(n: int, parts: list[tuple[np.ndarray, pa.Array]], kind: pa.DataType) -> pa.Array:
    """An array of n values from pieces for some rows each; other rows are null."""
    at = np.full(n, 0)
    arrays, size = [pa.nulls(1, kind)], 1
    for rows, values in parts:
        at[rows] = size + np.arange(len(rows))
        arrays.append(values.cast(kind))
        size += len(rows)
    return pa.concat_arrays(arrays).take(pa.array(at))


def wkb_of(a: pa.Array, wkt: bool, big_endian: bool = False) -> pa.Array:
    """ISO binary of a text or binary column."""
    parts, left = regular(a, wkt)
    read = parse_wkt if wkt else parse_wkb
    made = [(rows[flat.good], columnar.write_wkb(flat, t, big_endian).drop_null()) for rows, t, flat in parts]
    made.append((left, pa.array([write_wkb(read(v), big_endian) for v in a.take(pa.array(left)).to_pylist()], pa.binary())))
    return put_together(len(a), made, pa.binary())


__all__ = ["codes", "headers", "readable", "statuses", "srids", "wkb_of"]
