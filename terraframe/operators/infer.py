"""The narrowest type that holds a column's geometries.

Inference is eager: a native column answers from its metadata, a serialized one
takes a single aggregation job.  It needs a full pass, so streams are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import MULTI, CoordType, GeometryType, GeomType, native_type, parse_field, wkb_type
from .kernels import unique_geometry_types


def type_from_codes(codes: list[int], promote_multi: bool = True, coord_type: int | str = CoordType.SEPARATE) -> GeomType:
    """One type of 1 to 6: itself; a simple type and its multi: the multi; anything else: WKB.  Dimensions add up."""
    kinds = {c % 1000 for c in codes}
    dims = [c // 1000 for c in codes]
    z, m = any(d in (1, 3) for d in dims), any(d in (2, 3) for d in dims)
    if len(kinds) == 1 and next(iter(kinds)) in range(1, 7):
        kind = next(iter(kinds))
    elif promote_multi and len(kinds) == 2 and min(kinds) in (1, 2, 3) and max(kinds) == MULTI[min(kinds)]:
        kind = max(kinds)
    else:
        return wkb_type()
    return native_type(GeometryType(kind).name, 1 + z + 2 * m, coord_type if isinstance(coord_type, str) else int(coord_type))


def infer_codes(df: DataFrame, col: str) -> list[int]:
    """Sorted distinct ISO codes of the column; one job, one small array to the driver."""
    t = parse_field(df.schema[col], infer=True)
    return list(df.agg(unique_geometry_types(F.col(f"`{col}`"), t)).first()[0])


def infer_schema(df: DataFrame, col: str, promote_multi: bool = True, coord_type: int | str = CoordType.SEPARATE) -> GeomType:
    """The inferred type with the column's CRS and edges."""
    if df.isStreaming:
        raise ValueError("inference needs a full pass over the data; a stream has none")
    t = parse_field(df.schema[col], infer=True)
    if t.is_native:
        return t
    return type_from_codes(infer_codes(df, col), promote_multi, coord_type).like(t)
