"""Arrow extension types of geometry columns, registered with pyarrow.

An array of such a type keeps its CRS and edges through concatenation, IPC and
Parquet without anybody carrying field metadata along.
"""

from __future__ import annotations

import pyarrow as pa

from ..functions.wkt import arrow_type
from ..types import EXTENSION_PREFIX, KINDS, CoordType, Encoding, GeometryType, GeomType


def storage_of(t: GeomType) -> pa.DataType:
    """The Arrow storage of a type."""
    if t.is_wkb:
        return pa.large_binary() if t.encoding == Encoding.LARGE_WKB else pa.binary()
    if t.is_wkt:
        return pa.large_string() if t.encoding == Encoding.LARGE_WKT else pa.string()
    if t.geometry_type == GeometryType.BOX:
        return pa.struct([(o + end, pa.float64()) for end in ("min", "max") for o in t.ordinates])
    if t.coord_type == CoordType.SEPARATE:
        return arrow_type(t)
    out = pa.list_(pa.field(t.ordinates, pa.float64()), len(t.ordinates))  # the list's child names the dimensions
    for _ in range(t.level):
        out = pa.list_(out)
    return out


class GeometryArrowType(pa.ExtensionType):
    """Base of the registered types; ``kind`` is the last part of the extension name."""

    kind = ""

    def __init__(self, storage: pa.DataType, metadata: str = "{}"):
        self.metadata = metadata
        super().__init__(storage, f"{EXTENSION_PREFIX}.{self.kind}")

    def __arrow_ext_serialize__(self) -> bytes:
        return self.metadata.encode()

    @classmethod
    def __arrow_ext_deserialize__(cls, storage: pa.DataType, serialized: bytes) -> GeometryArrowType:
        return cls(storage, serialized.decode())


CLASSES: dict[str, type[GeometryArrowType]] = {k: type(f"{k.title()}Type", (GeometryArrowType,), {"kind": k}) for k in KINDS}


def extension_type(t: GeomType) -> GeometryArrowType:
    return CLASSES[t.kind](storage_of(t), t.metadata_json())


def register_types() -> list[str]:
    """Register all types with pyarrow; those that are there already stay."""
    names = []
    for cls in CLASSES.values():
        own = cls(pa.binary() if cls.kind == "wkb" else pa.string() if cls.kind == "wkt" else pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        try:
            pa.register_extension_type(own)
        except pa.ArrowKeyError:
            pass
        names.append(own.extension_name)
    return names


def unregister_types() -> None:
    for cls in CLASSES.values():
        try:
            pa.unregister_extension_type(f"{EXTENSION_PREFIX}.{cls.kind}")
        except pa.ArrowKeyError:
            pass
