"""Geometry types on ordinary Spark types.

A geometry column is a Spark column plus field metadata: the extension name and
a JSON text with CRS and edge interpretation.  The Spark type alone does not
tell a line from a multipoint, so the metadata does.  All of this is driver-side
Python; executors see plain structs, arrays, strings and binaries.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from enum import IntEnum

from pyspark.sql import types as T

NAME_KEY, METADATA_KEY = "ARROW:extension:name", "ARROW:extension:metadata"
#: Names are ``<prefix>.<kind>``; any prefix is understood, this one is written.
EXTENSION_PREFIX = "terraframe"


# Fixed values of the interchange format.
class GeometryType(IntEnum):
    GEOMETRY = 0
    POINT = 1
    LINESTRING = 2
    POLYGON = 3
    MULTIPOINT = 4
    MULTILINESTRING = 5
    MULTIPOLYGON = 6
    GEOMETRYCOLLECTION = 7
    BOX = 990


class Dimensions(IntEnum):
    UNKNOWN = 0
    XY = 1
    XYZ = 2
    XYM = 3
    XYZM = 4


class CoordType(IntEnum):
    UNKNOWN = 0
    SEPARATE = 1
    INTERLEAVED = 2


class EdgeType(IntEnum):
    PLANAR = 0
    SPHERICAL = 1
    VINCENTY = 2
    THOMAS = 3
    ANDOYER = 4
    KARNEY = 5


class CrsType(IntEnum):
    NONE = 0
    UNKNOWN = 1
    PROJJSON = 2
    WKT2_2019 = 3
    AUTHORITY_CODE = 4
    SRID = 5


class Encoding(IntEnum):
    """Serialized types have ids of their own."""

    NATIVE = 0
    WKB = 100001
    LARGE_WKB = 100002
    WKT = 100003
    LARGE_WKT = 100004
    WKB_VIEW = 100005
    WKT_VIEW = 100006


ENUMS = {e.__name__: e for e in (GeometryType, Dimensions, CoordType, EdgeType, CrsType, Encoding)}
NATIVE_KINDS = {"point": 1, "linestring": 2, "polygon": 3, "multipoint": 4, "multilinestring": 5, "multipolygon": 6, "box": 990}
KINDS = ("wkb", "wkt", *NATIVE_KINDS)
ORDINATES = {Dimensions.XY: "xy", Dimensions.XYZ: "xyz", Dimensions.XYM: "xym", Dimensions.XYZM: "xyzm"}
#: Nesting of lists around a coordinate.
LEVELS = {1: 0, 2: 1, 3: 2, 4: 1, 5: 2, 6: 3}
CHILD_NAMES = {2: ["vertices"], 3: ["rings", "vertices"], 4: ["points"], 5: ["linestrings", "vertices"], 6: ["polygons", "rings", "vertices"]}
MULTI = {1: 4, 2: 5, 3: 6, 4: 4, 5: 5, 6: 6}
SIMPLE = {4: 1, 5: 2, 6: 3, 1: 1, 2: 2, 3: 3}
OGC_CRS84 = json.dumps(
    {
        "type": "GeographicCRS",
        "name": "WGS 84 (CRS84)",
        "datum_ensemble": {"name": "World Geodetic System 1984 ensemble", "members": [{"name": "World Geodetic System 1984 (Transit)"}], "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}, "accuracy": "2.0"},
        "coordinate_system": {
            "subtype": "ellipsoidal",
            "axis": [{"name": "Geodetic longitude", "abbreviation": "Lon", "direction": "east", "unit": "degree"}, {"name": "Geodetic latitude", "abbreviation": "Lat", "direction": "north", "unit": "degree"}],
        },
        "id": {"authority": "OGC", "code": "CRS84"},
    },
    separators=(",", ":"),
)


def enum_value(x: str | int, enum: str) -> int | None:
    """The value of a label or value, None if there is none."""
    e = ENUMS[enum]
    if isinstance(x, str):
        return int(e[x]) if x in e.__members__ else None
    return int(x) if x in [int(v) for v in e] else None


def enum_label(x: str | int, enum: str) -> str | None:
    v = enum_value(x, enum)
    return None if v is None else ENUMS[enum](v).name


def enum_value_scalar(x: str | int, enum: str) -> int:
    v = enum_value(x, enum)
    if v is None:
        raise ValueError(f"{enum} has no member {x}")
    return v


def make_type_id(geometry_type: int, dimensions: int, coord_type: int) -> int:
    if geometry_type == GeometryType.GEOMETRY or geometry_type == GeometryType.GEOMETRYCOLLECTION:
        return 0
    if geometry_type == GeometryType.BOX and coord_type == CoordType.INTERLEAVED:
        raise ValueError("a box has no interleaved form")
    return (dimensions - 1) * 1000 + (coord_type - 1) * 10000 + geometry_type


def split_type_id(type_id: int) -> tuple[int, int, int]:
    """Geometry type, dimensions and coordinate type of a native type id."""
    coord, rest = divmod(type_id, 10000)
    dims, kind = divmod(rest, 1000)
    return kind, dims + 1, coord + 1


def sanitize_crs(crs: str | dict | None) -> tuple[CrsType, str]:
    """Missing: NONE; a JSON object: PROJJSON; any other text: UNKNOWN."""
    if crs is None:
        return CrsType.NONE, ""
    if isinstance(crs, dict):
        return CrsType.PROJJSON, json.dumps(crs, separators=(",", ":"))
    try:
        if isinstance(json.loads(crs), dict):
            return CrsType.PROJJSON, crs
    except ValueError:
        pass
    return CrsType.UNKNOWN, crs


@dataclass(frozen=True)
class GeomType:
    geometry_type: int = 0
    dimensions: int = 0
    coord_type: int = 0
    encoding: int = 0
    crs_type: int = 0
    crs: str = ""
    edge_type: int = 0

    # -- identity -------------------------------------------------------------

    @property
    def id(self) -> int:
        return int(self.encoding) or make_type_id(self.geometry_type, self.dimensions, self.coord_type)

    @property
    def is_native(self) -> bool:
        return self.encoding == Encoding.NATIVE

    @property
    def is_wkt(self) -> bool:
        return self.encoding in (Encoding.WKT, Encoding.LARGE_WKT, Encoding.WKT_VIEW)

    @property
    def is_wkb(self) -> bool:
        return self.encoding in (Encoding.WKB, Encoding.LARGE_WKB, Encoding.WKB_VIEW)

    @property
    def kind(self) -> str:
        if self.is_native:
            return GeometryType(self.geometry_type).name.lower()
        return "wkt" if self.is_wkt else "wkb"

    @property
    def extension_name(self) -> str:
        return f"{EXTENSION_PREFIX}.{self.kind}"

    @property
    def ordinates(self) -> str:
        return ORDINATES[Dimensions(self.dimensions)]

    @property
    def level(self) -> int:
        return LEVELS[self.geometry_type]

    # -- storage --------------------------------------------------------------

    @property
    def data_type(self) -> T.DataType:
        if self.is_wkt:
            return T.StringType()
        if self.is_wkb:
            return T.BinaryType()
        if self.geometry_type == GeometryType.BOX:
            return T.StructType([T.StructField(o + end, T.DoubleType(), False) for end in ("min", "max") for o in self.ordinates])
        out: T.DataType = coord_type_of(self.ordinates, self.coord_type)
        for _ in range(self.level):
            out = T.ArrayType(out, False)
        return out

    @property
    def metadata(self) -> dict[str, str]:
        return {NAME_KEY: self.extension_name, METADATA_KEY: self.metadata_json(), "geometry_id": self.id}

    def field(self, name: str, nullable: bool = True) -> T.StructField:
        return T.StructField(name, self.data_type, nullable, self.metadata)

    def metadata_json(self, edges_first: bool = False) -> str:
        """CRS, then edges (or edges, CRS type, CRS with ``edges_first``); defaults are left out."""
        crs = self.crs if self.crs_type == CrsType.PROJJSON else json.dumps(self.crs, ensure_ascii=False)
        edges = [f'"edges":"{EdgeType(self.edge_type).name.lower()}"'] if self.edge_type else []
        if self.crs_type == CrsType.NONE:
            parts = edges
        elif edges_first:
            kind = [f'"crs_type":"{CrsType(self.crs_type).name.lower()}"'] if self.crs_type != CrsType.UNKNOWN else []
            parts = [*edges, *kind, f'"crs":{crs}']
        else:
            kind = [f'"crs_type":"{CrsType(self.crs_type).name.lower()}"'] if self.crs_type > CrsType.PROJJSON else []
            parts = [f'"crs":{crs}', *kind, *edges]
        return "{" + ",".join(parts) + "}"

    # -- algebra --------------------------------------------------------------

    def with_geometry_type(self, geometry_type: int | str) -> GeomType:
        return self._native(geometry_type=enum_value_scalar(geometry_type, "GeometryType"))

    def with_dimensions(self, dimensions: int | str) -> GeomType:
        return self._native(dimensions=enum_value_scalar(dimensions, "Dimensions"))

    def with_coord_type(self, coord_type: int | str) -> GeomType:
        return self._native(coord_type=enum_value_scalar(coord_type, "CoordType"))

    def _native(self, **changes: int) -> GeomType:
        if not self.is_native:
            raise ValueError("a serialized type has no geometry type, dimensions or coordinate type to change")
        out = replace(self, **changes)
        make_type_id(out.geometry_type, out.dimensions, out.coord_type)
        return out

    def with_edge_type(self, edges: int | str) -> GeomType:
        return replace(self, edge_type=enum_value_scalar(edges, "EdgeType"))

    def with_crs(self, crs: str | dict | None, crs_type: int | None = None) -> GeomType:
        kind, text = sanitize_crs(crs)
        return replace(self, crs=text, crs_type=int(kind if crs_type is None or kind == CrsType.NONE else crs_type))

    def with_crs_lon_lat(self) -> GeomType:
        return self.with_crs(OGC_CRS84)

    def like(self, other: GeomType) -> GeomType:
        """This type with the CRS and edges of another."""
        return replace(self, crs=other.crs, crs_type=other.crs_type, edge_type=other.edge_type)

    def xy(self) -> GeomType:
        return self.with_dimensions(1)

    def xyz(self) -> GeomType:
        return self.with_dimensions(2)

    def xym(self) -> GeomType:
        return self.with_dimensions(3)

    def xyzm(self) -> GeomType:
        return self.with_dimensions(4)

    def simple(self) -> GeomType:
        return self.with_geometry_type(SIMPLE[self.geometry_type])

    def multi(self) -> GeomType:
        return self.with_geometry_type(MULTI[self.geometry_type])

    @property
    def is_geodesic(self) -> bool:
        return self.edge_type != EdgeType.PLANAR

    def with_geodesic(self, geodesic: bool) -> GeomType:
        if geodesic == self.is_geodesic:
            return self
        return self.with_edge_type("SPHERICAL" if geodesic else "PLANAR")

    # -- display --------------------------------------------------------------

    def __str__(self) -> str:
        return self.describe()

    def describe(self, max_crs_size: int = 40) -> str:
        """Modifiers, name, dimensions and a bounded CRS."""
        words = []
        if self.encoding in (Encoding.LARGE_WKB, Encoding.LARGE_WKT):
            words.append("large")
        if self.encoding in (Encoding.WKB_VIEW, Encoding.WKT_VIEW):
            words.append("view")
        if self.edge_type:
            words.append(EdgeType(self.edge_type).name.lower())
        if self.coord_type == CoordType.INTERLEAVED:
            words.append("interleaved")
        dims = f"_{self.ordinates[2:]}" if self.dimensions > Dimensions.XY else ""
        crs = self.crs if self.crs_type <= CrsType.UNKNOWN else f"{CrsType(self.crs_type).name.lower()}:{self.crs}"
        crs = f"<{crs}>" if crs else ""
        if len(crs) >= max_crs_size:
            crs = crs[: max_crs_size - 4] + "...>"
        return " ".join([*words, self.extension_name + dims]) + crs

    def display(self) -> str:
        """Short form: edges, name, and the first characters of the CRS."""
        edges = EdgeType(self.edge_type).name.lower() + " " if self.edge_type else ""
        crs = "<crs: unspecified>" if not self.crs else f"<CRS: {self.crs[:27]}..." if len(self.crs) > 30 else f"<CRS: {self.crs}>"
        return f"{edges}{self.extension_name} {crs}"

    def properties(self) -> dict[str, object]:
        """The eight parsed properties."""
        return {"id": self.id, "geometry_type": self.geometry_type, "dimensions": self.dimensions, "coord_type": self.coord_type, "extension_name": self.extension_name, "crs_type": self.crs_type, "crs": self.crs, "edge_type": self.edge_type}


def coord_type_of(ordinates: str, coord_type: int) -> T.DataType:
    if coord_type == CoordType.INTERLEAVED:
        return T.ArrayType(T.DoubleType(), False)
    return T.StructType([T.StructField(o, T.DoubleType(), False) for o in ordinates])


# -- constructors -----------------------------------------------------------------


def _meta(t: GeomType, crs, edges) -> GeomType:
    return t.with_crs(crs).with_edge_type(edges)


def serialized_type(encoding: int | str, crs=None, edges: int | str = "PLANAR") -> GeomType:
    return _meta(GeomType(encoding=enum_value_scalar(encoding, "Encoding")), crs, edges)


def wkb_type(crs=None, edges="PLANAR") -> GeomType:
    return serialized_type("WKB", crs, edges)


def wkt_type(crs=None, edges="PLANAR") -> GeomType:
    return serialized_type("WKT", crs, edges)


def large_wkb_type(crs=None, edges="PLANAR") -> GeomType:
    return serialized_type("LARGE_WKB", crs, edges)


def large_wkt_type(crs=None, edges="PLANAR") -> GeomType:
    return serialized_type("LARGE_WKT", crs, edges)


def wkb_view_type(crs=None, edges="PLANAR") -> GeomType:
    return serialized_type("WKB_VIEW", crs, edges)


def wkt_view_type(crs=None, edges="PLANAR") -> GeomType:
    return serialized_type("WKT_VIEW", crs, edges)


def native_type(geometry_type: int | str, dimensions: int | str = "XY", coord_type: int | str = "SEPARATE", crs=None, edges: int | str = "PLANAR") -> GeomType:
    g = enum_value_scalar(geometry_type, "GeometryType")
    if g not in NATIVE_KINDS.values():
        raise ValueError("type_id not valid: no native form of this geometry type")
    d, c = enum_value_scalar(dimensions, "Dimensions"), enum_value_scalar(coord_type, "CoordType")
    make_type_id(g, d, c)
    return _meta(GeomType(g, d, c), crs, edges)


def point_type(**options) -> GeomType:
    return native_type("POINT", **options)


def linestring_type(**options) -> GeomType:
    return native_type("LINESTRING", **options)


def polygon_type(**options) -> GeomType:
    return native_type("POLYGON", **options)


def multipoint_type(**options) -> GeomType:
    return native_type("MULTIPOINT", **options)


def multilinestring_type(**options) -> GeomType:
    return native_type("MULTILINESTRING", **options)


def multipolygon_type(**options) -> GeomType:
    return native_type("MULTIPOLYGON", **options)


def box_type(**options) -> GeomType:
    return native_type("BOX", **options)


def type_from_id(type_id: int) -> GeomType:
    if type_id in [int(e) for e in Encoding if e]:
        return GeomType(encoding=type_id)
    g, d, c = split_type_id(type_id)
    if g not in NATIVE_KINDS.values() or d > 4 or c > 2 or (g == GeometryType.BOX and c == 2):
        raise ValueError(f"type_id not valid: {type_id}")
    return GeomType(g, d, c)


# -- parsing ------------------------------------------------------------------------


def parse_metadata(text: str | None) -> tuple[CrsType, str, EdgeType]:
    """CRS type, CRS and edges of a metadata text; unknown keys are skipped."""
    if not text:
        return CrsType.NONE, "", EdgeType.PLANAR

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    try:
        found = json.loads(text, object_pairs_hook=once)
        if not isinstance(found, dict):
            raise ValueError
    except ValueError:
        raise ValueError(f"Expected valid JSON metadata but got '{text}'") from None
    crs, kind = found.get("crs"), found.get("crs_type")
    if isinstance(crs, (bool, int, float, list)):
        raise ValueError(f"Expected crs as an object or a text but got {crs!r}")
    edges = found.get("edges", "planar")
    if not isinstance(edges, str) or edges.upper() not in EdgeType.__members__:
        raise ValueError(f"Unsupported value of edges: {edges!r}")
    if crs is None:
        return CrsType.NONE, "", EdgeType[edges.upper()]
    crs_kind = CrsType[kind.upper()] if isinstance(kind, str) and kind.upper() in CrsType.__members__ else CrsType.PROJJSON if isinstance(crs, dict) else CrsType.UNKNOWN
    if isinstance(crs, dict):
        crs = json.dumps(crs, separators=(",", ":"), ensure_ascii=False)
    return crs_kind, crs, EdgeType[edges.upper()]


def kind_of(name: str | None) -> str:
    if name is None:
        raise ValueError("extension_name must not be missing")
    kind = name.rpartition(".")[2]
    if kind not in KINDS:
        raise ValueError(f"Unrecognized extension name '{name}'")
    return kind


def _coord(t: T.DataType, what: str) -> tuple[int, int]:
    """Dimensions and coordinate type of a coordinate's storage."""
    if isinstance(t, T.StructType):
        names = "".join(t.names)
        for d, o in ORDINATES.items():
            if names == o:
                if any(not isinstance(f.dataType, T.DoubleType) for f in t.fields):
                    raise ValueError(f"Expected double ordinates for {what}")
                return int(d), int(CoordType.SEPARATE)
        raise ValueError(f"Unrecognized dimensions '{names}' for {what}")
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.DoubleType):
        return int(Dimensions.XY), int(CoordType.INTERLEAVED)
    raise ValueError(f"Unexpected storage type of coordinates for {what}: {t.simpleString()}")


def parse_storage(data_type: T.DataType, extension_name: str | None, metadata: str | None = None, type_id: int | None = None) -> GeomType:
    """The geometry type of a storage type and an extension name."""
    kind = kind_of(extension_name)
    crs_type, crs, edges = parse_metadata(metadata)
    if kind == "wkt":
        if not isinstance(data_type, T.StringType):
            raise ValueError(f"Expected a string storage for '{extension_name}' but got {data_type.simpleString()}")
        t = GeomType(encoding=type_id if type_id in (100003, 100004, 100006) else Encoding.WKT)
    elif kind == "wkb":
        if not isinstance(data_type, T.BinaryType):
            raise ValueError(f"Expected a binary storage for '{extension_name}' but got {data_type.simpleString()}")
        t = GeomType(encoding=type_id if type_id in (100001, 100002, 100005) else Encoding.WKB)
    elif kind == "box":
        names = data_type.names if isinstance(data_type, T.StructType) else []
        dims = next((d for d, o in ORDINATES.items() if names == [x + e for e in ("min", "max") for x in o]), None)
        if dims is None:
            raise ValueError(f"Expected the struct of a box for '{extension_name}' but got {data_type.simpleString()}")
        t = GeomType(GeometryType.BOX, dims, CoordType.SEPARATE)
    else:
        g, inner = NATIVE_KINDS[kind], data_type
        for name in CHILD_NAMES.get(g, []):
            if not isinstance(inner, T.ArrayType):
                raise ValueError(f"Expected a list of {name} for '{extension_name}' but got {inner.simpleString()}")
            inner = inner.elementType
        d, c = _coord(inner, f"'{extension_name}'")
        if c == CoordType.INTERLEAVED and type_id:
            d = split_type_id(type_id)[1]  # a list of doubles does not tell its dimensions
        t = GeomType(g, d, c)
    return replace(t, crs_type=int(crs_type), crs=crs, edge_type=int(edges))


def infer_from_storage(data_type: T.DataType) -> GeomType:
    """Storage without an extension: text is WKT, binary is WKB, a struct of ordinates is a point, of bounds a box."""
    if isinstance(data_type, T.StringType):
        return wkt_type()
    if isinstance(data_type, T.BinaryType):
        return wkb_type()
    if isinstance(data_type, T.StructType):
        return parse_storage(data_type, "storage.box" if data_type.names and data_type.names[0] == "xmin" else "storage.point")
    raise ValueError("Expected extension type")


def parse_field(field: T.StructField, extension_name: str | None = None, infer: bool = False) -> GeomType:
    """The geometry type of a field, from its metadata, the given name or (``infer``) its storage."""
    meta = field.metadata or {}
    name = extension_name if extension_name is not None else meta.get(NAME_KEY)
    if name is None:
        if infer:
            return infer_from_storage(field.dataType)
        raise ValueError("Expected extension type")
    return parse_storage(field.dataType, name, meta.get(METADATA_KEY), meta.get("geometry_id"))


def is_geometry_field(field: T.StructField) -> bool:
    name = (field.metadata or {}).get(NAME_KEY)
    return isinstance(name, str) and name.rpartition(".")[2] in KINDS


def as_geometry_field(field: T.StructField) -> T.StructField:
    """The field itself, or with the type its storage implies."""
    return field if is_geometry_field(field) else infer_from_storage(field.dataType).field(field.name, field.nullable)


def drop_extension(field: T.StructField) -> T.StructField:
    return T.StructField(field.name, field.dataType, field.nullable)
