"""Tables in and out: Parquet with geometry metadata, Arrow, pandas, plain columns."""

from __future__ import annotations

import base64
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coords import tag
from ..operators.cast import as_geometry
from ..operators.kernels import box
from ..types import METADATA_KEY, NAME_KEY, NATIVE_KINDS, CrsType, EdgeType, Encoding, GeometryType, GeomType, is_geometry_field, kind_of, native_type, parse_field, parse_metadata, wkb_type, wkt_type
from .arrow_types import GeometryArrowType, extension_type


def geometry_columns(df: DataFrame) -> dict[str, GeomType]:
    return {f.name: parse_field(f) for f in df.schema.fields if is_geometry_field(f)}


def to_table(df: DataFrame, geometry: dict[str, GeomType] | GeomType | None = None) -> DataFrame:
    """Every geometry column converted: to the given type (one for all, or by name), else as it is."""
    for name, t in geometry_columns(df).items():
        target = geometry.get(name) if isinstance(geometry, dict) else geometry
        if target is not None:
            df = df.withColumn(name, as_geometry(F.col(f"`{name}`"), t, target, name))
    return df


# -- Parquet ------------------------------------------------------------------------


def write_parquet(df: DataFrame, path: str, mode: str = "error", with_boxes: bool = False) -> None:
    """Write with the field metadata that Spark keeps in the footer.

    ``with_boxes``: a box column beside each geometry (``<name>_box``), so that
    extent filters on its fields are pushed into the scan and prune row groups.
    """
    if with_boxes:
        for name, t in geometry_columns(df).items():
            df = df.withColumn(f"{name}_box", tag(box(F.col(f"`{name}`"), t), f"{name}_box", GeomType(GeometryType.BOX, 1, 1).like(t)))
    df.write.mode(mode).parquet(path)


def footer_types(metadata: dict[str, str]) -> dict[str, GeomType]:
    """Geometry types that other writers left in a footer: the "geo" key, or Arrow extension fields."""
    out: dict[str, GeomType] = {}
    geo = metadata.get("geo")
    if geo:
        for name, c in json.loads(geo).get("columns", {}).items():
            encoding = c.get("encoding", "WKB")
            t = wkb_type() if encoding.upper() == "WKB" else wkt_type() if encoding.upper() == "WKT" else native_type(encoding.upper())
            if c.get("crs") is not None:
                t = t.with_crs(c["crs"])
            if c.get("edges", "planar") != "planar":
                t = t.with_edge_type(c["edges"].upper())
            out[name] = t
    arrow = metadata.get("ARROW:schema")
    for f in pa.ipc.read_schema(pa.py_buffer(base64.b64decode(arrow))) if arrow else ():
        if isinstance(f.type, GeometryArrowType) or f.metadata and NAME_KEY.encode() in f.metadata:
            out[f.name] = arrow_field_type(f)
    return out


def arrow_field_type(f: pa.Field) -> GeomType:
    """The geometry type of an Arrow field of a registered type, or that carries an extension name of any prefix."""
    if isinstance(f.type, GeometryArrowType):
        f = pa.field(f.name, f.type.storage_type, metadata={NAME_KEY: f.type.extension_name, METADATA_KEY: f.type.metadata})
    meta = {k.decode(): v.decode() for k, v in (f.metadata or {}).items()}
    kind = kind_of(meta.get(NAME_KEY))
    crs_type, crs, edges = parse_metadata(meta.get(METADATA_KEY))
    t = f.type
    if kind == "wkb":
        out = GeomType(encoding=Encoding.LARGE_WKB if pa.types.is_large_binary(t) else Encoding.WKB)
    elif kind == "wkt":
        out = GeomType(encoding=Encoding.LARGE_WKT if pa.types.is_large_string(t) else Encoding.WKT)
    else:
        g = NATIVE_KINDS[kind]
        while pa.types.is_list(t) or pa.types.is_large_list(t):
            t = t.value_type
        if pa.types.is_fixed_size_list(t):
            dims = {"xy": 1, "xyz": 2, "xym": 3, "xyzm": 4}.get(t.value_field.name) or {2: 1, 3: 2, 4: 4}[t.list_size]
            out = GeomType(g, dims, 2)
        else:
            names = "".join(x.name for x in t)
            out = GeomType(g, {"xy": 1, "xyz": 2, "xym": 3, "xyzm": 4}.get(names, 1), 1)
    return GeomType(out.geometry_type, out.dimensions, out.coord_type, out.encoding, int(CrsType(crs_type)), crs, int(EdgeType(edges)))


def _footer(spark: SparkSession, path: str) -> dict[str, str]:
    """Key-value metadata of one file under a path, read by Spark's own Parquet and file systems."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    files = listing.load(path).select("path").limit(1).collect()
    if not files:
        return {}
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(files[0][0]), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        return dict(reader.getFileMetaData().getKeyValueMetaData())
    finally:
        reader.close()


def read_parquet(spark: SparkSession, path: str, geometry: dict[str, GeomType] | None = None) -> DataFrame:
    """Read Parquet; geometry types come from Spark's field metadata, the argument, or another writer's footer."""
    df = spark.read.parquet(path)
    found = dict(geometry or {})
    if not found and not geometry_columns(df):
        found = footer_types(_footer(spark, path))
    for name, t in found.items():
        if name in df.columns:
            df = df.withMetadata(name, t.metadata)
    return df


# -- Arrow and pandas ---------------------------------------------------------------


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A driver-side Arrow table (chunks included) with its extension fields as geometry columns."""
    types = {f.name: arrow_field_type(f) for f in table.schema if isinstance(f.type, pa.BaseExtensionType) or f.metadata and NAME_KEY.encode() in f.metadata}
    plain = pa.table({f.name: plain_column(table.column(f.name)) for f in table.schema})
    df = spark.createDataFrame(plain)
    for name, t in types.items():
        df = df.withMetadata(name, t.metadata)
    return df


def extension_notes(metadata: dict) -> dict[str, str]:
    """Of a column's metadata what Arrow keeps of an extension type."""
    return {k: str(v) for k, v in metadata.items() if k in (NAME_KEY, METADATA_KEY)}


def plain_type(t: pa.DataType) -> pa.DataType:
    if pa.types.is_fixed_size_list(t) or pa.types.is_list(t) or pa.types.is_large_list(t):
        return pa.list_(plain_type(t.value_type))
    if pa.types.is_struct(t):
        return pa.struct([(f.name, plain_type(f.type)) for f in t])
    if pa.types.is_large_binary(t) or str(t) == "binary_view":
        return pa.binary()
    if pa.types.is_large_string(t) or str(t) == "string_view":
        return pa.string()
    if pa.types.is_dictionary(t):
        return plain_type(t.value_type)
    if pa.types.is_float16(t):
        return pa.float32()
    if pa.types.is_unsigned_integer(t):
        return {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[t.bit_width]
    if pa.types.is_union(t):
        raise ValueError("unions have no Spark type")
    return t


def plain_column(c: pa.ChunkedArray) -> pa.ChunkedArray:
    if isinstance(c.type, pa.BaseExtensionType):
        c = pa.chunked_array([x.storage for x in c.chunks], c.type.storage_type)
    t = plain_type(c.type)
    if t == c.type:
        return c
    if pa.types.is_dictionary(c.type):
        c = pa.chunked_array([x.dictionary_decode() for x in c.chunks], c.type.value_type)
    try:
        return c.cast(t)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):  # null features over non-null ordinates
        return pa.chunked_array([pa.array(x.to_pylist(), t) for x in c.chunks], t)


def read_ipc(spark: SparkSession, source) -> DataFrame:
    """An Arrow IPC stream or file (path or bytes) of driver size."""
    data = source if isinstance(source, bytes) else pa.OSFile(source).read()
    try:
        table = pa.ipc.open_stream(data).read_all()
    except pa.ArrowInvalid:
        table = pa.ipc.open_file(pa.BufferReader(data)).read_all()
    return from_arrow(spark, table)


def _nullable(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in t.fields])
    return T.ArrayType(_nullable(t.elementType)) if isinstance(t, T.ArrayType) else t


def loose(df: DataFrame) -> DataFrame:
    """The same table whose nested values may be null: Arrow refuses null features over ordinates that can't be."""
    return df.select(*[F.col(f"`{f.name}`").cast(_nullable(f.dataType)).alias(f.name, metadata=f.metadata) for f in df.schema.fields])


def to_arrow(df: DataFrame, registered: bool = False) -> pa.Table:
    """All rows as an Arrow table whose fields carry the extension metadata again; for results of driver size.

    ``registered``: columns of pyarrow extension types instead (see arrow_types.py).
    """
    table = loose(df).toArrow()
    fields, columns = [], []
    for f, c in zip(table.schema, table.columns):
        s = df.schema[f.name]
        if is_geometry_field(s) and registered:
            kind = extension_type(parse_field(s))
            c = pa.chunked_array([pa.ExtensionArray.from_storage(kind, x.cast(kind.storage_type)) for x in c.chunks], kind)
            f = pa.field(f.name, kind)
        elif is_geometry_field(s):
            f = f.with_metadata(extension_notes(s.metadata))
        fields.append(f)
        columns.append(c)
    return pa.Table.from_arrays(columns, schema=pa.schema(fields))


def to_ipc(df: DataFrame) -> bytes:
    table = to_arrow(df)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def to_features(df: DataFrame):
    """All rows as a pandas frame, geometries as WKB; CRS texts in ``attrs``.  For results of driver size."""
    types = geometry_columns(df)
    if not types:
        raise ValueError("no geometry column")
    out = to_table(df, wkb_type()).toPandas()
    out.attrs["crs"] = {n: t.crs or None for n, t in types.items()}
    out.attrs["geometry"] = next(iter(types))
    return out


def empty(spark: SparkSession, t: GeomType, name: str = "geometry") -> DataFrame:
    """A zero-length column of a type."""
    return spark.createDataFrame([], T.StructType([t.field(name)]))
