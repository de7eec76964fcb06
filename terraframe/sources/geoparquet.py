"""Parquet files that other programs know as geometry, and scans that skip files by their bounds.

The sink is a Python data source.  Each task writes one file, with three notes in its
footer: "geo" (encodings, types, CRS, edges, this file's bounds, and the column that
covers each geometry with its box), the Arrow schema with extension names, and
Spark's own schema with the field metadata.

``cluster=True`` orders rows along a Z curve over the column's bounds before, so that
files and row groups cover small areas.

The scan reads footers in a Spark job, a task for some files each, keeps the files whose
bounds meet the asked box, and gives them to Spark's own Parquet reader, with the
box column's comparisons pushed down to row groups.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from ..functions import mixed
from ..functions.coords import tag
from ..operators.cast import as_geometry
from ..operators.kernels import box, box_agg
from ..types import CoordType, EdgeType, GeometryType, GeomType, is_geometry_field, parse_field, wkb_type
from .files import FilesWriter, file_system, paths_below, write_files
from .tables import extension_notes, loose

FORMAT = "terraframe_geo"
SPARK_KEY = "org.apache.spark.sql.parquet.row.metadata"
ENDS = ("xmin", "ymin", "xmax", "ymax")
#: Bits of the Z curve an axis.
BITS = 16
# Fixed values of the format: the names of encodings and types.
NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
MARKS = {0: "", 1: " Z", 2: " M", 3: " ZM"}


# -- writing --------------------------------------------------------------------------


@dataclass
class Bounds:
    """Bounds and type codes of a geometry column, so far."""

    ends: np.ndarray = field(default_factory=lambda: np.array([np.inf, np.inf, -np.inf, -np.inf]))
    codes: set[int] = field(default_factory=set)

    def add(self, boxes: pa.Array) -> None:
        ends = np.stack([boxes.field(e).to_numpy(zero_copy_only=False) for e in ENDS], axis=1) if len(boxes) else np.zeros((0, 4))
        ends = ends[(ends[:, 0] <= ends[:, 2]) & (ends[:, 1] <= ends[:, 3])]
        if len(ends):
            self.ends = np.concatenate([np.minimum(self.ends[:2], ends[:, :2].min(axis=0)), np.maximum(self.ends[2:], ends[:, 2:].max(axis=0))])


def cover(name: str) -> str:
    return f"{name}_box"


def geo_note(types: dict[str, GeomType], found: dict[str, Bounds]) -> dict:
    """The footer's "geo" note of one file."""
    columns = {}
    for name, t in types.items():
        note = {"encoding": "WKB" if t.is_wkb else GeometryType(t.geometry_type).name.lower(), "geometry_types": sorted(NAMES[c % 1000] + MARKS[c // 1000] for c in found[name].codes)}
        if t.crs_type:
            note["crs"] = json.loads(t.crs) if t.crs.lstrip().startswith("{") else t.crs
        else:
            note["crs"] = None
        note["edges"] = EdgeType(t.edge_type).name.lower()
        if not t.edge_type:
            note["covering"] = {"bbox": {e: [cover(name), e] for e in ENDS}}
        if found[name].ends[0] <= found[name].ends[2]:
            note["bbox"] = found[name].ends.tolist()
        columns[name] = note
    return {"version": "1.1.0", "primary_column": next(iter(types)), "columns": columns}


class GeoWriter(FilesWriter):
    suffix = ".parquet"

    def __init__(self, schema: T.StructType, path: str, overwrite: bool):
        super().__init__(schema, path, overwrite)
        self.types = {f.name: parse_field(f) for f in schema.fields if is_geometry_field(f) and parse_field(f).geometry_type != GeometryType.BOX}

    def fill(self, out: pa.NativeFile, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> None:
        named = [f.with_metadata(extension_notes(self.schema[f.name].metadata)) if f.name in self.types else f for f in schema]
        schema, found = pa.schema(named), {n: Bounds() for n in self.types}
        with pq.ParquetWriter(out, schema, compression="snappy") as writer:
            for batch in batches:
                for name, t in self.types.items():
                    if not t.edge_type:
                        found[name].add(batch.column(cover(name)))
                    values = batch.column(name)
                    if t.is_wkb:
                        found[name].codes |= set(mixed.codes(values, False).drop_null().unique().to_pylist())
                    elif values.null_count < len(values):
                        found[name].codes.add(int(t.geometry_type) + 1000 * (int(t.dimensions) - 1))
                writer.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=schema))
            writer.add_key_value_metadata({"geo": json.dumps(geo_note(self.types, found)), SPARK_KEY: self.schema.json()})


class GeoSource(DataSource):
    """The sink behind :func:`write_geoparquet`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> GeoWriter:
        return GeoWriter(schema, self.options["path"], overwrite)


def z_value(b: Column, extent: tuple[float, float, float, float]) -> Column:
    """The place of a box's centre on a Z curve over the extent; null for no box."""
    out = F.lit(0).cast("long")
    for k, (low, high) in enumerate((("xmin", "xmax"), ("ymin", "ymax"))):
        first, size = extent[k], (extent[k + 2] - extent[k]) or 1.0
        share = ((b[low] / 2 + b[high] / 2) - F.lit(first)) / F.lit(size)
        cell = F.least(F.greatest(F.floor(share * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")
        for i in range(BITS):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(cell, i).bitwiseAND(F.lit(1).cast("long")), 2 * i + k))
    return F.when((b["xmin"] <= b["xmax"]) & (b["ymin"] <= b["ymax"]), out)


def plain(df: DataFrame) -> DataFrame:
    """Geometry columns in an encoding that the format knows, each with its box beside it."""
    for name in [f.name for f in df.schema.fields if is_geometry_field(f)]:
        t = parse_field(df.schema[name])
        if t.is_native and t.geometry_type == GeometryType.BOX:
            continue
        if not t.is_native:
            want = wkb_type().like(t)
        else:
            want = GeomType(t.geometry_type, t.dimensions, CoordType.SEPARATE).like(t)
        if want.id != t.id:
            df = df.withColumn(name, as_geometry(F.col(f"`{name}`"), t, want, name))
        if want.edge_type:
            continue  # edges that are no straight lines leave the box of their ends
        bounds = box(F.col(f"`{name}`"), want)
        df = df.withColumn(cover(name), tag(bounds, cover(name), GeomType(GeometryType.BOX, 1, 1).like(t)))
    return df


def write_geoparquet(df: DataFrame, path: str, mode: str = "error", cluster: bool = False, files: int | None = None) -> None:
    """Write a table with one geometry column or more.

    ``mode``: error, append or overwrite; ``cluster``: along a Z curve of the first geometry column; ``files``:
    so many at most, else one for each partition.  Text becomes binary, packed ordinates become structs.
    """
    df = plain(df)
    if not any(is_geometry_field(f) and parse_field(f).geometry_type != GeometryType.BOX for f in df.schema.fields):
        raise ValueError("no geometry column")
    names = [f.name for f in df.schema.fields if is_geometry_field(f) and cover(f.name) in df.columns]
    if cluster and not names:
        raise ValueError("no geometry column with planar edges to cluster by")
    if cluster:
        extent = df.select(box_agg(F.col(f"`{names[0]}`"), parse_field(df.schema[names[0]])).alias("b")).first().b
        ends = tuple(float(np.clip(e, -1e300, 1e300)) for e in extent)
        z = z_value(F.col(f"`{cover(names[0])}`"), ends if ends[0] <= ends[2] else (0.0, 0.0, 1.0, 1.0))
        df = df.withColumn("__z", z)
        df = (df.repartitionByRange(files, "__z") if files else df.repartitionByRange("__z")).sortWithinPartitions("__z").drop("__z")
    elif files:
        df = df.coalesce(files)
    write_files(loose(df), GeoSource, path, mode)


# -- reading --------------------------------------------------------------------------


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, geo): every file below a path with its "geo" note (null without one); read in tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, notes = [], []
            for p in b.column(0).to_pylist():
                fs, name = file_system(p)
                with fs.open_input_file(name) as f:
                    meta = pq.read_metadata(f)
                rows.append(meta.num_rows)
                notes.append((meta.metadata or {}).get(b"geo"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.int64()), pa.array([n and n.decode() for n in notes], pa.string())], ["path", "rows", "geo"])

    return paths_below(spark, path, "*.parquet").mapInArrow(run, "path string, rows long, geo string")


def files_meeting(spark: SparkSession, path: str, name: str, ends: tuple[float, float, float, float]) -> list[str]:
    """The files whose bounds of a column meet the box, or aren't known; files without a coordinate don't."""

    def meets(notes: pa.Array) -> list[bool]:
        out = []
        for n in notes.to_pylist():
            note = json.loads(n)["columns"].get(name) if n else None
            if note is None:
                out.append(True)
                continue
            b = note.get("bbox")
            known = b is not None or cover(name) in [(v or [""])[0] for v in note.get("covering", {}).get("bbox", {}).values()]
            half = len(b) // 2 if b else 0
            out.append(not known if b is None else b[0] <= ends[2] and ends[0] <= b[half] and b[1] <= ends[3] and ends[1] <= b[half + 1])
        return out

    @F.arrow_udf("boolean")
    def kept(notes: pa.Array) -> pa.Array:
        return pa.array(meets(notes), pa.bool_())

    return sorted(r.path for r in footers(spark, path).filter(kept(F.col("geo"))).select("path").collect())  # names of files alone


def read_geoparquet(spark: SparkSession, path: str, meets: tuple[float, float, float, float] | None = None, column: str | None = None) -> DataFrame:
    """A table of :func:`write_geoparquet` with its geometry columns, boxes aside.

    ``meets``: (xmin, ymin, xmax, ymax); only rows whose bounds of ``column`` (the first geometry) meet it, from
    those files and row groups alone that may have some.
    """
    df = spark.read.parquet(path)
    covers = [f.name for f in df.schema.fields if f.name.endswith("_box") and f.name[:-4] in df.columns and is_geometry_field(f)]
    if meets is None:
        return df.drop(*covers)
    column = column or next(f.name for f in df.schema.fields if is_geometry_field(f))
    if cover(column) not in covers:
        raise ValueError(f"{column} has no box column")
    found = files_meeting(spark, path, column, meets)
    df = spark.read.schema(df.schema).parquet(*found) if found else df.limit(0)
    b = F.col(f"`{cover(column)}`")
    x0, y0, x1, y1 = (F.lit(float(e)) for e in meets)
    inside = (b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0) & (b["xmin"] <= b["xmax"]) & (b["ymin"] <= b["ymax"])
    return df.filter(inside).drop(*covers)


__all__ = ["write_geoparquet", "read_geoparquet", "footers", "files_meeting"]
