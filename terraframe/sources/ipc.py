"""Arrow IPC files of any size: a scan whose splits are record batches, and a sink.

The scan lists the files with Spark, reads their footers in tasks, and deals the record
batches out to tasks one by one; a task reads the asked columns of its batches alone
and drops rows that the asked comparisons exclude before they reach Spark.
The driver holds the schema of one file.  A file in the stream format has no footer
and is one split, read batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource
from pyspark.sql.pandas.types import from_arrow_schema

from ..types import NAME_KEY, GeomType, is_geometry_field
from .files import FilesWriter, file_system, paths_below, write_files
from .tables import arrow_field_type, extension_notes, loose, plain_column

#: Splits are dealt to so many tasks at most.
TASKS = 100_000
_MAGIC = b"ARROW1"
#: Comparisons that a scan takes: (column, sign, value).
SIGNS = {"==": pc.equal, "!=": pc.not_equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal, "in": lambda c, v: pc.is_in(c, pa.array(v, c.type))}
Comparison = tuple[str, str, object]


class IpcWriter(FilesWriter):
    suffix = ".arrow"

    def fill(self, out: pa.NativeFile, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> None:
        tagged = {f.name: extension_notes(f.metadata) for f in self.schema.fields if is_geometry_field(f)}
        schema = pa.schema([f.with_metadata(tagged[f.name]) if f.name in tagged else f for f in schema])
        with pa.ipc.new_file(out, schema) as writer:
            for b in batches:
                writer.write_batch(pa.RecordBatch.from_arrays(b.columns, schema=schema))


class IpcSink(DataSource):
    """The sink behind :func:`write_ipc_files`."""

    @classmethod
    def name(cls) -> str:
        return "terraframe_ipc"

    def writer(self, schema: T.StructType, overwrite: bool) -> IpcWriter:
        return IpcWriter(schema, self.options["path"], overwrite)


def write_ipc_files(df: DataFrame, path: str, mode: str = "error") -> None:
    """A file for each partition, record batches of the session's size, extension names in the schema."""
    write_files(loose(df), IpcSink, path, mode)


def opened(path: str) -> tuple[pa.NativeFile, bool]:
    """The file, and whether it has a footer."""
    fs, name = file_system(path)
    f = fs.open_input_file(name)
    with_footer = f.size() >= len(_MAGIC) and f.read_at(len(_MAGIC), 0) == _MAGIC
    f.seek(0)
    return f, with_footer


def schema_of(path: str) -> pa.Schema:
    f, with_footer = opened(path)
    with f:
        return (pa.ipc.open_file if with_footer else pa.ipc.open_stream)(f).schema


def record_batches(paths: DataFrame) -> DataFrame:
    """(path, batch): every record batch of the files; -1 for a whole stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                f, with_footer = opened(p)
                with f:
                    n = np.arange(pa.ipc.open_file(f).num_record_batches) if with_footer else np.array([-1])
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(n), pa.string()), pa.array(n, pa.int64())], ["path", "batch"])

    return paths.mapInArrow(run, "path string, batch long")


def geometry_of(schema: pa.Schema) -> dict[str, GeomType]:
    return {f.name: arrow_field_type(f) for f in schema if isinstance(f.type, pa.BaseExtensionType) or f.metadata and NAME_KEY.encode() in f.metadata}


def read_ipc_files(spark: SparkSession, path: str, columns: list[str] | None = None, where: list[Comparison] | None = None, pattern: str = "*.arrow") -> DataFrame:
    """The rows of all Arrow files below a path that are of one schema, geometry columns tagged.

    ``columns``: those that are read; ``where``: comparisons that rows must all pass, null never does; their
    columns need not be among those read.
    """
    where = list(where or [])
    for _, sign, _ in where:
        if sign not in SIGNS:
            raise ValueError(f"unknown comparison '{sign}'; known are {', '.join(SIGNS)}")
    paths = paths_below(spark, path, pattern)
    first = paths.first()
    if first is None:
        raise ValueError(f"no files like {pattern} at {path}")
    schema = schema_of(first[0])
    names = schema.names if columns is None else columns
    missing = [c for c in [*names, *(w[0] for w in where)] if c not in schema.names]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    empty = pa.table([plain_column(pa.chunked_array([], schema.field(c).type)) for c in names], names=names)
    needed = sorted({schema.get_field_index(c) for c in [*names, *(w[0] for w in where)]})

    def kept(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c, sign, value in where:
            b = b.filter(pc.fill_null(SIGNS[sign](b.column(c), value), False))
        if b.num_rows:
            t = pa.table([plain_column(pa.chunked_array([b.column(c)])) for c in names], names=names) if names else pa.table({})
            yield from t.cast(empty.schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcReadOptions(included_fields=needed)
        for splits in batches:
            for p, k in zip(splits.column(0).to_pylist(), splits.column(1).to_pylist()):
                f, _ = opened(p)
                with f:
                    if k >= 0:
                        yield from kept(pa.ipc.open_file(f, options=options).get_batch(k))
                    else:
                        for b in pa.ipc.open_stream(f, options=options):
                            yield from kept(b)

    splits = record_batches(paths)
    tasks = max(1, min(TASKS, splits.count()))
    # a hash deals the same way in every attempt
    out = splits.repartition(tasks, "path", "batch").mapInArrow(run, from_arrow_schema(empty.schema))
    for name, t in geometry_of(schema).items():
        if name in names:
            out = out.withMetadata(name, t.metadata)
    return out


__all__ = ["read_ipc_files", "write_ipc_files", "record_batches"]
