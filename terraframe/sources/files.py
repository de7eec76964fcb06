"""Sinks that write one file a task, and the file systems they reach.

Files are reached through Arrow's file systems (local and shared folders, S3, GCS, HDFS).
Tasks write under a hidden folder of their job; the commit moves the files of the
successful attempts into place and removes the rest, so a half-written file of a lost
executor is never seen.  What a task still writes after its job was given up stays hidden.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def paths_below(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path): the files below a path, listed by Spark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")


@dataclass
class Written(WriterCommitMessage):
    """A task's file under its hidden name; no name without rows."""

    hidden: str = ""
    name: str = ""


class FilesWriter(DataSourceArrowWriter):
    """One file for each task that has rows; subclasses fill it."""

    suffix = ""

    def __init__(self, schema: T.StructType, path: str, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, path, overwrite
        self.job = f"_writing-{uuid.uuid4().hex}"

    def fill(self, out: pa.NativeFile, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filled = (b for b in iterator if b.num_rows)
        first = next(filled, None)
        if first is None:
            return Written()
        fs, top = file_system(self.path)
        fs.create_dir(f"{top}/{self.job}", recursive=True)
        own = f"{uuid.uuid4().hex}{self.suffix}"

        def batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from filled

        with fs.open_output_stream(f"{top}/{self.job}/{own}") as out:
            self.fill(out, batches(), first.schema)
        return Written(f"{top}/{self.job}/{own}", own)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = file_system(self.path)
        fs.create_dir(top, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(top)) if f.type == pafs.FileType.File] if self.overwrite else []
        for k, m in enumerate(m for m in messages if m is not None and m.name):
            fs.move(m.hidden, f"{top}/part-{k:05d}-{m.name}")
        for path in old:
            fs.delete_file(path)
        self.clear(fs, top)
        with fs.open_output_stream(f"{top}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*file_system(self.path))

    def clear(self, fs: pafs.FileSystem, top: str) -> None:
        if fs.get_file_info(f"{top}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{top}/{self.job}")


def write_files(df: DataFrame, source: type[DataSource], path: str, mode: str) -> None:
    """Run a sink; ``mode``: error, append or overwrite."""
    fs, top = file_system(path)
    if mode == "error" and fs.get_file_info(top).type == pafs.FileType.Directory and fs.get_file_info(pafs.FileSelector(top)):
        raise ValueError(f"there are files at {path}")
    df.sparkSession.dataSource.register(source)
    df.write.format(source.name()).option("path", path).mode("overwrite" if mode == "overwrite" else "append").save()
