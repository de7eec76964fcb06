"""Reads that carry their error: one value that can't be read doesn't fail the job."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columnar import assembled, read_wkb, read_wkt
from ..functions.coords import tag
from ..functions.geometry import parse_wkb, parse_wkt
from ..functions.mixed import put_together
from ..functions.wkt import arrow_type, native_rows
from ..sources.scratch import new_path
from ..types import GeomType, parse_field

_AT = re.compile(r"(.*?) at byte (\d+)$", re.S)


def told(error: ValueError) -> tuple[str, int | None]:
    """What is wrong, and the byte if the reader says where."""
    m = _AT.match(str(error))
    return (m[1], int(m[2])) if m else (str(error), None)


def try_read(g: Column, t: GeomType, dst: GeomType) -> Column:
    """struct(value, error, byte) of a text or binary column read as a native type.

    Of a value that can be read error and byte are null; of one that can't value is; of
    null all three are.  Regular values are read by the column, the others one by one.
    """
    if t.is_native or not dst.is_native:
        raise ValueError("text or binary is read as a native type")
    wkt, kind = t.is_wkt, dst.data_type.simpleString()
    parse = parse_wkt if wkt else parse_wkb

    @F.arrow_udf(f"struct<value:{kind},error:string,byte:long>")
    def read(a: pa.Array) -> pa.Array:
        flat = (read_wkt if wkt else read_wkb)(a, dst)
        good, left = np.flatnonzero(flat.good), np.flatnonzero(np.asarray(a.is_valid()) & ~flat.good)
        errors, places = np.full(len(a), None, object), np.full(len(a), None, object)
        own_rows, own = [], []
        for i in left.tolist():
            try:
                own.append(native_rows([parse(a[i].as_py())], dst))
                own_rows.append(i)
            except ValueError as e:
                errors[i], places[i] = told(e)
        fast = assembled(flat, dst)
        made = [(good, fast.take(pa.array(good)))] + [(np.array([i]), v) for i, v in zip(own_rows, own)]
        values = put_together(len(a), made, arrow_type(dst))
        return pa.StructArray.from_arrays([values, pa.array(errors, pa.string()), pa.array(places, pa.int64())], ["value", "error", "byte"], mask=pa.array(~np.asarray(a.is_valid())))

    return read(g)


def split_rejected(df: DataFrame, col: str, dst: GeomType, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected), both written in one pass over ``df``.

    clean has the column as the native type (null stays null); rejected has the rows as they came, with
    ``error`` and ``byte``.  ``path``: where the two tables go, else the application's own folder.
    """
    t = parse_field(df.schema[col], infer=True)
    clash = {"error", "byte", "rejected"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns named {', '.join(sorted(clash))}")
    spark, path = df.sparkSession, path or new_path(df.sparkSession, "read")
    read = df.withColumn("__r", try_read(F.col(f"`{col}`"), t, dst))
    wide = read.select("*", F.col("__r.value").alias("__value"), F.col("__r.error").alias("error"), F.col("__r.byte").alias("byte"), F.col("__r.error").isNotNull().alias("rejected")).drop("__r")
    # what was read is kept only where it is no rejected row, the source only where it is one
    wide = wide.withColumn(col, F.when(F.col("rejected"), F.col(f"`{col}`")))
    wide.write.partitionBy("rejected").parquet(path)
    both = spark.read.schema(wide.schema).parquet(path)
    columns = [F.col("__value").alias(c) if c == col else F.col(f"`{c}`") for c in df.columns]
    clean = both.filter(~F.col("rejected")).select(*columns)
    rejected = both.filter("rejected").select(*[F.col(f"`{c}`") for c in df.columns], "error", "byte")
    clean = clean.select(*[tag(F.col(f"`{c}`"), c, dst.like(t)) if c == col else F.col(f"`{c}`") for c in df.columns])
    return clean, rejected.withMetadata(col, t.metadata)


__all__ = ["try_read", "split_rejected"]
