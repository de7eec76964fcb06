"""SQL names for the scalar operations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.geometry import parse_wkb, parse_wkt, write_wkt
from .functions.mixed import headers, srids, statuses, wkb_of


def register(spark: SparkSession) -> list[str]:
    """Register the functions with a session; returns their names.

    Text and binary functions are Arrow functions; box and point functions are
    SQL bodies, which the optimizer inlines.
    """

    def arrow(name: str, kind: str, f) -> str:
        @F.arrow_udf(kind)
        def convert(a: pa.Array) -> pa.Array:
            return f(a)

        spark.udf.register(name, convert)
        return name

    def texts(read):
        return lambda a: pa.array([None if v is None else write_wkt(read(v)) for v in a.to_pylist()], pa.string())

    names = [
        arrow("geom_wkt_from_wkb", "string", texts(parse_wkb)),
        arrow("geom_wkb_from_wkt", "binary", lambda a: wkb_of(a, True)),
        arrow("geom_wkt_normal", "string", texts(parse_wkt)),
        arrow("geom_wkb_status", "string", statuses),
        arrow("geom_wkb_srid", "bigint", srids),
        arrow("geom_wkb_code", "int", lambda a: headers(a, False)),
        arrow("geom_wkt_code", "int", lambda a: headers(a, True)),
    ]
    bodies = {
        "geom_point": "(x DOUBLE, y DOUBLE) RETURNS STRUCT<x: DOUBLE, y: DOUBLE> RETURN named_struct('x', coalesce(x, double('nan')), 'y', coalesce(y, double('nan')))",
        "geom_box": "(xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE) RETURNS STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE> RETURN named_struct('xmin', xmin, 'ymin', ymin, 'xmax', xmax, 'ymax', ymax)",
        "geom_boxes_meet": "(a STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>, b STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>) RETURNS BOOLEAN RETURN a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax",
        "geom_type_id": "(kind INT, dims INT, coord INT) RETURNS INT RETURN (dims - 1) * 1000 + (coord - 1) * 10000 + kind",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
        names.append(name)
    return names
