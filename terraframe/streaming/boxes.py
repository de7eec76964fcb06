"""Geometry aggregates over streams.

Scalar operations are stateless and need nothing here.  Bounds and type sets
merge by minimum, maximum and union, so Spark keeps one small row of state for
each group and window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernels import box_agg, unique_geometry_types
from ..types import parse_field


def windowed_box(df: DataFrame, col: str, time: str, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Bounds, type codes and rows of each time window (and group); rows later than ``late`` are dropped by the watermark."""
    t = parse_field(df.schema[col], infer=True)
    g = F.col(f"`{col}`")
    held = df
    if df.isStreaming:  # watermarks need an instant
        held = df.withColumn(time, F.col(f"`{time}`").cast("timestamp")).withMetadata(col, t.metadata).withWatermark(time, late)
    keys = [F.window(time, window, slide) if slide else F.window(time, window), *[F.col(f"`{b}`") for b in by or []]]
    out = held.groupBy(*keys).agg(box_agg(g, t).alias("box"), unique_geometry_types(g, t).alias("types"), F.count(g).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *(by or []), "box.*", "types", "n")
