"""Column-wise vector operations: slice, gather, mask, concatenate, format, CRS and edges.

Rows of a DataFrame have no order, so positions refer to an explicit order key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import tag
from ..functions.wkb import as_wkb
from ..functions.wkt import wkt_to_wkb
from ..types import Encoding, GeomType, parse_field
from .kernels import format_wkt


#: Rows of a range of long sequences that are aimed at, and ranges: the search among more cuts is not compiled. Above LARGE times as many rows there are more.
RANGE, RANGES, LARGE = 1 << 19, 100, 8


class Ranges:
    """The rows dealt into ranges of their keys, nulls first, with the number of rows in each.

    A bounded sample of keys (60 a partition) gives the cuts; counts are taken in
    one pass over the keys, pre-aggregated: no row is moved.  There are as many ranges as
    shuffle partitions; with ``rows`` fewer of so many rows (RANGES at most), or more of LARGE times as many.
    """

    def __init__(self, df: DataFrame, order: list[str], rows: int | None = None):
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.df, self.order = df, order
        self.keys = [F.col(f"`{k}`") for k in order]
        narrow = df.select(*self.keys)
        total = narrow.count()
        if rows:
            parts = max(1, min(parts, RANGES, -(-total // rows)), -(-total // (LARGE * rows)))
        share = min(1.0, 60 * parts / max(total, 1))
        sample = narrow.sample(False, share, seed=1).orderBy(*self.keys).collect()
        step = max(1, len(sample) // parts)
        found = list(dict.fromkeys(tuple(r) for r in sample[step::step][: parts - 1]))
        self.cuts = [r for r in found if len(order) > 1 or r[0] is not None]
        self.types = [f.dataType for f in narrow.schema.fields]
        counts = {r[0]: r[1] for r in narrow.groupBy(self.part().alias("p")).count().collect()}  # a row for each part
        self.counts = [counts.get(i, 0) for i in range(len(self.cuts) + 1)]
        self.first = [sum(self.counts[:i]) for i in range(len(self.counts))]

    def below(self, cut: tuple) -> Column:
        """Keys less than a cut; of one key as a plain comparison, which a scan can use."""
        if len(self.order) == 1:
            return F.coalesce(self.keys[0] < F.lit(cut[0]).cast(self.types[0]), F.lit(True))
        return F.struct(*self.keys) < F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(cut, self.types, self.order)])

    def part(self) -> Column:
        """The number of a row's range: a search by halves, so few comparisons a row."""

        def half(a: int, b: int) -> Column:
            if a == b:
                return F.lit(a)
            m = (a + b) // 2
            return F.when(self.below(self.cuts[m]), half(a, m)).otherwise(half(m + 1, b))

        return half(0, len(self.cuts))

    def within(self, a: int, b: int) -> Column:
        """Keys in ranges a to b."""
        out = F.lit(True)
        if a:
            low = self.cuts[a - 1]
            out = self.keys[0] >= F.lit(low[0]).cast(self.types[0]) if len(self.order) == 1 else ~self.below(low)
        if b < len(self.cuts):
            high = self.cuts[b]
            less = self.keys[0] < F.lit(high[0]).cast(self.types[0]) if len(self.order) == 1 and a else self.below(high)
            out = less if not a else out & less
        return out

    def numbered(self, wanted: list[int] | None = None, name: str = "pos") -> DataFrame:
        """Rows with their 1-based positions; only those of the ``wanted`` ranges are read and moved."""
        df = self.df
        if wanted is not None:
            runs: list[list[int]] = []
            for p in wanted:
                if runs and runs[-1][1] == p - 1:
                    runs[-1][1] = p
                else:
                    runs.append([p, p])
            df = df.filter(reduce(lambda x, y: x | y, [self.within(a, b) for a, b in runs]) if runs else F.lit(False))
        base = F.element_at(F.array(*[F.lit(x).cast("long") for x in self.first]), F.col("__part") + 1)
        inside = F.row_number().over(Window.partitionBy("__part").orderBy(*self.keys))
        return df.withColumn("__part", self.part()).withColumn(name, inside + base).drop("__part")

    def holding(self, low: int, high: int) -> list[int]:
        """The ranges with positions from low to high."""
        return [i for i, (f, n) in enumerate(zip(self.first, self.counts)) if n and f < high and f + n >= low]


def positions(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Add 1-based positions in the order of unique keys, nulls first; no single task sees all rows."""
    return Ranges(df, order).numbered(name=name)


def long_sequences(df: DataFrame, by: str, order: list[str], value: Column, most: int) -> DataFrame:
    """The values of each ``by`` in order, in pieces of at most so many: by, first (the values before it), values.

    For few sequences of any length: no task and no row holds all of one.  Rows are dealt into ranges of
    their keys, numbered there in a sort that spills, and put together piece by piece.  What is broadcast
    is a row for each sequence and each range.
    """
    ranges = Ranges(df, [by, *order], RANGE)
    df = df.withColumn("__part", ranges.part())
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = df.groupBy("__part", by).count().select(F.col("__part").alias("__p"), F.col(by).alias("__by"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__part", by).orderBy(*order)) - 1
    tasks = max(4 * len(ranges.counts), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartition(tasks, "__part", by).select("__part", by, at.alias("__at"), value.alias("__v"))  # by number, so that ranges aren't put together again
    pieces = rows.groupBy("__part", by, F.floor(F.col("__at") / most).alias("__piece")).agg(F.sort_array(F.collect_list(F.struct("__at", "__v"))).alias("values"))
    found = pieces.join(F.broadcast(begins), (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")))
    return found.select(by, (F.col("__before") + F.col("__piece") * most).alias("first"), F.col("values.__v").alias("values"))


def slice_rows(df: DataFrame, order: list[str], start: int, length: int) -> DataFrame:
    """Rows at positions start..start+length-1, with their positions."""
    ranges = Ranges(df, order)
    return ranges.numbered(ranges.holding(start, start + length - 1)).filter(F.col("pos").between(start, start + length - 1))


def gather_rows(df: DataFrame, order: list[str], index: list[int]) -> DataFrame:
    """Rows at the given positions, in the given order (column ``at``); repeats and reversals are allowed."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, int(p)) for i, p in enumerate(index, 1)], "at long, pos long")
    ranges = Ranges(df, order)
    held = sorted({p for i in set(index) for p in ranges.holding(i, i)})
    return wanted.join(ranges.numbered(held), "pos")


def gather_table(df: DataFrame, order: list[str], index: DataFrame) -> DataFrame:
    """The columns of ``index`` with the rows at its positions (``pos``, from 1); repeats and any order are allowed.

    Both tables are distributed: only the numbers of ranges that hold wanted positions come to the driver, and
    only those ranges are read, numbered and joined.  Positions outside the table, and null ones, have no row.
    """
    ranges = Ranges(df, order)
    first = F.array(*[F.lit(x).cast("long") for x in ranges.first])
    part = F.size(F.filter(first, lambda f: f < F.col("pos"))) - 1
    held = sorted(r[0] for r in index.filter(F.col("pos").between(1, sum(ranges.counts))).select(part.alias("p")).distinct().collect())  # a row for each range
    held = [p for i in held for p in [max(k for k in range(i + 1) if ranges.counts[k])]]  # of ranges that begin alike the one with rows
    return index.join(ranges.numbered(sorted(set(held))), "pos")


def mask_rows(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where the mask is true."""
    return df.filter(mask)


def concat(frames: list[DataFrame], col: str) -> DataFrame:
    """UNION ALL of geometry columns.  CRS and edges must agree; mixed types all become WKB; one frame returns as it is."""
    types = [parse_field(f.schema[col], infer=True) for f in frames]
    first = types[0]
    for t in types[1:]:
        if (t.crs_type, t.crs) != (first.crs_type, first.crs):
            raise ValueError(f"CRS objects '{first.crs}' and '{t.crs}' are not equal")
        if t.edge_type != first.edge_type:
            raise ValueError("can't combine geometries with different edges")
    if len(frames) == 1:
        return frames[0]
    if len({t.id for t in types}) > 1:
        target = GeomType(encoding=Encoding.WKB).like(first)
        g = F.col(f"`{col}`")
        frames = [f.withColumn(col, tag(g if t.is_wkb else wkt_to_wkb(g) if t.is_wkt else as_wkb(g, t), col, target)) for f, t in zip(frames, types)]
    else:
        target = first
    out = reduce(DataFrame.unionByName, frames)
    return out.withMetadata(col, target.metadata)


def format_vector(g: Column, t: GeomType, width: int | None = None, digits: int = 7) -> Column:
    """``<WKT>`` with so many decimals, cut to the width (20 at least, 10 kept for decoration); null is ``<NA>``."""
    cap = -1 if width is None else max(width, 20) - 10
    return F.coalesce(F.concat(F.lit("<"), format_wkt(g, t, digits, cap), F.lit(">")), F.lit("<NA>"))


# -- metadata -----------------------------------------------------------------------


def _retag(df: DataFrame, col: str, t: GeomType) -> DataFrame:
    return df.withMetadata(col, t.metadata)


def get_crs(df: DataFrame, col: str) -> str | None:
    t = parse_field(df.schema[col], infer=True)
    return t.crs if t.crs_type else None


def set_crs(df: DataFrame, col: str, crs) -> DataFrame:
    """Another CRS, the same edges; coordinates are not changed."""
    return _retag(df, col, parse_field(df.schema[col], infer=True).with_crs(crs))


def is_geodesic(df: DataFrame, col: str) -> bool:
    return parse_field(df.schema[col], infer=True).is_geodesic


def set_geodesic(df: DataFrame, col: str, geodesic: bool) -> DataFrame:
    return _retag(df, col, parse_field(df.schema[col], infer=True).with_geodesic(geodesic))


def reinterpret(df: DataFrame, col: str, t: GeomType) -> DataFrame:
    """Another type over the same storage, lazily."""
    if df.schema[col].dataType.simpleString() != t.data_type.simpleString():
        raise ValueError(f"storage {df.schema[col].dataType.simpleString()} is not that of {t}")
    return _retag(df, col, t)
