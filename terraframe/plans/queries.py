"""The query registry of the geometry operators, with the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions import wkb as B
from ..functions.numbers import format_double, round_ordinate
from ..functions.wkt import as_wkt, from_wkt
from ..operators import aggregate as A
from ..operators import cast as K
from ..operators import kernels as O
from ..operators import vector as V
from ..operators import visit as X
from ..operators.infer import infer_schema
from ..operators.join import box_join as join_boxes
from ..operators.rejects import split_rejected
from ..sources.geoparquet import read_geoparquet, write_geoparquet
from ..sources.ipc import read_ipc_files, write_ipc_files
from ..sources.scratch import new_path
from ..sources.tables import read_parquet, to_table, write_parquet
from ..sql import register
from ..table_functions import register_native_events
from ..types import GeomType, linestring_type, multilinestring_type, multipolygon_type, native_type, parse_field, point_type, polygon_type, wkb_type
from . import views as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def g() -> Column:
    return F.col("g")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def _typed(df: DataFrame, col: str = "g") -> GeomType:
    return parse_field(df.schema[col])


def _ends(b) -> list:
    return [b.getField(n).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")]


# -- scans and construction -----------------------------------------------------------


@query(f"SELECT id, CASE WHEN NOT missing THEN x END AS x, CASE WHEN NOT missing THEN y END AS y FROM {W.SQL_PTS}")
def make_point(spark, d):
    return W.pts(spark, d).select("id", "g.x", "g.y")


@query(f"SELECT id, CASE WHEN swapped THEN p + 10 ELSE p END AS xmin, CASE WHEN swapped THEN s + 5 ELSE s END AS ymin, CASE WHEN swapped THEN p ELSE p + 10 END AS xmax, CASE WHEN swapped THEN s ELSE s + 5 END AS ymax FROM {W.SQL_BOX}")
def make_box(spark, d):
    return W.boxes(spark, d).select("id", "g.*")


@query(f"SELECT id, w FROM {W.SQL_MIX}")
def scan_wkt(spark, d):
    return W.mix(spark, d)


@query(f"SELECT id, CASE WHEN NOT missing THEN x END AS x, CASE WHEN NOT missing THEN y END AS y FROM {W.SQL_PTS}")
def cast_wkt_point(spark, d):
    df = W.pts(spark, d)
    text = df.select("id", C.tag(as_wkt(g(), W.POINT), "w", W.WKT))
    return text.select("id", K.as_geometry(F.col("w"), W.WKT, W.POINT, "g")).select("id", "g.x", "g.y")


@query("SELECT o_orderkey AS id, round((o_totalprice + 1000)::DOUBLE * 10) / 10 AS x1, o_totalprice::FLOAT::DOUBLE AS x2, o_totalprice::DOUBLE AS x3 FROM orders")
def precision_round(spark, d):
    v = F.col("o_totalprice").cast("double")
    return W.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), round_ordinate(v + 1000, 10).alias("x1"), round_ordinate(v, -1).alias("x2"), round_ordinate(v, 0).alias("x3"))


@query(f"SELECT id, k AS part, CASE WHEN k = 1 THEN least(2, n) ELSE n - 2 END AS n FROM {W.SQL_VERTEX} WHERE k <= 2 AND (k = 1 OR n > 2)")
def from_offsets(spark, d):
    """Offsets 0, 2, n over an order's vertices: two rings, the second where there are more than two vertices."""
    n = F.size("g")
    off = F.when(n > 2, F.array(F.lit(0), F.lit(2), n)).otherwise(F.array(F.lit(0), n))
    rings = W.lns(spark, d).select("id", F.posexplode(K.from_offsets(g(), off)).alias("part", "ring"))
    return rings.select("id", (F.col("part") + 1).cast("long").alias("part"), F.size("ring").cast("long").alias("n"))


@query(f"SELECT id, CASE WHEN NOT missing THEN hex(ST_AsWKB(('POINT (' || x || ' ' || y || ')')::GEOMETRY)) END AS g FROM {W.SQL_PTS}")
def table_force_wkb(spark, d):
    return to_table(W.pts(spark, d), wkb_type()).select("id", F.hex("g").alias("g"))


@query(f"SELECT id, CASE WHEN NOT missing THEN x END AS x, CASE WHEN NOT missing THEN y END AS y, 1::BIGINT AS type_id FROM {W.SQL_PTS}")
def parquet_roundtrip(spark, d):
    path = new_path(spark, "roundtrip")
    write_parquet(W.pts(spark, d), path)
    df = read_parquet(spark, path)
    return df.select("id", "g.x", "g.y", F.lit(_typed(df).id).cast("long").alias("type_id"))


@query(f"SELECT id, x, y FROM {W.SQL_PTS} WHERE NOT missing AND x BETWEEN -90 AND -60.25 AND y BETWEEN 10 AND 40")
def geo_scan(spark, d):
    """Points in a box, from files in the order of a Z curve: files and row groups outside are skipped."""
    path = new_path(spark, "geo")
    write_geoparquet(W.pts(spark, d), path, cluster=True, files=16)
    return read_geoparquet(spark, path, meets=(-90, 10, -60.25, 40)).select("id", "g.x", "g.y")


@query(f"SELECT id, ST_AsText(w::GEOMETRY) AS w FROM {W.SQL_POL} WHERE p <= 300 AND p + 10 >= 200 AND s <= 30 AND s + 5 >= 20")
def geo_scan_polygons(spark, d):
    """Text polygons go out as binary and come back."""
    path = new_path(spark, "geo")
    write_geoparquet(W.pol(spark, d), path, cluster=True, files=4)
    df = read_geoparquet(spark, path, meets=(200, 20, 300, 30))
    return df.select("id", as_wkt(F.col("w"), wkb_type()).alias("w"))


@query(f"SELECT id, CASE WHEN NOT missing THEN x END AS x, CASE WHEN NOT missing THEN y END AS y FROM {W.SQL_PTS} WHERE id % 3 = 1 AND id >= 1000")
def ipc_scan(spark, d):
    """Points of many Arrow files, dealt out by record batches; one comparison is passed down to the scan."""
    path = new_path(spark, "ipc")
    write_ipc_files(W.pts(spark, d).withColumn("k", F.col("id") % 3).repartition(16, "id"), path)
    return read_ipc_files(spark, path, columns=["id", "g"], where=[("k", "==", 1), ("id", ">=", 1000)]).select("id", "g.x", "g.y")


@query(f"SELECT id, x, y FROM {W.SQL_PTS}")
def as_xy(spark, d):
    return W.pts_z(spark, d).select("id", K.as_xy(g(), W.POINT_Z).alias("p")).select("id", "p.x", "p.y")


@query(f"SELECT id, x FROM {W.SQL_PTS} WHERE NOT missing AND y > x")
def filter_select(spark, d):
    return W.pts(spark, d).filter("g.y > g.x").select("id", "g.x")


SQL_MEET = f"SELECT b.p::BIGINT AS part, a.id FROM {W.SQL_BOX} b, {W.SQL_PTS} a WHERE NOT b.swapped AND NOT a.missing AND a.x BETWEEN b.p AND b.p + 10 AND a.y BETWEEN b.s AND b.s + 5"


@query(SQL_MEET)
def box_join(spark, d):
    """Orders inside the boxes of parts; the empty boxes and the missing points meet nothing."""
    boxes = W.boxes(spark, d).select(F.col("id").alias("part"), C.tag(g(), "b", W.BOX))
    return join_boxes(boxes, W.pts(spark, d), "b", "g", columns=["part", "id"])


LINE_ENDS = f"(SELECT id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {W.SQL_VERTEX} GROUP BY id)"


@query(f"SELECT a.id AS a, b.id AS b FROM {LINE_ENDS} a JOIN {LINE_ENDS} b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 WHERE a.id % 50 = 0 AND b.id % 50 = 25")
def box_join_lines(spark, d):
    """Two sets of orders' lines whose bounds meet: large boxes that touch many cells."""
    lines = W.lns(spark, d)
    a, b = (lines.filter(F.col("id") % 50 == k).select(F.col("id").alias(n), C.tag(g(), f"g{n}", W.LINE)) for n, k in (("a", 0), ("b", 25)))
    return join_boxes(a, b, "ga", "gb", per_cell=200, columns=["a", "b"])


# -- types ------------------------------------------------------------------------------


@query("SELECT p_partkey AS part, (p_size % 6 + 1)::INT AS kind, (p_partkey % 4 + 1)::INT AS dims, (p_partkey % 2 + 1)::INT AS coord, (p_partkey % 4 * 1000 + p_partkey % 2 * 10000 + p_size % 6 + 1)::INT AS id FROM part")
def type_id(spark, d):
    """The id of each part's type, by the SQL name, against the codec's own ids."""
    register(spark)
    kinds = W.read(spark, d, "part").selectExpr("p_partkey AS part", "cast(p_size % 6 + 1 AS int) AS kind", "cast(p_partkey % 4 + 1 AS int) AS dims", "cast(p_partkey % 2 + 1 AS int) AS coord")
    known = [(k, dims, c, native_type(k, dims, c).id) for k in range(1, 7) for dims in range(1, 5) for c in (1, 2)]
    codec = F.broadcast(spark.createDataFrame(known, "kind int, dims int, coord int, id int"))
    by_name = kinds.withColumn("named", F.call_function("geom_type_id", "kind", "dims", "coord"))
    return by_name.join(codec, ["kind", "dims", "coord"]).filter("named = id").select("part", "kind", "dims", "coord", "id")


@query("SELECT * FROM (VALUES ('pts', 1, 'terraframe.point', 'terraframe.point'), ('lns', 2, 'terraframe.linestring', 'terraframe.linestring'), ('box', 990, 'terraframe.box', 'terraframe.box')) t(view, id, name, type)")
def schema_parse(spark, d):
    found = {n: _typed(f) for n, f in (("pts", W.pts(spark, d)), ("lns", W.lns(spark, d)), ("box", W.boxes(spark, d)))}
    return spark.createDataFrame([(n, t.id, t.extension_name, str(t)) for n, t in found.items()], "view string, id int, name string, type string")


# -- text and numbers ---------------------------------------------------------------------


@query("SELECT DISTINCT o_totalprice::DOUBLE AS v, regexp_replace(regexp_replace(printf('%.2f', o_totalprice::DOUBLE), '0+$', ''), '\\.$', '') AS s FROM orders")
def num_format(spark, d):
    v = F.col("o_totalprice").cast("double")
    return W.read(spark, d, "orders").select(v.alias("v")).distinct().select("v", format_double(F.col("v")).alias("s"))


@query(f"SELECT id, CASE WHEN NOT missing THEN ST_AsText(('POINT (' || x || ' ' || y || ')')::GEOMETRY) END AS w FROM {W.SQL_PTS}")
def as_wkt_point(spark, d):
    return W.pts(spark, d).select("id", as_wkt(g(), W.POINT).alias("w"))


@query(f"SELECT id, ST_AsText(('POINT Z (' || x || ' ' || y || ' ' || z || ')')::GEOMETRY) AS w FROM {W.SQL_PTS}")
def as_wkt_point_z(spark, d):
    return W.pts_z(spark, d).select("id", as_wkt(g(), W.POINT_Z).alias("w"))


@query(f"SELECT id, ST_AsText(('LINESTRING (' || body || ')')::GEOMETRY) AS w FROM {W.SQL_LINES}")
def as_wkt_linestring(spark, d):
    return W.lns(spark, d).select("id", as_wkt(g(), W.LINE).alias("w"))


@query(f"SELECT id, ST_AsText(('MULTIPOINT (' || body || ')')::GEOMETRY) AS w FROM {W.SQL_LINES}")
def as_wkt_multipoint(spark, d):
    return W.mpt(spark, d).select("id", as_wkt(g(), W.MPOINT).alias("w"))


@query(f"SELECT id, ST_AsText(('MULTILINESTRING ((' || body || '))')::GEOMETRY) AS w FROM {W.SQL_LINES}")
def as_wkt_multilinestring(spark, d):
    t = multilinestring_type()
    return W.lns(spark, d).select("id", as_wkt(F.array("g"), t).alias("w"))


@query(f"SELECT id, ST_AsText(w::GEOMETRY) AS w FROM {W.SQL_POL}")
def as_wkt_polygon(spark, d):
    t = polygon_type()
    return W.pol(spark, d).select("id", as_wkt(from_wkt(F.col("w"), t, "regular"), t).alias("w"))


MPL_TEXT = "'MULTIPOLYGON (((' || p || ' ' || s || ', ' || (p + 10) || ' ' || s || ', ' || (p + 10) || ' ' || (s + 5) || ', ' || p || ' ' || s || ')), ((' || (p + 100) || ' ' || s || ', ' || (p + 110) || ' ' || s || ', ' || (p + 110) || ' ' || (s + 5) || ', ' || (p + 100) || ' ' || s || ')))'"


@query(f"SELECT id, ST_AsText(({MPL_TEXT})::GEOMETRY) AS w FROM {W.SQL_POL}")
def as_wkt_multipolygon(spark, d):
    return W.mpl(spark, d).select("id", as_wkt(g(), W.MPOLY).alias("w"))


@query(f"SELECT id, 'POINT (' || regexp_replace(printf('%.1f', round_even(x, 1)), '\\.0$', '') || ' ' || regexp_replace(printf('%.1f', round_even(y, 1)), '\\.0$', '') || ')' AS w FROM {W.SQL_PTS} WHERE NOT missing")
def as_wkt_precision(spark, d):
    return W.pts(spark, d).filter(g().isNotNull()).select("id", as_wkt(g(), W.POINT, 1).alias("w"))


@query(f"SELECT id, left(ST_AsText(('LINESTRING (' || body || ')')::GEOMETRY), 24) AS w FROM {W.SQL_LINES}")
def format_wkt(spark, d):
    return W.lns(spark, d).select("id", O.format_wkt(g(), W.LINE, 16, 24).alias("w"))


@query(f"SELECT id, CASE WHEN missing THEN '<NA>' ELSE '<' || left(ST_AsText(('POINT (' || x || ' ' || y || ')')::GEOMETRY), 10) || '>' END AS s FROM {W.SQL_PTS}")
def format_vctr(spark, d):
    return W.pts(spark, d).select("id", V.format_vector(g(), W.POINT, 20).alias("s"))


@query(f"SELECT id, CASE WHEN NOT missing THEN x END AS x, CASE WHEN NOT missing THEN y END AS y FROM {W.SQL_PTS}")
def wkt_to_point(spark, d):
    text = W.pts(spark, d).select("id", as_wkt(g(), W.POINT).alias("w"))
    return text.select("id", from_wkt(F.col("w"), W.POINT, "regular").alias("g")).select("id", "g.x", "g.y")


@query(f"SELECT id, k AS vertex, x, y FROM {W.SQL_VERTEX}")
def wkt_to_linestring(spark, d):
    text = W.lns(spark, d).select("id", as_wkt(g(), W.LINE).alias("w"))
    return X.vertices(text.select("id", from_wkt(F.col("w"), W.LINE).alias("g")), "g", W.LINE).withColumn("vertex", F.col("vertex").cast("long"))


@query(f"SELECT id, k AS vertex, x, y FROM {W.SQL_VERTEX}")
def wkt_to_multipoint(spark, d):
    text = W.mpt(spark, d).select("id", as_wkt(g(), W.MPOINT, flat_multipoint=False).alias("w"))
    return X.vertices(text.select("id", from_wkt(F.col("w"), W.MPOINT).alias("g")), "g", W.MPOINT).withColumn("vertex", F.col("vertex").cast("long"))


@query(f"SELECT id, way, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * k) AS sxk FROM {W.SQL_LONG}, (VALUES ('text'), ('built-in'), ('binary')) w(way) GROUP BY id, way")
def long_lines(spark, d):
    """Lines of thousands of vertices and more through text, by both readers, and binary; vertices are numbered by whole lines."""
    written = W.long_lines(spark, d).select("id", "first", as_wkt(g(), W.LINE).alias("w"), B.as_wkb(g(), W.LINE).alias("b"))
    ways = {"text": from_wkt(F.col("w"), W.LINE), "built-in": from_wkt(F.col("w"), W.LINE, "regular"), "binary": B.from_wkb(F.col("b"), W.LINE)}
    read = written.select("id", "first", *[v.alias(k) for k, v in ways.items()])
    each = read.select("id", "first", F.explode(F.array(*[F.struct(F.lit(k).alias("way"), F.col(f"`{k}`").alias("g")) for k in ways])).alias("r")).select("id", "first", "r.way", "r.g")
    whole = X.vertices(each, "g", W.LINE).withColumn("k", F.col("first") + F.col("vertex"))
    return whole.groupBy("id", "way").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("k")).alias("sxk"))


POL_VERTICES = "SELECT id, v.k AS vertex, (p + v.dx)::DOUBLE AS x, (s + v.dy)::DOUBLE AS y FROM {src}, (VALUES (1::BIGINT, 0, 0), (2, 10, 0), (3, 10, 5), (4, 0, 0)) v(k, dx, dy)"


@query(POL_VERTICES.format(src=W.SQL_POL))
def wkt_to_polygon(spark, d):
    t = polygon_type()
    rings = W.pol(spark, d).select("id", from_wkt(F.col("w"), t, "regular").alias("g"))
    return X.vertices(rings, "g", t).withColumn("vertex", F.col("vertex").cast("long"))


@query(f"SELECT id, k AS vertex, x, y FROM {W.SQL_VERTEX}")
def wkt_to_multilinestring(spark, d):
    t = multilinestring_type()
    text = W.lns(spark, d).select("id", as_wkt(F.array("g"), t).alias("w"))
    return X.vertices(text.select("id", from_wkt(F.col("w"), t, "regular").alias("g")), "g", t).withColumn("vertex", F.col("vertex").cast("long"))


@query(POL_VERTICES.format(src=W.SQL_POL) + f" UNION ALL SELECT id, v.k AS vertex, (p + 100 + v.dx)::DOUBLE AS x, (s + v.dy)::DOUBLE AS y FROM {W.SQL_POL}, (VALUES (5::BIGINT, 0, 0), (6, 10, 0), (7, 10, 5), (8, 0, 0)) v(k, dx, dy)")
def wkt_to_multipolygon(spark, d):
    text = W.mpl(spark, d).select("id", as_wkt(g(), W.MPOLY).alias("w"))
    return X.vertices(text.select("id", from_wkt(F.col("w"), W.MPOLY, "regular").alias("g")), "g", W.MPOLY).withColumn("vertex", F.col("vertex").cast("long"))


# -- binary -------------------------------------------------------------------------------


@query(f"SELECT id, CASE WHEN NOT missing THEN hex(ST_AsWKB(('POINT (' || x || ' ' || y || ')')::GEOMETRY)) END AS b FROM {W.SQL_PTS}")
def as_wkb_point(spark, d):
    return W.pts(spark, d).select("id", B.as_wkb(g(), W.POINT).alias("b")).select("id", F.hex("b").alias("b"))


@query(f"SELECT id, hex(ST_AsWKB(('LINESTRING (' || body || ')')::GEOMETRY)) AS b FROM {W.SQL_LINES}")
def as_wkb_linestring(spark, d):
    return W.lns(spark, d).select("id", B.as_wkb(g(), W.LINE).alias("b")).select("id", F.hex("b").alias("b"))


@query(f"SELECT id, hex(ST_AsWKB(w::GEOMETRY)) AS b FROM {W.SQL_POL}")
def as_wkb_polygon(spark, d):
    t = polygon_type()
    rings = W.pol(spark, d).select("id", from_wkt(F.col("w"), t, "regular").alias("g"))
    return rings.select("id", B.as_wkb(g(), t).alias("b")).select("id", F.hex("b").alias("b"))


@query(f"SELECT id, hex(ST_AsWKB(('MULTIPOINT (' || body || ')')::GEOMETRY)) AS b FROM {W.SQL_LINES}")
def as_wkb_multipoint(spark, d):
    return W.mpt(spark, d).select("id", B.as_wkb(g(), W.MPOINT).alias("b")).select("id", F.hex("b").alias("b"))


@query(f"SELECT id, hex(ST_AsWKB(({MPL_TEXT})::GEOMETRY)) AS b FROM {W.SQL_POL}")
def as_wkb_multipolygon(spark, d):
    return W.mpl(spark, d).select("id", B.as_wkb(g(), W.MPOLY).alias("b")).select("id", F.hex("b").alias("b"))


@query(f"SELECT id, CASE WHEN NOT missing THEN x END AS x, CASE WHEN NOT missing THEN y END AS y FROM {W.SQL_PTS}")
def wkb_to_point(spark, d):
    b = W.pts(spark, d).select("id", B.as_wkb(g(), W.POINT).alias("b"))
    return b.select("id", B.from_wkb(F.col("b"), W.POINT).alias("g")).select("id", "g.x", "g.y")


@query(f"SELECT id, CASE WHEN NOT missing THEN x END AS x, CASE WHEN NOT missing THEN y END AS y FROM {W.SQL_PTS}")
def wkb_native_point(spark, d):
    """Points of binary, doubles and all, by built-in expressions."""
    h = F.hex(B.as_wkb(g(), W.POINT))  # as another writer's file would have them
    b = W.pts(spark, d).select("id", F.unhex(h).alias("b"))
    return b.select("id", B.from_wkb(F.col("b"), W.POINT, "regular").alias("g")).select("id", "g.x", "g.y")


PLANTED = "(SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'POINT (' || o_custkey || ' 2.5)' WHEN 2 THEN 'POINT (1' WHEN 3 THEN 'LINESTRING (0 1, 2 3)' WHEN 4 THEN 'POINT (a 2)' ELSE 'POINT EMPTY' END AS w, o_custkey FROM orders)"


@query(f"SELECT id, CASE WHEN id % 6 = 1 THEN o_custkey::DOUBLE WHEN id % 6 = 5 THEN -1 END AS x, id % 6 IN (2, 3, 4) AS rejected, CASE id % 6 WHEN 2 THEN 8 WHEN 4 THEN 7 ELSE -1 END::BIGINT AS byte FROM {PLANTED}")
def try_read(spark, d):
    """Text with planted errors, split into what can be read as points and what can't, with the byte."""
    k = F.col("o_orderkey") % 6
    w = F.when(k == 1, F.concat(F.lit("POINT ("), F.col("o_custkey").cast("string"), F.lit(" 2.5)"))).when(k == 2, "POINT (1").when(k == 3, "LINESTRING (0 1, 2 3)").when(k == 4, "POINT (a 2)").when(k == 5, "POINT EMPTY")
    df = W.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.tag(w, "w", W.WKT))
    clean, rejected = split_rejected(df, "w", W.POINT)
    clean = clean.select("id", F.nanvl(F.col("w.x"), F.lit(-1.0)).alias("x"), F.lit(False).alias("rejected"), F.lit(-1).cast("long").alias("byte"))
    return clean.union(rejected.select("id", F.lit(None).cast("double"), F.lit(True), F.coalesce("byte", F.lit(-1).cast("long"))))


@query(f"SELECT id, k AS vertex, x, y FROM {W.SQL_VERTEX}")
def wkb_to_linestring(spark, d):
    b = W.lns(spark, d).select("id", B.as_wkb(g(), W.LINE).alias("b"))
    return X.vertices(b.select("id", B.from_wkb(F.col("b"), W.LINE).alias("g")), "g", W.LINE).withColumn("vertex", F.col("vertex").cast("long"))


@query(f"SELECT id, CASE WHEN NOT missing THEN x END AS x, CASE WHEN NOT missing THEN y END AS y FROM {W.SQL_PTS}")
def wkb_big_endian(spark, d):
    b = W.pts(spark, d).select("id", B.as_wkb(g(), W.POINT, big_endian=True).alias("b"))
    return b.select("id", B.from_wkb(F.col("b"), W.POINT).alias("g")).select("id", "g.x", "g.y")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'TOO_FEW_BYTES' WHEN 2 THEN 'TOO_MANY_BYTES' ELSE 'INVALID_ENDIAN' END AS status FROM orders")
def wkb_status(spark, d):
    k = F.col("id")
    whole = F.unhex(F.lit("0101000000" + "00" * 16))
    b = F.when(k % 4 == 0, whole).when(k % 4 == 1, F.substring(whole, 1, 12)).when(k % 4 == 2, F.concat(whole, F.unhex(F.lit("00")))).otherwise(F.unhex(F.lit("0201000000" + "00" * 16)))
    rows = W.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return rows.select("id", b.alias("b")).select("id", B.status(F.col("b")).alias("status"))


# -- casts --------------------------------------------------------------------------------


@query(f"SELECT id, x, y FROM {W.SQL_VERTEX} WHERE n = 1")
def cast_multipoint_point(spark, d):
    df = W.mpt(spark, d).filter(F.size("g") == 1)
    return df.select("id", K.cast(g(), W.MPOINT, W.POINT).alias("g")).select("id", "g.x", "g.y")


@query(f"SELECT id, CASE WHEN NOT missing THEN ST_AsText(('MULTIPOINT (' || x || ' ' || y || ')')::GEOMETRY) END AS w FROM {W.SQL_PTS}")
def cast_point_multipoint(spark, d):
    return W.pts(spark, d).select("id", as_wkt(K.cast(g(), W.POINT, W.MPOINT), W.MPOINT).alias("w"))


@query(POL_VERTICES.format(src=W.SQL_POL))
def cast_ring_linestring(spark, d):
    t = polygon_type()
    lines = W.pol(spark, d).select("id", K.cast(from_wkt(F.col("w"), t, "regular"), t, W.LINE).alias("g"))
    return X.vertices(lines, "g", W.LINE).withColumn("vertex", F.col("vertex").cast("long"))


@query(f"SELECT id, ST_AsText(('MULTILINESTRING ((' || body || '))')::GEOMETRY) AS w FROM {W.SQL_LINES}")
def cast_linestring_multilinestring(spark, d):
    t = multilinestring_type()
    return W.lns(spark, d).select("id", as_wkt(K.cast(g(), W.LINE, t), t).alias("w"))


@query(f"SELECT id, ST_AsText(('MULTIPOLYGON (' || substring(w, 9) || ')')::GEOMETRY) AS w FROM {W.SQL_POL}")
def cast_polygon_multipolygon(spark, d):
    t, m = polygon_type(), multipolygon_type()
    return W.pol(spark, d).select("id", as_wkt(K.cast(from_wkt(F.col("w"), t, "regular"), t, m), m).alias("w"))


@query(f"SELECT id, ST_AsText(('POINT (' || x || ' ' || y || ')')::GEOMETRY) AS w FROM {W.SQL_PTS}")
def cast_xyz_to_xy(spark, d):
    return W.pts_z(spark, d).select("id", as_wkt(K.cast(g(), W.POINT_Z, W.POINT), W.POINT).alias("w"))


@query(f"SELECT id, x, y, z, TRUE AS m_missing FROM {W.SQL_PTS}")
def cast_xy_to_xyzm(spark, d):
    t = point_type(dimensions="XYZM")
    return W.pts_z(spark, d).select("id", K.cast(g(), W.POINT_Z, t).alias("g")).select("id", "g.x", "g.y", "g.z", F.isnan("g.m").alias("m_missing"))


@query(f"SELECT id, CASE WHEN NOT missing THEN x END AS x, CASE WHEN NOT missing THEN y END AS y FROM {W.SQL_PTS}")
def interleave(spark, d):
    t = point_type(coord_type="INTERLEAVED")
    return W.pts(spark, d).select("id", K.cast(g(), W.POINT, t).alias("g")).select("id", g()[0].alias("x"), g()[1].alias("y"))


@query(f"SELECT id, k AS vertex, x, y FROM {W.SQL_VERTEX}")
def separate(spark, d):
    t = linestring_type(coord_type="INTERLEAVED")
    packed = W.lns(spark, d).select("id", K.cast(g(), W.LINE, t).alias("g"))
    return X.vertices(packed.select("id", K.cast(g(), t, W.LINE).alias("g")), "g", W.LINE).withColumn("vertex", F.col("vertex").cast("long"))


# -- kernels ------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, NULL::VARCHAR AS g FROM orders")
def kernel_void(spark, d):
    return O.kernel("void", W.pts(spark, d), "g").select("id", g().cast("string").alias("g"))


@query("SELECT NULL::VARCHAR AS g")
def kernel_void_agg(spark, d):
    return O.kernel("void_agg", W.pts(spark, d), "g").select(g().cast("string").alias("g"))


@query("SELECT NULL::VARCHAR AS w")
def validate_agg(spark, d):
    return O.kernel("visit_void_agg", W.mix(spark, d), "w")


@query(f"SELECT id, CASE WHEN NOT missing THEN x END AS xmin, CASE WHEN NOT missing THEN y END AS ymin, CASE WHEN NOT missing THEN x END AS xmax, CASE WHEN NOT missing THEN y END AS ymax FROM {W.SQL_PTS}")
def box_point(spark, d):
    return O.kernel("box", W.pts(spark, d), "g").select("id", "g.*")


@query(f"SELECT id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM {W.SQL_VERTEX} GROUP BY id")
def box_linestring(spark, d):
    return O.kernel("box", W.lns(spark, d), "g").select("id", "g.*")


@query(f"SELECT id, p::DOUBLE AS xmin, s::DOUBLE AS ymin, (p + 10)::DOUBLE AS xmax, (s + 5)::DOUBLE AS ymax FROM {W.SQL_POL}")
def box_polygon(spark, d):
    t = polygon_type()
    return W.pol(spark, d).select("id", O.box(from_wkt(F.col("w"), t, "regular"), t).alias("b")).select("id", "b.*")


@query(f"SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM {W.SQL_PTS} WHERE NOT missing")
def box_agg(spark, d):
    return O.kernel("box_agg", W.pts(spark, d), "g").select("g.*")


@query("SELECT l_orderkey % 100 AS k, min(l_partkey / 4.0::DOUBLE) AS xmin, min(l_suppkey / 2.0::DOUBLE) AS ymin, max(l_partkey / 4.0::DOUBLE) AS xmax, max(l_suppkey / 2.0::DOUBLE) AS ymax FROM lineitem GROUP BY 1")
def box_agg_by(spark, d):
    return W.lns(spark, d).groupBy((F.col("id") % 100).alias("k")).agg(O.box_agg(g(), W.LINE).alias("b")).select("k", "b.*")


ODD_TEXTS = ["POINT (NaN NaN)", "MULTIPOINT EMPTY", "GEOMETRYCOLLECTION (LINESTRING EMPTY, POINT (1 2))", "POLYGON Z ((0 0 1, 1 0 1, 1 1 1, 0 0 1))", "GEOMETRYCOLLECTION M EMPTY", "POINT EMPTY", "LINESTRING ZM (inf 1 2 3, 4 nan 5 6)"]


@query("SELECT o_orderkey % 5 AS k, coalesce(c, 0)::INT AS code, count(*) AS n FROM (SELECT o_orderkey, [1, NULL, 7, 1003, NULL, NULL, 3002][(o_orderkey % 7 + 1)::INT] AS c FROM orders) GROUP BY ALL")
def unique_types_text(spark, d):
    """Codes of texts with NaN, infinite and no coordinates and of collections."""
    w = F.element_at(F.array(*[F.lit(x) for x in ODD_TEXTS]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    df = W.read(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("k"), F.coalesce(O.geometry_code(w, W.WKT), F.lit(0)).alias("code"))
    return df.groupBy("k", "code").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT CASE left(w, 5) WHEN 'POINT' THEN 1 WHEN 'LINES' THEN 2 ELSE 4 END::INT AS code FROM {W.SQL_MIX} WHERE w IS NOT NULL")
def unique_types(spark, d):
    return O.kernel("unique_geometry_types_agg", W.mix(spark, d), "w").withColumnRenamed("w", "code")


@query(f"SELECT DISTINCT CASE left(w, 5) WHEN 'POINT' THEN 1 ELSE 4 END::INT AS code FROM {W.SQL_MIX} WHERE w IS NOT NULL AND left(w, 5) <> 'LINES'")
def infer_codes(spark, d):
    df = to_table(W.mix(spark, d).filter("w not like 'LINE%'"), wkb_type())
    return O.kernel("unique_geometry_types_agg", df, "w").withColumnRenamed("w", "code")


@query("SELECT 100001::INT AS mixed, 4::INT AS promoted")
def infer_type(spark, d):
    df = W.mix(spark, d)
    return spark.createDataFrame([(infer_schema(df, "w").id, infer_schema(df.filter("w not like 'LINE%'"), "w").id)], "mixed int, promoted int")


# -- vector operations ----------------------------------------------------------------------


@query("SELECT o_orderkey AS id, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders) WHERE pos BETWEEN 101 AND 300")
def slice_rows(spark, d):
    return V.slice_rows(W.pts(spark, d), ["id"], 101, 200).select("id", F.col("pos").cast("long").alias("pos"))


@query("SELECT i.place::BIGINT AS at, o.id FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders) o JOIN (VALUES (1, 10), (2, 9), (3, 3), (4, 9), (5, 500)) i(place, pos) USING (pos)")
def gather_rows(spark, d):
    return V.gather_rows(W.pts(spark, d), ["id"], [10, 9, 3, 9, 500]).select("at", "id")


@query("SELECT i.at, o.id FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders) o JOIN (SELECT l_orderkey * 8 + l_linenumber AS at, l_partkey + 7 * l_suppkey AS pos FROM lineitem) i USING (pos)")
def gather_table(spark, d):
    """Orders at positions that every line item names, with repeats and positions that aren't there."""
    index = W.read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), (F.col("l_partkey") + 7 * F.col("l_suppkey")).cast("long").alias("pos"))
    return V.gather_table(W.pts(spark, d), ["id"], index).select("at", "id")


@query(f"SELECT id FROM {W.SQL_PTS} WHERE NOT missing AND x > 0")
def mask_rows(spark, d):
    return V.mask_rows(W.pts(spark, d), F.col("g.x") > 0).select("id")


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE missing) AS n_null FROM {W.SQL_PTS}")
def null_filter(spark, d):
    return W.pts(spark, d).agg(F.count("*").alias("n"), F.count(F.when(g().isNull(), 1)).alias("n_null"))


@query(f"SELECT id, swapped AS empty FROM {W.SQL_BOX}")
def is_empty(spark, d):
    return W.boxes(spark, d).select("id", C.is_empty(g(), W.BOX).alias("empty"))


@query(f"SELECT id, CASE WHEN NOT missing THEN x END AS x FROM {W.SQL_PTS} UNION ALL SELECT id, CASE WHEN NOT missing THEN x END AS x FROM {W.SQL_PTS}")
def concat_same(spark, d):
    df = W.pts(spark, d)
    return V.concat([df, df], "g").select("id", "g.x")


@query(f"SELECT id, CASE WHEN NOT missing THEN hex(ST_AsWKB(('POINT (' || x || ' ' || y || ')')::GEOMETRY)) END AS g FROM {W.SQL_PTS} UNION ALL SELECT id, hex(ST_AsWKB(('LINESTRING (' || body || ')')::GEOMETRY)) AS g FROM {W.SQL_LINES}")
def concat_mixed(spark, d):
    return V.concat([W.pts(spark, d), W.lns(spark, d)], "g").select("id", F.hex("g").alias("g"))


# -- traversal --------------------------------------------------------------------------------


@query(f"SELECT id, k AS vertex, x, y FROM {W.SQL_VERTEX}")
def vertices(spark, d):
    return X.vertices(W.lns(spark, d), "g").withColumn("vertex", F.col("vertex").cast("long"))


@query(f"SELECT id, 1::INT AS part, 1::INT AS ring, 4::INT AS n FROM {W.SQL_POL} UNION ALL SELECT id, 2::INT, 1::INT, 4::INT FROM {W.SQL_POL}")
def dump_points(spark, d):
    return X.parts(W.mpl(spark, d), "g")


@query(f"SELECT a.id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM {W.SQL_VERTEX} a JOIN {W.SQL_VERTEX} b ON a.id = b.id AND b.k = a.k + 1")
def edges(spark, d):
    return X.edges(W.lns(spark, d), "g")


@query(f"SELECT id, CASE WHEN swapped THEN 'POLYGON EMPTY' ELSE ST_AsText(('POLYGON ((' || p || ' ' || s || ', ' || (p + 10) || ' ' || s || ', ' || (p + 10) || ' ' || (s + 5) || ', ' || p || ' ' || (s + 5) || ', ' || p || ' ' || s || '))')::GEOMETRY) END AS w FROM {W.SQL_BOX}")
def box_to_polygon(spark, d):
    return W.boxes(spark, d).select("id", as_wkt(g(), W.BOX).alias("w"))


@query(f"SELECT id, CASE WHEN swapped THEN p + 10 ELSE p END AS xmin, CASE WHEN swapped THEN p ELSE p + 10 END AS xmax, 'Infinity'::DOUBLE AS zmin, '-Infinity'::DOUBLE AS zmax FROM {W.SQL_BOX}")
def box_bounds(spark, d):
    return W.boxes(spark, d).select("id", *X.box_bounds(g())).select("id", "xmin", "xmax", "zmin", "zmax")


@query(f"SELECT id, max(CASE WHEN k = 2 THEN x END) AS x2, max(CASE WHEN k = 2 THEN y END) AS y2, max(CASE WHEN k = n THEN x END) AS xn FROM {W.SQL_VERTEX} GROUP BY id")
def point_n(spark, d):
    return W.lns(spark, d).select("id", C.point_n(g(), W.LINE, 2).alias("a"), C.point_n(g(), W.LINE, -1).alias("b")).select("id", F.col("a.x").alias("x2"), F.col("a.y").alias("y2"), F.col("b.x").alias("xn"))


@query(f"SELECT id, n::INT AS n FROM {W.SQL_LINES}")
def num_points(spark, d):
    return W.lns(spark, d).select("id", C.num_coords(g(), W.LINE).alias("n"))


class _Count(X.Visitor):
    def __init__(self) -> None:
        self.features = self.coords = 0

    def feature_start(self, feat_id):
        self.features += 1

    def coord(self, c, coord_id):
        self.coords += 1

    def finish(self):
        return [(self.features, self.coords)]


@query(f"SELECT count(DISTINCT id) AS features, count(*) AS coords FROM {W.SQL_VERTEX}")
def handle_count(spark, d):
    rows = X.handle(W.lns(spark, d), "g", _Count, "features long, coords long")
    return rows.agg(F.sum("features").alias("features"), F.sum("coords").alias("coords"))


HULL_POINTS = f"(SELECT DISTINCT id % 1000 AS k, x, y FROM {W.SQL_PTS} WHERE NOT missing)"
SQL_HULL = f"""
WITH p AS (SELECT *, max(y) OVER c = y AS top, min(y) OVER c = y AS bottom, x IN (min(x) OVER g, max(x) OVER g) AS side FROM {HULL_POINTS} WINDOW c AS (PARTITION BY k, x), g AS (PARTITION BY k)),
under AS (SELECT DISTINCT p.k, p.x, p.y FROM p JOIN p a ON a.k = p.k AND a.x < p.x JOIN p b ON b.k = p.k AND b.x > p.x WHERE (b.x - a.x) * (p.y - a.y) <= (b.y - a.y) * (p.x - a.x)),
over AS (SELECT DISTINCT p.k, p.x, p.y FROM p JOIN p a ON a.k = p.k AND a.x < p.x JOIN p b ON b.k = p.k AND b.x > p.x WHERE (b.x - a.x) * (p.y - a.y) >= (b.y - a.y) * (p.x - a.x)),
corner AS (
  SELECT k, x, y FROM p WHERE (top OR bottom) AND side
  UNION SELECT k, x, y FROM p WHERE top AND NOT side AND (k, x, y) NOT IN (SELECT (k, x, y) FROM under)
  UNION SELECT k, x, y FROM p WHERE bottom AND NOT side AND (k, x, y) NOT IN (SELECT (k, x, y) FROM over))
SELECT k, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM corner GROUP BY k
"""


@query(SQL_HULL)
def visit_merge(spark, d):
    """Convex hulls of groups of points: a user aggregate whose state is merged in a tree."""
    pts = W.pts(spark, d).withColumn("k", F.col("id") % 1000).repartition(40)
    corners = A.visit_merge(pts, "g", A.ConvexHull, "corner int, x double, y double", by="k", fan_in=4)
    return corners.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(
    f"""
    SELECT id AS feat_id, e.event, e.level::INT AS level, CASE WHEN e.own THEN 0 ELSE -1 END::INT AS part_id, CASE e.event WHEN 'geom_start' THEN n ELSE -1 END::INT AS coord_id, CASE WHEN e.own THEN 2 ELSE -1 END::INT AS geometry_type, NULL::DOUBLE AS x, NULL::DOUBLE AS y
    FROM {W.SQL_LINES}, (VALUES ('feat_start', 0, false), ('geom_start', 0, true), ('geom_end', 0, true), ('feat_end', 0, false)) e(event, level, own)
    UNION ALL SELECT id, 'coord', 0::INT, 0::INT, (k - 1)::INT, 2::INT, x, y FROM {W.SQL_VERTEX}
    """
)
def geom_events(spark, d):
    whole = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("part_id", "coord_id", "geometry_type")]
    return X.geometry_events(W.lns(spark, d), "g", "id").select("feat_id", "event", "level", *whole, "x", "y")


@query(
    f"""
    SELECT id AS feat_id, e.event, e.level::INT AS level, CASE WHEN e.own THEN 0 ELSE -1 END::INT AS part_id, CASE e.event WHEN 'geom_start' THEN n ELSE -1 END::INT AS coord_id, CASE WHEN e.own THEN 2 ELSE -1 END::INT AS geometry_type, NULL::DOUBLE AS x, NULL::DOUBLE AS y
    FROM {W.SQL_LINES}, (VALUES ('feat_start', 0, false), ('geom_start', 0, true), ('geom_end', 0, true), ('feat_end', 0, false)) e(event, level, own)
    UNION ALL SELECT id, 'coord', 0::INT, 0::INT, (k - 1)::INT, 2::INT, x, y FROM {W.SQL_VERTEX}
    """
)
def geom_events_sql(spark, d):
    """The same rows from SQL text: a table function called with LATERAL."""
    register_native_events(spark, "geom_line_events", W.LINE)
    W.lns(spark, d).createOrReplaceTempView("geom_events_lines")
    return spark.sql("SELECT l.id AS feat_id, e.event, e.level, coalesce(e.part_id, -1) AS part_id, coalesce(e.coord_id, -1) AS coord_id, coalesce(e.geometry_type, -1) AS geometry_type, e.x, e.y FROM geom_events_lines l, LATERAL geom_line_events(l.g) e")


@query(f"SELECT id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'GEOMETRYCOLLECTION (POINT (' || o_custkey || ' 1), GEOMETRYCOLLECTION (LINESTRING (0 1, 2 3), POLYGON ((0 0, 1 0, 1 1, 0 0))))' WHEN 2 THEN 'POLYGON Z ((0 0 1, 4 0 1, 4 4 ' || o_custkey || ', 0 0 1), (1 1 1, 2 1 1, 2 2 1, 1 1 1))' ELSE 'MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 ' || o_custkey || ', 5 5)))' END AS w FROM (SELECT *, o_orderkey AS id FROM orders)")
def writer_mixed(spark, d):
    """Nested, mixed and null features, taken apart into events and written again."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    w = F.when(k == 1, F.concat(F.lit("GEOMETRYCOLLECTION (POINT ("), c, F.lit(" 1), GEOMETRYCOLLECTION (LINESTRING (0 1, 2 3), POLYGON ((0 0, 1 0, 1 1, 0 0))))")))
    w = w.when(k == 2, F.concat(F.lit("POLYGON Z ((0 0 1, 4 0 1, 4 4 "), c, F.lit(", 0 0 1), (1 1 1, 2 1 1, 2 2 1, 1 1 1))")))
    w = w.when(k == 3, F.concat(F.lit("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 "), c, F.lit(", 5 5)))")))
    orders = W.read(spark, d, "orders").select("o_orderkey", "o_custkey").repartition("o_orderkey")  # a file of few splits would be taken apart by few tasks
    df = orders.select(F.col("o_orderkey").alias("id"), C.tag(w, "w", W.WKT))
    built = X.assemble_wkb(X.geometry_events(df, "w", "id", numbered=True), "g")
    return built.select(F.col("feat_id").alias("id"), as_wkt(g(), wkb_type()).alias("w"))


@query(f"SELECT id, k AS vertex, x, y FROM {W.SQL_VERTEX}")
def geom_writer(spark, d):
    built = X.assemble(X.geometry_events(W.lns(spark, d), "g", "id"), W.LINE, "g").withColumnRenamed("feat_id", "id")
    return X.vertices(built, "g", W.LINE).withColumn("vertex", F.col("vertex").cast("long"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts::TIMESTAMP) AS window_start, min(user_id)::DOUBLE AS xmin, min(event_id % 90)::DOUBLE AS ymin, max(user_id)::DOUBLE AS xmax, max(event_id % 90)::DOUBLE AS ymax, count(*) AS n FROM events GROUP BY 1")
def windowed_box(spark, d):
    from ..streaming.boxes import windowed_box as run

    return run(W.stream_pts(spark, d), "g", "ts").drop("types")


SQL_SESSIONS = """
WITH e AS (SELECT user_id, event_id % 90 AS y, epoch_us(ts::TIMESTAMP) AS t FROM events WHERE ts IS NOT NULL),
m AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 86400000000 AS near FROM e),
s AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, make_timestamp(min(t)) AS session_start, make_timestamp(max(t)) AS session_end, user_id::DOUBLE AS xmin, min(y)::DOUBLE AS ymin, user_id::DOUBLE AS xmax, max(y)::DOUBLE AS ymax, count(*) AS n
FROM s GROUP BY user_id, k HAVING (max(t) + 86400000000 + 999) // 1000 <= (SELECT max(t) - 600000000 FROM e) // 1000
"""


@query(SQL_SESSIONS)
def session_box(spark, d):
    """Finished sessions of a stream of events, a day between them: state and timers in Spark's store."""
    from ..streaming.sessions import PROVIDER
    from ..streaming.sessions import session_box as run

    before, out = spark.conf.get(PROVIDER[0]), new_path(spark, "sessions")
    events = spark.readStream.schema(W.read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    spark.conf.set(*PROVIDER)
    try:
        found = run(W.stream_points(events), "g", "ts", "user_id", gap="1 day")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    return spark.read.schema(found.schema).parquet(out)
