"""Casts, kernels, inference, vector operations and traversal on small goldens."""

import math

import pytest
from pyspark.sql import functions as F

from terraframe import types as G
from terraframe.functions import coords as C
from terraframe.functions.numbers import round_ordinate
from terraframe.functions.wkt import as_wkt, from_wkt
from terraframe.operators import cast as K
from terraframe.operators import kernels as O
from terraframe.operators import vector as V
from terraframe.operators import visit as X
from terraframe.operators.infer import infer_schema, type_from_codes


@pytest.fixture(scope="module")
def texts(spark):
    def build(*ws, crs=None, edges="PLANAR"):
        df = spark.createDataFrame([(i, w) for i, w in enumerate(ws)], "id int, g string")
        return df.withMetadata("g", G.wkt_type(crs=crs, edges=edges).metadata)

    return build


def wkt_cast(spark, text, src, dst, **options):
    a, b = G.native_type(src, **options), G.native_type(dst, **options)
    df = spark.createDataFrame([(text,)], "w string")
    return df.select(as_wkt(K.cast(from_wkt(F.col("w"), a), a, b), b).alias("w")).first().w


@pytest.mark.parametrize(
    "text, src, dst, want",
    [
        ("MULTIPOINT (1 2)", "MULTIPOINT", "POINT", "POINT (1 2)"),
        ("LINESTRING EMPTY", "LINESTRING", "POINT", "POINT (nan nan)"),
        ("POINT (1 2)", "POINT", "MULTIPOINT", "MULTIPOINT (1 2)"),
        ("POINT (1 2)", "POINT", "MULTIPOLYGON", "MULTIPOLYGON (((1 2)))"),
        ("MULTIPOINT (1 2, 3 4)", "MULTIPOINT", "LINESTRING", "LINESTRING (1 2, 3 4)"),
        ("MULTIPOINT (1 2, 3 4)", "MULTIPOINT", "POLYGON", "POLYGON ((1 2, 3 4))"),
        ("POLYGON ((1 2, 3 4))", "POLYGON", "LINESTRING", "LINESTRING (1 2, 3 4)"),
        ("POLYGON ((1 2), (3 4))", "POLYGON", "MULTILINESTRING", "MULTILINESTRING ((1 2), (3 4))"),
        ("MULTILINESTRING ((1 2), (3 4))", "MULTILINESTRING", "MULTIPOLYGON", "MULTIPOLYGON (((1 2), (3 4)))"),
        ("MULTIPOLYGON (((1 2)), ((3 4)))", "MULTIPOLYGON", "POLYGON", "POLYGON ((1 2), (3 4))"),
        ("LINESTRING EMPTY", "LINESTRING", "MULTILINESTRING", "MULTILINESTRING EMPTY"),
        ("LINESTRING EMPTY", "LINESTRING", "MULTIPOLYGON", "MULTIPOLYGON EMPTY"),
    ],
)
def test_casts(spark, text, src, dst, want):
    assert wkt_cast(spark, text, src, dst) == want


@pytest.mark.parametrize("text, src, dst, what", [("LINESTRING (1 2, 3 4)", "LINESTRING", "POINT", "coordinate to POINT"), ("POLYGON ((1 2), (3 4))", "POLYGON", "LINESTRING", "sequence to LINESTRING")])
def test_cast_errors(spark, text, src, dst, what):
    with pytest.raises(Exception, match="Can't convert feature with >1 " + what):
        wkt_cast(spark, text, src, dst)


def test_mixed_dimensions_fill_and_drop(texts):
    df = texts("POINT Z (0 1 2)", "POINT M (2 3 4)")
    t = G.point_type(dimensions="XYZM")
    rows = df.select("id", K.cast(F.col("g"), G.wkt_type(), t).alias("p")).orderBy("id").collect()
    assert rows[0].p[:3] == (0, 1, 2) and math.isnan(rows[0].p.m)
    assert (rows[1].p.x, rows[1].p.m) == (2, 4) and math.isnan(rows[1].p.z)
    back = df.select("id", as_wkt(K.cast(K.cast(F.col("g"), G.wkt_type(), t), t, G.point_type()), G.point_type()).alias("w")).orderBy("id").collect()
    assert [r.w for r in back] == ["POINT (0 1)", "POINT (2 3)"]


def test_cast_keeps_input_metadata_and_skips_no_ops(texts):
    df = texts("POINT (0 1)", crs="EPSG:1234", edges="SPHERICAL")
    t = G.parse_field(df.schema["g"])
    out = df.withColumn("g", K.as_geometry(F.col("g"), t, G.point_type(), "g"))
    assert G.parse_field(out.schema["g"]) == G.point_type(crs="EPSG:1234", edges="SPHERICAL")
    col = F.col("g")
    assert K.cast(col, G.point_type(), G.point_type(crs="x")) is col


def test_precision_and_construction(spark):
    df = spark.createDataFrame([(4 / 3, 7 / 3)], "x double, y double")
    g = K.round_precision(K.make_point(x=F.col("x"), y=F.col("y")), G.point_type(), 100)
    assert tuple(df.select(g.alias("g")).first().g) == (1.33, 2.33)
    assert df.select(round_ordinate(F.col("x"), -1).alias("v")).first().v == 1.3333333730697632
    assert math.isnan(df.select(K.make_point(x=F.lit(None), y=F.col("y")).alias("g")).first().g.x)
    nested = df.select(K.from_offsets(F.array(*[F.lit(float(i)) for i in range(5)]), F.array(F.lit(0), F.lit(2), F.lit(5)), F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")).first().n
    assert nested == [[[0.0, 1.0]], [[2.0, 3.0, 4.0]]]
    assert df.select(K.from_offsets(F.array(F.lit(1.0)), F.array(F.lit(0))).alias("n")).first().n == []


def test_validity(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "x int, v boolean")
    assert [r[0] for r in df.orderBy("x").select(K.with_validity(F.col("x"), F.col("v"))).collect()] == [1, None]
    with pytest.raises(Exception, match="validity must not contain missing"):
        df.select(K.with_validity(F.col("x"), F.lit(None).cast("boolean"))).collect()


def test_positions_of_many_rows(spark):
    """More rows than the sample, several keys, nulls and ties in the leading one."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("b"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("k"), (F.col("id") % 37).cast("string"))).alias("a")).repartition(7)
    got = V.positions(df, ["a", "b"]).collect()
    want = sorted(((r.a is not None, r.a or "", r.b) for r in got))
    assert [(r.a is not None, r.a or "", r.b) for r in sorted(got, key=lambda r: r.pos)] == want
    assert sorted(r.pos for r in got) == list(range(1, 5001))
    assert V.positions(df.limit(0), ["a"]).count() == 0


def test_boxes(spark, texts):
    df = texts("POLYGON ((0 1, 2 3, 4 -5))", "POINT EMPTY", None, "GEOMETRYCOLLECTION (POINT (9 9), LINESTRING (0 0, 1 nan))", "LINESTRING EMPTY")
    rows = O.kernel("box", df, "g").orderBy("id").collect()
    assert tuple(rows[0].g) == (0, -5, 4, 3) and rows[2].g is None and tuple(rows[3].g) == (0, 0, 9, 9)
    assert tuple(rows[1].g) == (math.inf, math.inf, -math.inf, -math.inf) == tuple(rows[4].g)
    assert tuple(O.kernel("box_agg", df, "g").first().g) == (0, -5, 9, 9)
    assert tuple(O.kernel("box_agg", df.filter("id < 0"), "g").first().g) == (math.inf, math.inf, -math.inf, -math.inf)
    native = df.filter("id in (1, 2)").select(K.as_geometry(F.col("g"), G.wkt_type(), G.point_type(), "g"))
    assert math.isinf(O.kernel("box_agg", native, "g").first().g.xmin)
    with pytest.raises(ValueError, match="planar"):
        O.kernel("box", texts("POINT (0 1)", edges="SPHERICAL"), "g")


def test_box_as_polygon(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0), (2.0, 1.0, 0.0, 3.0)], "a double, b double, c double, d double")
    g = K.make_box(*[F.col(c) for c in "abcd"])
    rows = df.select(as_wkt(g, G.box_type()).alias("w"), C.is_empty(g, G.box_type()).alias("e")).collect()
    assert [tuple(r) for r in rows] == [("POLYGON ((0 1, 2 1, 2 3, 0 3, 0 1))", False), ("POLYGON EMPTY", True)]


def test_boxes_of_more_dimensions(spark):
    t = G.box_type(dimensions="XYZ")
    df = spark.createDataFrame([((0.0, 1.0, 9.0, 2.0, 3.0, 12.0),)], G.T.StructType([t.field("b")]))
    assert tuple(df.select(K.cast(F.col("b"), t, G.box_type()).alias("b")).first().b) == (0, 1, 2, 3)
    with pytest.raises(ValueError, match="computed in XY"):
        K.cast(F.col("b"), G.box_type(), t)


def test_type_codes(texts):
    df = texts("POINT (0 1)", "POINT Z (0 1 2)", "LINESTRING EMPTY", None, "MULTIPOINT M (1 2 3)", "GEOMETRYCOLLECTION (POINT (1 2))")
    codes = lambda d: sorted(r.g for r in O.kernel("unique_geometry_types_agg", d, "g").collect())
    assert codes(df) == [1, 7, 1001, 2004] == codes(O.kernel("as_wkb", df, "g"))
    nan = texts("POINT EMPTY").withColumn("g", K.as_geometry(F.col("g"), G.wkt_type(), G.point_type(), "g"))
    assert codes(nan) == [1]


#: A text of each type, in XY.
SAMPLES = {"POINT": "(5 -3)", "LINESTRING": "(9 9, 8 7, 6 5)", "POLYGON": "((0 0, 4 0, 4 4, 0 0))", "MULTIPOINT": "(1 1, 7 2)", "MULTILINESTRING": "((0 9, 9 0), (3 3, 5 5))", "MULTIPOLYGON": "(((1 0, 2 0, 2 2, 1 0)))", "GEOMETRYCOLLECTION": "(LINESTRING (1 1, 2 2))"}


def test_inference_of_every_pair_of_types(texts):
    """One type is itself, a type with its multi form is that, and any other pair, and collections, are binary."""
    for a in SAMPLES:
        for b in SAMPLES:
            t = infer_schema(texts(f"{a} {SAMPLES[a]}", None, f"{b} {SAMPLES[b]}", crs="EPSG:31370"), "g")
            kinds = {a, b}
            multi = "MULTI" + min(kinds, key=len)
            want = None if "GEOMETRYCOLLECTION" in kinds else a if a == b else multi if kinds == {min(kinds, key=len), multi} else None
            assert t == (G.native_type(want, crs="EPSG:31370") if want else G.wkb_type(crs="EPSG:31370")), (a, b)


def test_inference_adds_dimensions_up(texts):
    marks = {"": "7 7", " Z": "7 7 1", " M": "7 7 2", " ZM": "7 7 1 2"}
    for a in marks:
        for b in marks:
            t = infer_schema(texts(f"POINT{a} ({marks[a]})", f"POINT{b} ({marks[b]})"), "g")
            assert t.ordinates == "xy" + "".join(o for o in "zm" if o in (a + b).lower())
    assert infer_schema(texts(None, "LINESTRING EMPTY"), "g").is_wkb


def test_inference_options(texts):
    df = texts("LINESTRING (4 4, 5 6)", "MULTILINESTRING ((1 8, 2 8))")
    assert infer_schema(df, "g", promote_multi=False).is_wkb
    assert infer_schema(df, "g", coord_type="INTERLEAVED") == G.multilinestring_type(coord_type="INTERLEAVED")
    native = df.filter("id = 0").withColumn("g", K.as_geometry(F.col("g"), G.wkt_type(), G.linestring_type(), "g"))
    assert infer_schema(native, "g") == G.linestring_type() and type_from_codes([]).is_wkb


def test_format_and_validity(spark, texts):
    df = texts("LINESTRING (12.3456789 -0.5, 100 200)", None)
    full = "LINESTRING (12.3456789 -0.5, 100 200)"
    for width in (20, 25, 34, 60):
        for digits in (2, 9):
            text = full.replace("12.3456789", "12.35" if digits == 2 else "12.3456789")
            rows = df.select("id", V.format_vector(F.col("g"), G.wkt_type(), width, digits).alias("s")).orderBy("id").collect()
            assert [r.s for r in rows] == [f"<{text[: width - 10]}>", "<NA>"]
    assert df.select("id", V.format_vector(F.col("g"), G.wkt_type()).alias("s")).orderBy("id").first().s == f"<{full}>"
    bad = texts("POINT (0 1)", "POINT", None)
    assert [r.ok for r in bad.select("id", O.is_valid(F.col("g"), G.wkt_type()).alias("ok")).orderBy("id").collect()] == [True, False, None]
    with pytest.raises(Exception, match="can't be read"):
        O.kernel("visit_void_agg", bad, "g").collect()
    assert O.kernel("visit_void_agg", df, "g").first().g is None
    with pytest.raises(ValueError, match="Missing required parameter 'type'"):
        O.kernel("as_geometry", df, "g")
    with pytest.raises(ValueError, match="No kernel"):
        O.kernel("other", df, "g")


def test_slices_read_their_ranges_only(spark, tmp_path):
    """The rows at the wanted positions come from the ranges that hold them; the bounds reach the scan."""
    spark.range(0, 20_000, 1, 8).selectExpr("id * 3 as k", "cast(id as string) as s").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = V.slice_rows(df, ["k"], 9_001, 50)
    assert sorted((r.k, r.pos) for r in out.collect()) == [(3 * (i - 1), i) for i in range(9_001, 9_051)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k" in plan and "LessThan(k" in plan
    got = V.gather_rows(df, ["k"], [19_999, 1, 7, 1, 30_000]).orderBy("at").collect()
    assert [(r["at"], r.k) for r in got] == [(1, 3 * 19_998), (2, 0), (3, 18), (4, 0)]


def test_events_of_native_columns_are_those_of_text(texts):
    for w in ("POINT (1 2)", "LINESTRING (0 1, 2 3)", "POLYGON ((0 0, 1 0, 1 1), (5 5))", "MULTIPOINT (1 2, 3 4)", "MULTILINESTRING ((0 1, 2 3), (4 5))", "MULTIPOLYGON (((0 0, 1 0), (2 2)), ((7 7)))"):
        for mark, extra in (("", ""), (" ZM", " 8 9")):
            kind = w.split()[0]
            body = w[len(kind) :]
            text = kind + mark + __import__("re").sub(r"(\d+ \d+)", lambda m: m[1] + extra, body)
            df = texts(text, None, f"{kind}{mark} EMPTY")
            t = G.native_type(kind, "XYZM" if mark else "XY")
            native = df.withColumn("g", K.as_geometry(F.col("g"), G.wkt_type(), t, "g"))
            a, b = (sorted(map(str, X.geometry_events(d, "g", "id").collect())) for d in (df, native))
            assert a == b, text


def test_vectors(spark, texts):
    df = texts(*[f"POINT ({i} 0)" for i in range(10)]).withColumn("g", K.as_geometry(F.col("g"), G.wkt_type(), G.point_type(), "g"))
    assert sorted(r.id for r in V.slice_rows(df, ["id"], 3, 4).collect()) == [2, 3, 4, 5]
    assert [r.id for r in V.gather_rows(df, ["id"], list(range(10, 0, -1))).orderBy("at").collect()] == list(range(9, -1, -1))
    assert V.mask_rows(df, F.col("g.x") > 7).count() == 2
    both = V.concat([df, df], "g")
    assert both.count() == 20 and G.parse_field(both.schema["g"]).id == 1
    mixed = V.concat([df, O.kernel("as_wkt", df, "g")], "g")
    assert G.parse_field(mixed.schema["g"]).is_wkb and mixed.select("g").distinct().count() == 10
    with pytest.raises(ValueError, match="are not equal"):
        V.concat([df, V.set_crs(df, "g", "EPSG:1")], "g")
    with pytest.raises(ValueError, match="different edges"):
        V.concat([df, V.set_geodesic(df, "g", True)], "g")
    d = V.set_geodesic(V.set_crs(df, "g", "EPSG:1234"), "g", True)
    assert V.get_crs(d, "g") == "EPSG:1234" and V.is_geodesic(d, "g") and V.get_crs(df, "g") is None
    assert not V.is_geodesic(V.set_geodesic(d, "g", False), "g") and V.get_crs(V.set_geodesic(d, "g", False), "g") == "EPSG:1234"
    line = V.reinterpret(df.select(F.array("g").alias("g")), "g", G.linestring_type())
    assert G.parse_field(line.schema["g"]).id == 2
    with pytest.raises(ValueError, match="storage"):
        V.reinterpret(df, "g", G.wkb_type())


def test_traversal(spark, texts):
    df = texts("POLYGON ((0 0, 1 0, 1 1), (5 5))", None, "POLYGON EMPTY").withColumn("g", K.as_geometry(F.col("g"), G.wkt_type(), G.polygon_type(), "g"))
    assert [tuple(r) for r in X.vertices(df, "g").orderBy("vertex").collect()] == [(0, 1, 0, 0), (0, 2, 1, 0), (0, 3, 1, 1), (0, 4, 5, 5)]
    assert sorted(tuple(r) for r in X.edges(df, "g").collect()) == [(0, 0, 0, 1, 0), (0, 1, 0, 1, 1)]
    pts = texts("MULTIPOINT (1 2, 3 4)").withColumn("g", K.as_geometry(F.col("g"), G.wkt_type(), G.multipoint_type(), "g"))
    assert sorted(tuple(r) for r in X.edges(pts, "g").collect()) == [(0, 1, 2, 1, 2), (0, 3, 4, 3, 4)]
    assert [(r.part, r.ring, r.n) for r in X.parts(df, "g").orderBy("ring").collect()] == [(1, 1, 3), (1, 2, 1)]


def test_events_and_writer(texts):
    df = texts("GEOMETRYCOLLECTION (POINT (0 1), POLYGON ((1 2, 3 4)))", None, "POINT EMPTY")
    rows = [(r.feat_id, r.event, r.level, r.x) for r in X.geometry_events(df, "g", "id").collect()]
    first = [(e, lv) for f, e, lv, _ in rows if f == 0]
    assert first == [("feat_start", 0), ("geom_start", 0), ("geom_start", 1), ("coord", 1), ("geom_end", 1), ("geom_start", 1), ("ring_start", 1), ("coord", 1), ("coord", 1), ("ring_end", 1), ("geom_end", 1), ("geom_end", 0), ("feat_end", 0)]
    assert [e for f, e, _, _ in rows if f == 1] == ["feat_start", "null_feat", "feat_end"]
    assert [e for f, e, _, _ in rows if f == 2] == ["feat_start", "geom_start", "geom_end", "feat_end"]
    mp = "MULTIPOLYGON (((0 0, 1 0), (2 2, 3 3)), ((7 7, 8 8)))"
    t = G.multipolygon_type()
    ev = texts(mp)
    v = ev.select("id", F.posexplode(from_wkt(F.col("g"), t)).alias("part_id", "p")).select("id", "part_id", F.posexplode("p").alias("ring_id", "r")).select(F.col("id").alias("feat_id"), "part_id", "ring_id", F.posexplode("r").alias("coord_id", "c")).select("feat_id", "part_id", "ring_id", "coord_id", "c.*")
    out = X.assemble(v, t, "g")
    assert out.select(as_wkt(F.col("g"), t).alias("w")).first().w == mp and G.parse_field(out.schema["g"]) == t


class Longest(X.Visitor):
    def __init__(self):
        self.best = 0

    def geometry_start(self, kind, dims, size, part_id, level):
        self.best = max(self.best, size)
        return size < 100

    def finish(self):
        return [(self.best,)]


def test_user_visitor(texts):
    df = texts("LINESTRING (0 1, 2 3, 4 5)", "POINT (0 1)", None)
    assert X.handle(df, "g", Longest, "best long").agg(F.max("best")).first()[0] == 3
