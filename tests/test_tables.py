"""Sources, sinks, SQL names, streams."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terraframe import types as G
from terraframe.operators import cast as K
from terraframe.operators.infer import infer_schema
from terraframe.plans import views
from terraframe.sources import tables as S
from terraframe.sql import register
from terraframe.streaming.boxes import windowed_box

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 2.0, 3.0), (3, None, None)], "id int, x double, y double")
    g = F.when(F.col("x").isNotNull(), K.make_point(x=F.col("x"), y=F.col("y")))
    t = G.point_type(crs="EPSG:1234")
    return df.select("id", g.alias("g", metadata=t.metadata))


def test_parquet_round_trip_with_pruning_boxes(spark, points, tmp_path):
    S.write_parquet(points, f"{tmp_path}/a", with_boxes=True)
    df = S.read_parquet(spark, f"{tmp_path}/a")
    assert G.parse_field(df.schema["g"]) == G.point_type(crs="EPSG:1234") and set(S.geometry_columns(df)) == {"g", "g_box"}
    plan = df.filter("g_box.xmin > 1").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(g_box.xmin,1.0)" in plan


def test_footers_of_other_writers(spark, tmp_path):
    b = [bytes.fromhex("0101000000" + "00" * 16)]
    geo = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "crs": {"type": "GeographicCRS"}, "edges": "spherical"}}}
    pq.write_table(pa.table({"geometry": b}).replace_schema_metadata({"geo": json.dumps(geo)}), f"{tmp_path}/geo.parquet")
    t = G.parse_field(S.read_parquet(spark, f"file://{tmp_path}/geo.parquet").schema["geometry"])
    assert t.is_wkb and t.edge_type == 1 and t.crs_type == G.CrsType.PROJJSON
    field = pa.field("p", pa.struct([("x", pa.float64()), ("y", pa.float64()), ("m", pa.float64())]), metadata={G.NAME_KEY: "any.point", G.METADATA_KEY: "{}"})
    pq.write_table(pa.Table.from_arrays([pa.array([{"x": 1.0, "y": 2.0, "m": 3.0}], field.type)], schema=pa.schema([field])), f"{tmp_path}/ext.parquet")
    assert G.parse_field(S.read_parquet(spark, f"file://{tmp_path}/ext.parquet").schema["p"]).id == 2001


def test_arrow_and_ipc(spark, points):
    table = S.to_arrow(points)
    assert table.schema.field("g").metadata[G.NAME_KEY.encode()] == b"terraframe.point"
    back = S.from_arrow(spark, pa.concat_tables([table, table.slice(1, 1)]))
    assert back.count() == 4 and G.parse_field(back.schema["g"]) == G.point_type(crs="EPSG:1234")
    assert S.read_ipc(spark, S.to_ipc(points)).count() == 3
    odd = pa.table({"u": pa.array([1], pa.uint64()), "d": pa.array(["a"]).dictionary_encode(), "h": pa.array([1.5], pa.float16()), "b": pa.array([b"x"], pa.large_binary())})
    assert [t for _, t in S.from_arrow(spark, odd).dtypes] == ["decimal(20,0)", "string", "float", "binary"]
    fsl = pa.field("g", pa.list_(pa.field("xyz", pa.float64()), 3), metadata={G.NAME_KEY: "any.point"})
    got = S.from_arrow(spark, pa.Table.from_arrays([pa.array([[1.0, 2.0, 3.0]], fsl.type)], schema=pa.schema([fsl])))
    assert G.parse_field(got.schema["g"]).id == 11001


def test_features_and_forced_types(spark, points):
    out = S.to_features(points)
    assert out.attrs == {"crs": {"g": "EPSG:1234"}, "geometry": "g"} and len(out.g[0]) == 21
    assert G.parse_field(S.to_table(points, {"g": G.wkt_type()}).schema["g"]).is_wkt
    with pytest.raises(ValueError, match="no geometry"):
        S.to_features(spark.range(1))
    assert G.parse_field(S.empty(spark, G.box_type(), "b").schema["b"]).id == 990


def test_sql_names(spark):
    register(spark)
    row = spark.sql("SELECT geom_wkt_from_wkb(geom_wkb_from_wkt('POINT (1 2)')) a, geom_wkt_code('POINT Z (1 2 3)') b, geom_boxes_meet(geom_box(0, 0, 2, 2), geom_box(1, 1, 3, 3)) c, geom_point(1, null).x d, geom_type_id(2, 3, 2) e, geom_wkb_status(X'01') f").first()
    assert tuple(row) == ("POINT (1 2)", 1001, True, 1.0, 12002, "TOO_FEW_BYTES")


def test_stream_equals_batch(spark, tmp_path):
    batch = views.stream_pts(spark, SF)
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    t = G.parse_field(batch.schema["g"])
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in").withMetadata("g", t.metadata)
    with pytest.raises(ValueError, match="full pass"):
        infer_schema(stream, "g")
    q = windowed_box(stream, "g", "ts", late="100 days").writeStream.outputMode("complete").format("memory").queryName("boxes").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda r: (r.window_start, r.xmin, r.ymin, r.xmax, r.ymax, r.n)
    assert sorted(map(key, spark.sql("SELECT * FROM boxes").collect())) == sorted(map(key, windowed_box(batch, "g", "ts").collect()))


def test_buffers(spark):
    import numpy as np

    from terraframe.functions.wkt import as_wkt
    from terraframe.sources import buffers as U

    t = G.multipolygon_type()
    x, y = np.arange(10), np.arange(10) * -1.5
    df = U.from_buffers(spark, t, [x, y.tolist()], [[0, 1, 1, 3], [0, 2, 3, 4], [0, 3, 5, 8, 10]], validity=[True, True, False])
    assert [r.w for r in df.orderBy("row").select(as_wkt(F.col("geometry"), t).alias("w")).collect()] == ["MULTIPOLYGON (((0 0, 1 -1.5, 2 -3), (3 -4.5, 4 -6)))", "MULTIPOLYGON EMPTY", None]
    assert G.parse_field(df.schema["geometry"]) == t
    inter = G.linestring_type(dimensions="XYZ", coord_type="INTERLEAVED")
    assert U.array_from_buffers(inter, range(9), [[1, 3]]).to_pylist() == [[[3.0, 4.0, 5.0], [6.0, 7.0, 8.0]]]
    assert U.array_from_buffers(G.point_type(), [[1, 2], [3, 4]], validity=b"\x02").to_pylist() == [None, {"x": 2.0, "y": 4.0}]
    assert len(U.array_from_buffers(G.linestring_type(), [[], []], [[]])) == 0
    assert U.binary_buffer(["ab", b"c", ""])[0] == b"abc" and U.binary_buffer(["ab", b"c", ""])[1].tolist() == [0, 2, 3, 3]
    assert U.offsets_buffer([0.0, 2.0]).dtype == np.int32 and U.offsets_buffer([2**40], large=True).tolist() == [2**40]
    line = G.linestring_type()
    for what, bad in {
        "numbers": lambda: U.coords_buffer(["a"]),
        "whole numbers": lambda: U.offsets_buffer([0, 1.5]),
        "32 bits": lambda: U.offsets_buffer([2**40]),
        "missing": lambda: U.validity_buffer([True, None], 2),
        "bitmap": lambda: U.validity_buffer(b"", 2),
        "offset buffers": lambda: U.array_from_buffers(line, [[0], [0]]),
        "coordinate buffers": lambda: U.array_from_buffers(line, [[0]], [[0, 1]]),
        "differ in length": lambda: U.array_from_buffers(line, [[0], [0, 1]], [[0, 1]]),
        "beyond": lambda: U.array_from_buffers(line, [[0], [0]], [[0, 2]]),
        "less than the one before": lambda: U.array_from_buffers(line, [[0, 1], [0, 1]], [[0, 2, 1, 2]], level="full"),
        "one of": lambda: U.array_from_buffers(line, [[0], [0]], [[0, 1]], level="all"),
    }.items():
        with pytest.raises(ValueError, match=what):
            bad()


def test_registered_arrow_types(spark, points, tmp_path):
    from terraframe.sources import arrow_types as A

    names = A.register_types()
    try:
        assert len(names) == 9 == len(A.register_types())
        table = S.to_arrow(points, registered=True)
        kind = table.schema.field("g").type
        assert kind.extension_name == "terraframe.point" and "EPSG:1234" in kind.metadata
        pq.write_table(pa.concat_tables([table, table]), f"{tmp_path}/x.parquet")
        back = pq.read_table(f"{tmp_path}/x.parquet")
        assert back.schema.field("g").type == kind and isinstance(back.schema.field("g").type, A.GeometryArrowType)
        df = S.from_arrow(spark, back)
        assert df.count() == 6 and G.parse_field(df.schema["g"]) == G.point_type(crs="EPSG:1234")
        assert G.parse_field(S.read_parquet(spark, f"file://{tmp_path}/x.parquet").schema["g"]) == G.point_type(crs="EPSG:1234")
        for t in (G.wkt_type(crs="x"), G.wkb_type(), G.box_type(dimensions="XYZ"), G.multipolygon_type(coord_type="INTERLEAVED")):
            assert S.arrow_field_type(pa.field("g", A.extension_type(t))).id == t.id or t.geometry_type == 990
        inter = G.multilinestring_type(dimensions="XYM", coord_type="INTERLEAVED")
        made = spark.createDataFrame([(1, [[[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], []]), (2, None)], G.T.StructType([G.T.StructField("i", G.T.IntegerType()), inter.field("g")]))
        back = S.from_arrow(spark, S.to_arrow(made, registered=True))
        assert G.parse_field(back.schema["g"]) == inter and [r.g for r in back.orderBy("i").collect()] == [[[[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], []], None]
    finally:
        A.unregister_types()


def test_clean_up_deletes_what_queries_wrote(spark):
    import os

    from terraframe.sources import scratch

    path = scratch.new_path(spark, "t").removeprefix("file://")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path) and path.startswith(scratch.own_folder(spark).removeprefix("file://"))
    scratch.clean_up(spark)
    assert not os.path.exists(path) and os.path.exists(scratch.shared_dir(spark).removeprefix("file://"))
    scratch.clean_up(spark)
