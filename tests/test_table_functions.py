import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from terraframe.functions.coords import tag
from terraframe.functions.geometry import parse_wkt, write_wkb
from terraframe.operators.visit import edges, geometry_events, vertices
from terraframe.table_functions import register_native_events, register_tables
from terraframe.types import native_type, wkt_type

TEXTS = [None, "POINT (1 2)", "POINT EMPTY", "LINESTRING Z (1 2 3, 4 5 6)", "POLYGON ((0 0, 1 0, 1 1, 0 0), (5 5, 6 6))", "MULTIPOINT (1 2, 3 4)", "MULTIPOLYGON M (((0 0 7, 1 1 8)), ((2 2 9)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (3 4, 5 6), GEOMETRYCOLLECTION (POINT (7 8)))"]


@pytest.fixture(scope="module")
def texts(spark):
    assert register_tables(spark) == ["geom_vertices", "geom_edges", "geom_events"]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, w string").select("id", tag(F.col("w"), "w", wkt_type()))
    df.createOrReplaceTempView("tf_texts")
    spark.createDataFrame([(i, None if t is None else bytearray(write_wkb(parse_wkt(t)))) for i, t in enumerate(TEXTS) if t != "POINT EMPTY"], "id long, b binary").createOrReplaceTempView("tf_binary")
    return df


def rows(df):
    return sorted(map(str, df.collect()))


def test_events_of_text_and_binary(spark, texts):
    got = spark.sql("SELECT t.id AS feat_id, e.* FROM tf_texts t, LATERAL geom_events(t.w) e")
    assert rows(got) == rows(geometry_events(texts, "w", "id"))
    binary = spark.sql("SELECT t.id AS feat_id, e.* FROM tf_binary t, LATERAL geom_events(t.b) e")
    assert rows(binary) == rows(geometry_events(texts.filter("id <> 2"), "w", "id"))


def test_vertices_and_edges_of_text(spark, texts):
    got = spark.sql("SELECT t.id, v.* FROM tf_texts t, LATERAL geom_vertices(t.w) v WHERE t.id IN (3, 6, 7) ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(3, 1, 1.0, 2.0, 3.0, None), (3, 2, 4.0, 5.0, 6.0, None), (6, 1, 0.0, 0.0, None, 7.0), (6, 2, 1.0, 1.0, None, 8.0), (6, 3, 2.0, 2.0, None, 9.0), *[(7, k + 1, 2.0 * k + 1, 2.0 * k + 2, None, None) for k in range(4)]]
    got = spark.sql("SELECT t.id, e.x0, e.y0, e.x1, e.y1 FROM tf_texts t, LATERAL geom_edges(t.w) e").collect()
    assert sorted(map(tuple, got)) == sorted([(1, 1.0, 2.0, 1.0, 2.0), (3, 1.0, 2.0, 4.0, 5.0), (4, 0.0, 0.0, 1.0, 0.0), (4, 1.0, 0.0, 1.0, 1.0), (4, 1.0, 1.0, 0.0, 0.0), (4, 5.0, 5.0, 6.0, 6.0), (5, 1.0, 2.0, 1.0, 2.0), (5, 3.0, 4.0, 3.0, 4.0), (6, 0.0, 0.0, 1.0, 1.0), (7, 1.0, 2.0, 1.0, 2.0), (7, 3.0, 4.0, 5.0, 6.0), (7, 7.0, 8.0, 7.0, 8.0)])


@pytest.mark.parametrize("kind", range(1, 7))
def test_native_columns_as_the_frame_functions(spark, texts, kind):
    from terraframe.functions.wkt import from_wkt

    name = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}[kind]
    body = {1: "(1 2 3)", 2: "(1 2 3, 4 5 6)", 3: "((1 2 3, 4 5 6), (7 8 9))", 4: "(1 2 3, 4 5 6)", 5: "((1 2 3, 4 5 6), (7 8 9))", 6: "(((1 2 3, 4 5 6)), ((7 8 9), (1 1 1, 2 2 2)))"}[kind]
    t = native_type(name, 2, 1)
    df = spark.createDataFrame([(1, f"{name} Z {body}"), (2, None)], "id long, w string").select("id", tag(from_wkt(F.col("w"), t), "g", t))
    df.createOrReplaceTempView("tf_native")
    assert rows(spark.sql(f"SELECT t.id, v.* FROM tf_native t, LATERAL geom_vertices(t.g, '{name.lower()}') v")) == rows(vertices(df, "g", t))
    assert rows(spark.sql(f"SELECT t.id, e.* FROM tf_native t, LATERAL geom_edges(t.g, '{name.lower()}') e")) == rows(edges(df, "g", t))
    assert rows(spark.sql(f"SELECT t.id AS feat_id, e.* FROM tf_native t, LATERAL geom_events(t.g, '{name.lower()}') e")) == rows(geometry_events(df, "g", "id"))


def test_what_analysis_refuses(spark, texts):
    for sql in ("SELECT * FROM geom_vertices(1)", "SELECT * FROM geom_vertices(array(named_struct('x', 1D, 'y', 2D)))", "SELECT * FROM geom_events(array(named_struct('x', 1D, 'y', 2D)), 'polygon')", "SELECT * FROM geom_edges(named_struct('a', 1D))"):
        with pytest.raises(AnalysisException):
            spark.sql(sql).collect()
    assert [tuple(r) for r in spark.sql("SELECT * FROM geom_vertices('POINT ZM (1 2 3 4)')").collect()] == [(1, 1.0, 2.0, 3.0, 4.0)]
    assert spark.sql("SELECT * FROM geom_vertices(named_struct('x', 1D, 'y', 2D))").columns == ["vertex", "x", "y"]


@pytest.mark.parametrize("coord_type", [1, 2])
@pytest.mark.parametrize("dims", ["XY", "XYM", "XYZM"])
@pytest.mark.parametrize("kind", range(1, 7))
def test_events_of_a_native_type_by_its_sql_body(spark, kind, dims, coord_type):
    from terraframe.functions.wkt import from_wkt

    name = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}[kind]
    a, b, c = (" ".join(str(10 * i + k) for k in range(len(dims))) for i in range(3))
    body = {1: f"({a})", 2: f"({a}, {b})", 3: f"(({a}, {b}), ({c}))", 4: f"({a}, {b})", 5: f"(({a}, {b}), ({c}))", 6: f"((({a}, {b})), (({c}), ({b}, {a})))"}[kind]
    head = f"{name} {dims[2:]}".strip()
    t = native_type(name, dims, coord_type)
    df = spark.createDataFrame([(1, f"{head} {body}"), (2, None), (3, f"{head} EMPTY")], "id long, w string").select("id", tag(from_wkt(F.col("w"), t), "g", t))
    df.createOrReplaceTempView("tf_sql_body")
    f = register_native_events(spark, "tf_events", t)
    got = spark.sql(f"SELECT t.id AS feat_id, e.* FROM tf_sql_body t, LATERAL {f}(t.g) e")
    assert rows(got) == rows(geometry_events(df, "g", "id"))
    if coord_type == 1:  # of an empty list geom_events can't know the dimensions
        register_tables(spark)
        python = spark.sql(f"SELECT t.id AS feat_id, e.* FROM tf_sql_body t, LATERAL geom_events(t.g, '{name.lower()}') e WHERE t.id < 3")
        assert rows(got.filter("feat_id < 3")) == rows(python)


def test_geom_events_sql_never_starts_python(spark):
    from terraframe.plans.queries import QUERIES

    plan = QUERIES["geom_events_sql"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Generate" in plan


def test_no_sql_body_for_what_is_read_from_text(spark):
    with pytest.raises(ValueError, match="native type"):
        register_native_events(spark, "tf_refused", wkt_type())
