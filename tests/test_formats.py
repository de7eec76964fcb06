"""Text and binary: goldens, the two reading tiers, and round trips of random geometries."""

import math
import re
import struct
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraframe import types as G
from terraframe.functions import columnar as K
from terraframe.functions import geometry as Y
from terraframe.functions import wkb as B
from terraframe.functions.numbers import format_double
from terraframe.functions.wkt import as_wkt, from_wkt, from_wkt_any, from_wkt_regular, native_from_wkt
from terraframe.operators.cast import cast

#: Every type and dimension, EMPTY at every level, nested collections.
CORPUS = [f"{n}{d} {b}" for d, c in (("", "0 1"), (" Z", "0 1 2"), (" M", "0 1 2"), (" ZM", "0 1 2 3")) for n, b in (("POINT", f"({c})"), ("LINESTRING", f"({c}, {c})"), ("POLYGON", f"(({c}, {c}, {c}), ({c}))"), ("MULTIPOINT", f"({c}, {c})"), ("MULTILINESTRING", f"(({c}, {c}), ({c}))"), ("MULTIPOLYGON", f"((({c}, {c})), (({c}), ({c})))"))]
CORPUS += [f"{n} EMPTY" for n in Y.NAMES[1:]] + ["POLYGON (EMPTY, (0 1))", "MULTILINESTRING (EMPTY)", "MULTIPOLYGON (EMPTY, ((0 1)))", "MULTIPOLYGON ((EMPTY))"]
CORPUS += ["GEOMETRYCOLLECTION (POINT (0 1), LINESTRING Z (0 1 2, 3 4 5), GEOMETRYCOLLECTION (POINT (2 3), GEOMETRYCOLLECTION EMPTY))"]


@pytest.mark.parametrize("text", CORPUS)
def test_corpus_identity(text):
    g = Y.parse_wkt(text)
    assert Y.write_wkt(g) == text
    for big in (False, True):
        assert Y.write_wkt(Y.parse_wkb(Y.write_wkb(g, big))) == (text if not text.startswith("POINT EMPTY") else "POINT (nan nan)")


@pytest.mark.parametrize(
    "text, message",
    [("POINT (0 1", "')' at byte 10"), ("POINT (0 x)", "number at byte 9"), ("point (0 1)", "geometry type at byte 0"), ("POINT (0 1) x", "end of input at byte 12"), ("LINESTRING (0 1,)", "number at byte 16"), ("LINESTRING", "'(' or 'EMPTY' at byte 10"), ("", "geometry type at byte 0"), ("POLYGON (0 1)", "'(' or 'EMPTY' at byte 9")],
)
def test_errors_name_the_byte(text, message):
    with pytest.raises(Y.ParseError, match=re.escape("Expected " + message)):
        Y.parse_wkt(text)


def test_flat_and_nested_multipoint():
    g = Y.parse_wkt("MULTIPOINT ((0 1), 2 3, EMPTY)")
    assert Y.write_wkt(g) == "MULTIPOINT (0 1, 2 3, EMPTY)"
    assert Y.write_wkt(g, flat_multipoint=False) == "MULTIPOINT ((0 1), (2 3), EMPTY)"


NUMBERS = [30.0, 1e7, 1.5e-5, -0.0, 0.0, 1e17, 0.125, 0.375, -2.5, 1 / 3, 1e20, -1.5e18, 123456789.123456, 5e-324, 1e-17, math.nan, math.inf, -math.inf, 99999999999999.98]


@pytest.mark.parametrize("precision", [16, 2, 0, 7, 99, -1])
def test_numbers_agree_in_both_tiers(spark, precision):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(NUMBERS)], "i int, v double")
    got = {r.i: r.s for r in df.select("i", format_double(F.col("v"), precision).alias("s")).collect()}
    assert [got[i] for i in range(len(NUMBERS))] == [Y.number_text(v, precision) for v in NUMBERS]


def test_number_goldens():
    assert [Y.number_text(v) for v in (30.0, 1e7, 1.5e-5, -0.0, 1e20, math.nan, math.inf)] == ["30", "10000000", "0.000015", "0", "1e+20", "nan", "Infinity"]
    assert Y.number_text(0.125, 2) == "0.12" and Y.number_text(0.375, 2) == "0.38"


def test_tiers_agree(spark):
    texts = {
        "POINT": ["POINT (1 -2.5)", " POINT( 1e3   2 ) ", "POINT EMPTY", "POINT (.5 1.)", "POINT (nan 1)", None],
        "LINESTRING": ["LINESTRING (0 1, 2 3)", "LINESTRING(0 1,2 3)", "LINESTRING EMPTY", "LINESTRING (0 1)", None],
        "POLYGON": ["POLYGON ((0 1, 2 3, 0 1), (5 5, 6 6))", "POLYGON EMPTY", "POLYGON ((0 1), EMPTY)"],
        "MULTIPOINT": ["MULTIPOINT (0 1, 2 3)", "MULTIPOINT ((0 1), (2 3))", "MULTIPOINT EMPTY", "POINT (1 2)"],
        "MULTILINESTRING": ["MULTILINESTRING ((0 1, 2 3), (4 5))", "LINESTRING (1 2, 3 4)"],
        "MULTIPOLYGON": ["MULTIPOLYGON (((0 1, 2 3)), ((4 5), (6 7)))", "POLYGON ((1 2))"],
    }
    for name, ts in texts.items():
        t = G.native_type(name)
        df = spark.createDataFrame([(i, x) for i, x in enumerate(ts)], "i int, w string")
        rows = df.select("i", as_wkt(from_wkt(F.col("w"), t), t).alias("a"), as_wkt(from_wkt_any(F.col("w"), t), t).alias("b"), from_wkt_regular(F.col("w"), t).isNotNull().alias("first")).orderBy("i").collect()
        assert [r.a for r in rows] == [r.b for r in rows], name
        assert rows[0].first and [r.a is None for r in rows] == [x is None for x in ts]


def test_regular_mode_refuses_other_text(spark):
    df = spark.createDataFrame([("POINT (1 x)",)], "w string")
    with pytest.raises(Exception, match="Expected regular text"):
        df.select(from_wkt(F.col("w"), G.point_type(), "regular")).collect()
    with pytest.raises(Exception, match="Expected number at byte 9"):
        df.select(from_wkt(F.col("w"), G.point_type())).collect()


def test_a_mark_is_a_word(spark):
    t = G.point_type(dimensions="XYZ")
    df = spark.createDataFrame([("POINT Z (1 2 3)",), ("POINT Z(1 2 3)",), ("POINT\tZ (1 2 3)",), ("POINTZ (1 2 3)",), ("POINT (1 2)",)], "w string")
    assert [r.a is not None for r in df.select(from_wkt_regular(F.col("w"), t).alias("a")).collect()] == [True, True, True, False, False]
    assert math.isnan(df.filter("w = 'POINT (1 2)'").select(from_wkt(F.col("w"), t).alias("g")).first().g.z)


def test_strict_wkb_status():
    ok = Y.write_wkb(Y.parse_wkt("MULTIPOINT (0 1, 2 3)"))
    assert Y.wkb_status(ok) == "OK" and Y.wkb_status(ok + b"x") == "TOO_MANY_BYTES" and Y.wkb_status(ok[:-1]) == "TOO_FEW_BYTES"
    assert Y.wkb_status(b"\x02" + ok[1:]) == "INVALID_ENDIAN" and Y.wkb_status(b"\x01\x63\x00\x00\x00") == "INVALID_GEOMETRY_TYPE" and Y.wkb_status(b"") == "TOO_FEW_BYTES"
    assert Y.parse_wkb(ok + b"trailing").kind == 4
    extended = struct.pack("<BII3d", 1, 0x80000000 | 0x20000000 | 1, 4326, 1, 2, 3)
    assert Y.wkb_srid(extended) == 4326 and Y.write_wkt(Y.parse_wkb(extended)) == "POINT Z (1 2 3)"


def test_wkb_columns(spark):
    texts = ["POINT (1 2)", "POINT EMPTY", None, "POINT (3 4)"]
    t = G.point_type()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, w string")
    g = df.select("i", from_wkt(F.col("w"), t).alias("g"))
    b = g.select("i", B.as_wkb(F.col("g"), t).alias("b"), B.as_wkb(F.col("g"), t, True).alias("big"))
    rows = b.select("i", "b", B.type_code(F.col("b")).alias("c"), B.type_code(F.col("big")).alias("c2"), as_wkt(B.from_wkb(F.col("b"), t), t).alias("w"), as_wkt(B.from_wkb(F.col("big"), t), t).alias("w2")).orderBy("i").collect()
    assert [r.c for r in rows] == [1, 1, None, 1] == [r.c2 for r in rows]
    assert [r.w for r in rows] == ["POINT (1 2)", "POINT (nan nan)", None, "POINT (3 4)"] == [r.w2 for r in rows]
    assert bytes(rows[0].b) == Y.write_wkb(Y.parse_wkt("POINT (1 2)")) and len(rows[1].b) == 21


ORD = st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: v + 0.0)


def geoms(kind, dims):
    c = st.tuples(*[ORD] * Y.WIDTH[dims])
    if kind == 1:
        return st.builds(lambda x: Y.Geom(1, dims, [x], []), c)
    if kind == 2:
        return st.builds(lambda x: Y.Geom(2, dims, x, []), st.lists(c, max_size=4))
    if kind == 3:
        return st.builds(lambda x: Y.Geom(3, dims, [], x), st.lists(st.lists(c, max_size=3), max_size=3))
    return st.builds(lambda x: Y.Geom(kind, dims, [], x), st.lists(geoms(Y.MEMBER[kind], dims), max_size=3))


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_round_trip_of_random_geometries(data):
    kind, dims = data.draw(st.integers(1, 6)), data.draw(st.integers(1, 4))
    g = data.draw(geoms(kind, dims))
    assert Y.parse_wkb(Y.write_wkb(g)) == g
    assert Y.write_wkt(Y.parse_wkt(Y.write_wkt(g))) == Y.write_wkt(g)


def test_native_text_binary_native(spark):
    """WKT to native to WKB to WKT over the corpus, by type, in Spark."""
    for k, n in enumerate(Y.NAMES[1:7], 1):
        for d in range(1, 5):
            t = G.native_type(k, d)
            tag = n + ["", "", " Z", " M", " ZM"][d] + " "
            texts = [x for x in CORPUS if x.startswith(tag) and (x[len(tag)] == "(") and "EMPTY" not in x]
            df = spark.createDataFrame([(x,) for x in texts], "w string")
            g = cast(F.col("w"), G.wkt_type(), t)
            for layout in ("SEPARATE", "INTERLEAVED"):
                u = t.with_coord_type(layout)
                rows = df.select("w", cast(cast(cast(g, t, u), u, G.wkb_type()), G.wkb_type(), G.wkt_type()).alias("back")).collect()
                assert all(r.w == r.back for r in rows), (n, d)


# -- whole columns ------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_columns_agree_with_single_values(data):
    """Random columns of mixed values: reading, writing and bounds of the column are those of its values."""
    import pyarrow as pa

    from terraframe.functions import columnar as A
    from terraframe.functions.wkb import native_from_wkb
    from terraframe.functions.wkt import native_from_wkt, native_rows
    from terraframe.operators.kernels import boxes_of

    kind, dims = data.draw(st.integers(1, 6)), data.draw(st.integers(1, 4))
    layout = data.draw(st.sampled_from(["SEPARATE", "INTERLEAVED"]))
    t = G.native_type(kind, dims, layout)
    own = data.draw(st.lists(st.one_of(st.none(), geoms(kind, dims)), max_size=6))
    native = native_rows(own, t)
    # parts without coordinates are dropped by the readers of single values, as empty rings in text
    binary = pa.array([None if g is None else Y.write_wkb(g, data.draw(st.booleans())) for g in own], pa.binary())
    flat = A.disassembled(native, t)
    assert A.assembled(flat, t).equals(native)
    for big in (False, True):
        want = [None if g is None else Y.write_wkb(Y.from_native(v, kind, dims), big) for g, v in zip(own, B._plain(native))]
        assert A.write_wkb(flat, t, big).to_pylist() == want
    text = pa.array([None if g is None else data.draw(st.sampled_from(["{}", " {} ", "{}\n"])).format(Y.write_wkt(g)).replace(", ", data.draw(st.sampled_from([",", " , ", ", "]))) for g in own], pa.string())
    assert native_from_wkt(text, t).equals(native_rows([None if x is None else Y.parse_wkt(x) for x in text.to_pylist()], t))
    sliced = pa.concat_arrays([binary, binary]).slice(len(binary))
    got = native_from_wkb(sliced, t)
    assert got.equals(native_rows([None if x is None else Y.parse_wkb(x) for x in binary.to_pylist()], t))
    for column, wkt in ((text, True), (binary, False)):
        read = Y.parse_wkt if wkt else Y.parse_wkb
        for b, x in zip(boxes_of(column, wkt).to_pylist(), column.to_pylist()):
            cs = [] if x is None else list(read(x).coords())
            assert (b is None) == (x is None) and (not cs or tuple(b.values()) == (min(c[0] for c in cs), min(c[1] for c in cs), max(c[0] for c in cs), max(c[1] for c in cs)))


BROKEN = ["POINT (0 1", "POINT (0 1) x", "LINESTRING (0 1,)", "LINESTRING (0 1, 2)", "POLYGON (0 1)", "POINT (1 2, 3 4)", "LINESTRING ((0 1))", "POINT ()", "POINT (1-2 3)", "POINT (- 3)", "POINT (1e 3)", "POINTE (1 2)", "POINT (1 2))", "POINT ((1 2)", "MULTIPOLYGON (((0 1)),)", "POINT Z (1 2)", "LINESTRING (0 1 2)", "POINT (+1 2)", "POINT (1 2) (3 4)", "1 2", "", "(", ")", "POINT\x0b(1 2)"]


@pytest.mark.parametrize("text", BROKEN)
@pytest.mark.parametrize("name", ["POINT", "LINESTRING", "POLYGON", "MULTIPOLYGON"])
def test_no_broken_text_is_regular(text, name):
    """Neighbours of a broken value are read, the broken one never is."""
    import pyarrow as pa

    from terraframe.functions.columnar import read_wkt

    good = {"POINT": "POINT (7 8)", "LINESTRING": "LINESTRING (7 8, 9 1)", "POLYGON": "POLYGON ((7 8, 1 1))", "MULTIPOLYGON": "MULTIPOLYGON (((7 8)))"}[name]
    t = G.native_type(name)
    flat = read_wkt(pa.array([good, text, None, good]), t)
    assert flat.good.tolist() == [True, False, False, True]


@pytest.mark.parametrize("mode", ["auto", "regular", "any"])
@pytest.mark.parametrize("name, body", [("LINESTRING", "({})"), ("MULTIPOINT", "({})"), ("POLYGON", "(({}), ({}))"), ("MULTILINESTRING", "(({}), ({}))"), ("MULTIPOLYGON", "((({}), ({})), (({})))")])
def test_a_hundred_thousand_vertices(spark, mode, name, body):
    n = 100_000
    t = G.native_type(name)
    coords = ", ".join(f"{i}.5 {-i}" for i in range(n))
    df = spark.createDataFrame([(1, f"{name} {body.replace('{}', coords)}"), (2, f"{name} {body.replace('{}', '1 2')}")], "i int, w string")
    g = df.select("i", from_wkt(F.col("w"), t, mode).alias("g"))
    from terraframe.functions.coords import num_coords
    from terraframe.operators.kernels import box

    rows = g.select("i", num_coords(F.col("g"), t).alias("n"), box(F.col("g"), t).alias("b")).orderBy("i").collect()
    assert [r.n for r in rows] == [n * body.count("{}"), body.count("{}")] and tuple(rows[0].b) == (0.5, -(n - 1), n - 0.5, 0)
    back = g.select("i", B.from_wkb(B.as_wkb(F.col("g"), t), t).alias("h"), "g")
    assert back.filter("g = h").count() == 2


def test_codes_of_extended_and_empty_binary(spark):
    """An SRID is no count, and a geometry whose first parts are empty may have a later one."""
    from terraframe.operators.kernels import geometry_code

    def extended(text, srid=4326):
        b = Y.write_wkb(Y.parse_wkt(text))
        (code,) = struct.unpack_from("<I", b, 1)
        return b[:1] + struct.pack("<II", code | 0x20000000, srid) + b[5:]

    cases = {"LINESTRING EMPTY": None, "LINESTRING (0 1, 2 3)": 2, "POLYGON EMPTY": None, "POLYGON (EMPTY)": None, "POLYGON (EMPTY, (0 1))": 3, "MULTIPOLYGON (EMPTY)": None, "MULTIPOLYGON ((EMPTY), ((0 1)))": 6, "MULTILINESTRING (EMPTY, (1 2))": 5, "MULTIPOINT EMPTY": None, "MULTIPOINT (1 2)": 4, "GEOMETRYCOLLECTION (LINESTRING EMPTY)": None, "GEOMETRYCOLLECTION (POINT (1 2))": 7, "POINT (1 2)": 1}
    rows = [(i, k, bytes(f(w))) for i, w in enumerate(cases) for k, f in enumerate((lambda w: Y.write_wkb(Y.parse_wkt(w)), lambda w: Y.write_wkb(Y.parse_wkt(w), True), extended))]
    df = spark.createDataFrame(rows, "i int, k int, b binary")
    got = {(r.i, r.k): r.c for r in df.select("i", "k", geometry_code(F.col("b"), G.wkb_type()).alias("c")).collect()}
    assert got == {(i, k): want for i, want in enumerate(cases.values()) for k in range(3)}
    assert df.select(geometry_code(F.lit(None).cast("binary"), G.wkb_type()).alias("c")).first().c is None


@pytest.mark.parametrize("body", ["(1 2, 3 4)", "(1 2,3 4 , 5 6)  ", "(1 2, 3 4,)", "(,1 2)", "(1 2, , 3 4)", "(1 2, 3 x)", "(1 2, (3 4), 5 6)", "(1 2, 3 4) z", "(1 2 3, 4 5)", "()", "EMPTY", "(1 2, 3 4", "(1 2), (3 4)"])
def test_pieces_of_long_text_and_columns(monkeypatch, body):
    """What pieces give is what the whole gives, whatever the cut."""
    rows = ["LINESTRING " + body, None, "LINESTRING (" + ", ".join(f"{i} {i + 0.5}" for i in range(50)) + body.replace("(", ", ", 1)]
    t = G.linestring_type()
    want = [K._read_regular(pa.array([r], pa.string()), t) for r in rows]
    for piece in (1, 7, 16, 64):
        monkeypatch.setattr(K, "PIECE", piece)
        for r, w in zip(rows, want):
            got = K.read_wkt(pa.array([r], pa.string()), t)
            assert got.good.tolist() in (w.good.tolist(), [False])  # a piece may be too short for a coordinate
            assert not got.good[0] or (got.coords == w.coords).all() and [list(c) for c in got.counts] == [list(c) for c in w.counts]
            assert piece < 64 or got.good.tolist() == w.good.tolist()
        good = pa.array([r for r, w in zip(rows, want) if r is None or w.good[0]] * 3, pa.string())
        native = native_from_wkt(good, t)
        assert native.to_pylist() == [None if r is None else [{"x": x, "y": y} for x, y in Y.parse_wkt(r).points] for r in good.to_pylist()]
        binary = K.in_pieces(native, lambda a: K.write_wkb(K.disassembled(a, t), t))
        assert binary.to_pylist() == [None if r is None else Y.write_wkb(Y.parse_wkt(r)) for r in good.to_pylist()]
        assert B.native_from_wkb(binary, t) == native


def test_memory_of_long_text(monkeypatch):
    monkeypatch.setattr(K, "PIECE", 1 << 18, raising=False)
    a = pa.array(["LINESTRING (" + ", ".join(f"{i}.25 {i}.5" for i in range(200_000)) + ")"] * 2)
    tracemalloc.start()
    assert [len(x) for x in native_from_wkt(a, G.linestring_type())] == [200_000] * 2
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * a.nbytes, peak / a.nbytes
