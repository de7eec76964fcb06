"""Codes, validity, status and binary of columns of mixed text and binary geometries, against the readers of single values."""

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from terraframe.functions import mixed
from terraframe.functions.coords import tag
from terraframe.functions.geometry import parse_wkb, parse_wkt, wkb_srid, wkb_status, write_wkb
from terraframe.operators.infer import infer_codes, infer_schema
from terraframe.operators.kernels import kernel
from terraframe.types import wkb_type, wkt_type

BODIES = {
    "POINT": "(1{z})",
    "LINESTRING": "(1{z}, 2{z})",
    "POLYGON": "((0{z}, 1{z}, 2{z}, 0{z}), (5{z}, 6{z}))",
    "MULTIPOINT": "(1{z}, 2{z})",
    "MULTILINESTRING": "((1{z}, 2{z}), (3{z}))",
    "MULTIPOLYGON": "(((0{z}, 1{z})), ((2{z}), (3{z})))",
}
TEXTS = [None]
for mark, more in (("", " 2"), (" Z", " 2 3"), (" M", " 2 4"), (" ZM", " 2 3 4")):
    for name, body in BODIES.items():
        TEXTS += [f"{name}{mark} {body.replace('{z}', more)}", f"{name}{mark} EMPTY", f" {name}{mark}  {body.replace('{z}', more).replace(', ', ' ,')} "]
    TEXTS += [f"GEOMETRYCOLLECTION{mark} EMPTY", f"GEOMETRYCOLLECTION{mark} (POINT{mark} (1{more}), LINESTRING{mark} EMPTY)", f"GEOMETRYCOLLECTION{mark} (LINESTRING{mark} EMPTY, GEOMETRYCOLLECTION{mark} (POLYGON{mark} ((1{more}))))", f"GEOMETRYCOLLECTION{mark} (POLYGON{mark} EMPTY)"]
TEXTS += ["POINT (NaN NaN)", "POINT (nan 1)", "POINT (inf -inf)", "LINESTRING (nan nan, 1 2)", "MULTIPOINT ((1 2), (3 4))", "POLYGON ((0 0, 1 1), EMPTY)", "POLYGON (EMPTY)", "POINT (1e300 -2.5E-7)"]
BROKEN = ["POINT banana 12", "POINTZ (1 2 3)", "POINT (1 2", "POINT (1)", "LINESTRING (1 2, 3)", "1 2", "", "POINT Z (1 2)", "POINT (1 2) x", "CIRCLE (1 2)"]


def as_text(read, f):
    def one(v):
        try:
            return f(read(v))
        except ValueError:
            return "error"

    return one


def test_text_codes_are_the_readers():
    want = [None if t is None else (g.code if any(True for _ in g.coords()) else None) for t in TEXTS for g in [t and parse_wkt(t)]]
    assert mixed.codes(pa.array(TEXTS), True).to_pylist() == want
    assert mixed.codes(pa.array(["POINT (NaN NaN)"]), True).to_pylist() == [1]
    assert mixed.headers(pa.array(TEXTS), True).to_pylist() == [None if t is None else parse_wkt(t).code for t in TEXTS]
    assert mixed.codes(pa.array([], pa.string()), True).to_pylist() == []


@pytest.mark.parametrize("text", BROKEN)
def test_broken_text_is_an_error(text):
    with pytest.raises(ValueError):
        parse_wkt(text)
    with pytest.raises(ValueError):
        mixed.codes(pa.array(["POINT (1 2)", text]), True)
    assert mixed.readable(pa.array(["POINT (1 2)", None, text]), True).to_pylist() == [True, None, False]


def test_binary_columns():
    good = [None if t is None else write_wkb(parse_wkt(t)) for t in TEXTS] + [write_wkb(parse_wkt(t), True) for t in TEXTS if t]
    odd = [b"", b"\x01", b"\x05" + good[1][1:], good[1] + b"x", good[1][:-1], b"\x01\x63\x00\x00\x00", bytes.fromhex("0101000020e6100000") + bytes(16), bytes.fromhex("01010000c0") + bytes(32)]
    values = good + odd
    a = pa.array(values, pa.binary())
    assert mixed.statuses(a).to_pylist() == [None if v is None else wkb_status(v) for v in values]
    assert mixed.readable(a, False).to_pylist() == [None if v is None else as_text(parse_wkb, lambda g: True)(v) is True for v in values]
    srids = [v for v in values if v is not None and wkb_status(v) in ("OK", "TOO_MANY_BYTES")]
    assert mixed.srids(pa.array(srids, pa.binary())).to_pylist() == [wkb_srid(v) for v in srids]
    assert mixed.codes(pa.array(good, pa.binary()), False).to_pylist() == [None if v is None or next(parse_wkb(v).coords(), None) is None else parse_wkb(v).code for v in good]
    for order in (False, True):
        assert mixed.wkb_of(pa.array(TEXTS), True, order).to_pylist() == [None if t is None else write_wkb(parse_wkt(t), order) for t in TEXTS]
        assert [x and x.hex() for x in mixed.wkb_of(pa.array(good, pa.binary()), False, order).to_pylist()] == [v and write_wkb(parse_wkb(v), order).hex() for v in good]


def test_inference_reads_text_and_binary_alike(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "w string").select(tag(F.col("w"), "w", wkt_type())).repartition(3)
    binary = spark.createDataFrame([(None if t is None or t.startswith("POINT") and "EMPTY" in t else write_wkb(parse_wkt(t)),) for t in TEXTS], "w binary").select(tag(F.col("w"), "w", wkb_type()))
    assert infer_codes(texts, "w") == infer_codes(binary, "w") == [k + d for d in (0, 1000, 2000, 3000) for k in range(1, 8)]
    nan = spark.createDataFrame([("POINT (NaN NaN)",), ("MULTIPOINT EMPTY",)], "w string").select(tag(F.col("w"), "w", wkt_type()))
    assert str(infer_schema(nan, "w").geometry_type) == str(infer_schema(nan.limit(1), "w").geometry_type) and infer_codes(nan, "w") == [1]
    for text in BROKEN[:3]:
        df = spark.createDataFrame([("POINT (1 2)",), (text,)], "w string").select(tag(F.col("w"), "w", wkt_type()))
        with pytest.raises(PythonException):
            kernel("unique_geometry_types_agg", df, "w").collect()
