import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.functions import wkb as B
from terraframe.functions.coords import tag
from terraframe.functions.geometry import parse_wkt, write_wkb
from terraframe.operators import rejects as R
from terraframe.operators.vector import gather_table
from terraframe.types import linestring_type, parse_field, point_type, wkb_type, wkt_type

TEXTS = ["POINT (1 2)", None, "POINT (3 nan)", "POINT EMPTY", " POINT  ( 5 6 ) ", "POINT (1", "POINT banana", "LINESTRING (1 2, 3 4)", "", "POINT (1 2) x", "MULTIPOINT ((7 8))", "POINT Z (1 2 3)"]


def test_values_errors_and_bytes(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, w string").repartition(3)
    got = {r.id: r.r for r in df.select("id", R.try_read(F.col("w"), wkt_type(), point_type()).alias("r")).collect()}
    assert got[1] is None and (got[0].value.x, got[0].value.y, got[0].error) == (1, 2, None) and (got[4].value.x, got[4].value.y) == (5, 6)
    assert math.isnan(got[2].value.y) and math.isnan(got[3].value.x)
    assert (got[5].value, got[5].byte) == (None, 8) and got[5].error.startswith("Expected")
    for i in (6, 8, 9):
        with pytest.raises(ValueError) as told:
            parse_wkt(TEXTS[i])
        assert f"{got[i].error} at byte {got[i].byte}" == str(told.value) and got[i].value is None
    assert got[7].error and got[7].byte is None and got[7].value is None
    assert (got[10].value.x, got[10].value.y) == (7, 8)
    with pytest.raises(ValueError):
        R.try_read(F.col("w"), point_type(), point_type())


def test_split_into_two_tables(spark, tmp_path):
    good = [write_wkb(parse_wkt(t)) for t in ("LINESTRING (1 2, 3 4)", "LINESTRING EMPTY")]
    rows = [(0, good[0]), (1, good[1]), (2, None), (3, good[0][:-1]), (4, b""), (5, b"\x01\x63\x00\x00\x00"), (6, write_wkb(parse_wkt("LINESTRING (9 9, 8 8)"), True))]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "id long, b binary").select("id", tag(F.col("b"), "b", wkb_type().with_crs("EPSG:7"))).repartition(2)
    clean, rejected = R.split_rejected(df, "b", linestring_type(), str(tmp_path / "t"))
    assert clean.columns == ["id", "b"] and parse_field(clean.schema["b"]) == linestring_type().with_crs("EPSG:7")
    assert sorted((r.id, r.b and [(p.x, p.y) for p in r.b]) for r in clean.collect()) == [(0, [(1, 2), (3, 4)]), (1, []), (2, None), (6, [(9, 9), (8, 8)])]
    got = {r.id: r for r in rejected.collect()}
    assert set(got) == {3, 4, 5} and bytes(got[3].b) == good[0][:-1] and got[3].error == "TOO_FEW_BYTES" and got[5].error == "INVALID_GEOMETRY_TYPE" and got[5].byte == 5
    assert parse_field(rejected.schema["b"]).crs == "EPSG:7"
    with pytest.raises(ValueError, match="columns named error"):
        R.split_rejected(df.withColumn("Error", F.lit(1)), "b", linestring_type())


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_doubles_of_binary_are_exact_without_python(spark, dims):
    t = point_type(dimensions=dims)
    rng = np.random.default_rng(dims)
    width = len(t.ordinates)
    bits = [*rng.integers(0, 1 << 64, 400 * width, dtype=np.uint64).tolist(), *[b | s << 63 for s in (0, 1) for b in (0, 1, (1 << 52) - 1, 1 << 52, (1 << 52) + 1, 0x7FE << 52, 0x7FEFFFFFFFFFFFFF, 0x7FF << 52, 0x7FF8 << 48, 0x3FF << 52, 0x3CA << 52, rng.integers(0, 1 << 52).item())]]
    bits += [0] * (-len(bits) % width)
    rows = []
    for k in range(0, len(bits), width):
        for end in "<>":
            rows.append(struct.pack(end + "BI", end == "<", 1 + 1000 * (dims - 1)) + struct.pack(f"{end}{width}Q", *bits[k : k + width]))
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(rows)], "id long, b binary").repartition(3)
    got = df.select("id", B.from_wkb(F.col("b"), t, "regular").alias("g"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    exact = lambda r: [struct.pack("<d", v) if v == v else b"nan" for v in r.g]
    want = {r.id: exact(r) for r in df.select("id", B.from_wkb(F.col("b"), t).alias("g")).collect()}
    assert {r.id: exact(r) for r in got.collect()} == want and len(want) == len(rows)


def test_other_binary_is_refused(spark):
    odd = [b"", rows := write_wkb(parse_wkt("POINT (1 2)"))[:-1], write_wkb(parse_wkt("LINESTRING (1 2, 3 4)")), write_wkb(parse_wkt("POINT Z (1 2 3)")), b"\x02" + write_wkb(parse_wkt("POINT (1 2)"))[1:]]
    assert rows
    for b in odd:
        df = spark.createDataFrame([(bytearray(b),)], "b binary")
        assert df.select(B.from_wkb_regular(F.col("b"), point_type())).first()[0] is None
        with pytest.raises(Exception, match="Expected a plain point"):
            df.select(B.from_wkb(F.col("b"), point_type(), "regular")).collect()


def test_gather_by_a_table(spark):
    rows = spark.range(5000).select((F.col("id") * 3).alias("k"), F.lit("x").alias("v")).repartition(7)
    index = spark.range(100_000).select(F.col("id").alias("at"), (5100 - F.col("id") % 5200).alias("pos"))
    got = {r.at: r.k for r in gather_table(rows, ["k"], index).collect()}
    assert got == {at: 3 * (5100 - at % 5200 - 1) for at in range(100_000) if 1 <= 5100 - at % 5200 <= 5000}
    few = spark.createDataFrame([(1, 4999), (2, None), (3, 4999), (4, 0), (5, 6000)], "at long, pos long")
    found = gather_table(rows, ["k"], few)
    assert sorted((r.at, r.k) for r in found.collect()) == [(1, 14994), (3, 14994)]
    assert gather_table(rows.limit(0), ["k"], few).count() == 0
