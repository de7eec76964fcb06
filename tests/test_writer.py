import math
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraframe.functions.coords import tag
from terraframe.functions.geometry import number_text, parse_wkb, parse_wkt, write_wkb, write_wkt
from terraframe.functions.wkt import from_wkt
from terraframe.operators import visit as X
from terraframe.types import multipolygon_type, parse_field, wkt_type

TEXTS = [None, "POINT (1 2)", "POINT EMPTY", "LINESTRING Z (1 2 3, 4 5 6)", "LINESTRING EMPTY", "POLYGON M ((0 0 1, 1 0 2, 1 1 3, 0 0 4), (5 5 5, 6 6 6))", "MULTIPOINT (1 2, 3 4)", "MULTILINESTRING ZM ((1 2 3 4), (5 6 7 8, 9 10 11 12))", "MULTIPOLYGON (((0 0, 1 1)), ((2 2), (3 3)))", "GEOMETRYCOLLECTION EMPTY", "GEOMETRYCOLLECTION (POINT (1 2), GEOMETRYCOLLECTION (MULTIPOINT (3 4), POLYGON EMPTY), LINESTRING (5 6))"]
TEXTS.append("GEOMETRYCOLLECTION (" * 20 + "POINT (1 2)" + ")" * 20)


def test_round_trip_of_any_features(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, w string").select("id", tag(F.col("w"), "w", wkt_type())).repartition(3)
    events = X.geometry_events(df, "w", "id", numbered=True)
    assert events.columns[-1] == "seq"
    built = X.assemble_wkb(events.repartition(5, "seq"), "g")
    assert parse_field(built.schema["g"]).is_wkb
    got = {r.feat_id: r.g and write_wkt(parse_wkb(bytes(r.g))) for r in built.collect()}
    assert got == {i: t and write_wkt(parse_wkb(write_wkb(parse_wkt(t)))) for i, t in enumerate(TEXTS)}


def test_native_events_are_numbered_alike(spark):
    text = "MULTIPOLYGON (((0 0, 1 1), (2 2)), ((3 3, 4 4)))"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, w string")
    t = multipolygon_type()
    native = X.geometry_events(df.select("id", tag(from_wkt(F.col("w"), t), "g", t)), "g", "id", numbered=True)
    plain = X.geometry_events(df.select("id", tag(F.col("w"), "w", wkt_type())), "w", "id", numbered=True)
    key = lambda r: (r.feat_id, r.seq)
    assert list(map(str, sorted(native.collect(), key=key))) == list(map(str, sorted(plain.collect(), key=key)))


START, END = ("feat_start", None, 0, ()), ("feat_end", None, 0, ())
POINT = ("geom_start", 1, 1, ())
CLOSE = ("geom_end", 1, 1, ())
COORD = ("coord", 1, 1, (1.0, 2.0))


@pytest.mark.parametrize(
    "events, message",
    [
        ([POINT], "event 0: geom_start before the start"),
        ([START, START], "event 1: feat_start twice"),
        ([START, POINT, COORD, COORD], "event 3: coord has no place"),
        ([START, COORD], "event 1: coord has no place"),
        ([START, POINT, COORD, END], "event 3: feat_end before the end of a geometry"),
        ([START, END], "event 1: feat_end before the end"),
        ([START, CLOSE], "event 1: geom_end without"),
        ([START, POINT, POINT], "event 2: geom_start of type 1 has no place"),
        ([START, ("geom_start", 4, 1, ()), ("geom_start", 2, 1, ())], "event 2: geom_start of type 2"),
        ([START, ("geom_start", 9, 1, ())], "event 1: geom_start of type 9"),
        ([START, POINT, ("ring_start", 1, 1, ())], "event 2: ring_start outside"),
        ([START, ("geom_start", 3, 1, ()), ("coord", 3, 1, (1.0, 2.0))], "event 2: coord has no place"),
        ([START, ("geom_start", 3, 1, ()), ("ring_end", 3, 1, ())], "event 2: ring_end without"),
        ([START, ("geom_start", 3, 1, ()), ("ring_start", 3, 1, ()), ("geom_end", 3, 1, ())], "event 3: geom_end inside a ring"),
        ([START, POINT, ("null_feat", None, 0, ())], "event 2: null_feat inside"),
        ([START, ("null_feat", None, 0, ()), END, START], "event 3: feat_start after the end"),
        ([START, ("jump", None, 0, ())], "event 1: unknown event 'jump'"),
        ([START, POINT, COORD, CLOSE], "event 4: no feat_end"),
    ],
)
def test_events_out_of_order(events, message):
    w = X.Writer()
    with pytest.raises(ValueError, match=message):
        for e in events:
            w.push(*e)
        w.finish()


def test_missing_numbers_are_an_error(spark):
    df = spark.createDataFrame([(1, "POINT (1 2)")], "id long, w string").select("id", tag(F.col("w"), "w", wkt_type()))
    events = X.geometry_events(df, "w", "id", numbered=True)
    with pytest.raises(Exception, match="are not 0, 1, 2"):
        X.assemble_wkb(events.filter("seq <> 2")).collect()


def test_events_go_to_the_writer_by_the_column():
    """As one by one, on a slice and with nulls; numbers alone need no decimal arithmetic."""
    rows = []
    for t in TEXTS[1:]:
        v = X._Events()
        X.walk(parse_wkt(t), 1, v)
        rows += [{"seq": 0, "event": r[1], "geometry_type": r[6], "dimensions": r[7], **dict(zip("xyzm", r[8:]))} for r in v.rows]
    rows.append(dict.fromkeys(rows[0]))
    got = X.event_rows(pa.array([rows[0], *rows]).slice(1))
    plain = [(r["event"], r["geometry_type"], r["dimensions"] or 0, tuple(math.nan if r[o] is None else r[o] for o in ("", "xy", "xyz", "xym", "xyzm")[r["dimensions"] or 0])) for r in rows]
    assert str(got) == str(plain) and len(got) > 50


@pytest.mark.parametrize("precision", [16, 3, 0])
def test_whole_numbers_as_other_numbers(precision, monkeypatch):
    values = [0.0, -0.0, 1.0, -1.0, 100.0, 123456.0, 999999999999999.0, 1e15, 1e16, -1e16, 1e17, 1e18, 0.5, -2.5, 1e-20]
    want = ["0", "0", "1", "-1", "100", "123456", "999999999999999", "1000000000000000", "10000000000000000", "-10000000000000000", "100000000000000000"]
    assert [number_text(v, precision) for v in values][:11] == want
    monkeypatch.setitem(sys.modules, "decimal", None)  # not asked for whole numbers
    assert [number_text(v, precision) for v in values[:7]] == want[:7]
